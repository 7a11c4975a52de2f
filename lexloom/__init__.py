"""lexloom: analysis of legal and policy documents as lazy Spark plans."""
