from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexloom import queries
from lexloom.functions import text, urls
from lexloom.operators import chunks, classify, scores
from lexloom.operators.graph import components
from lexloom.operators.lexicon import POLICY
from lexloom.streaming import runs

BASE = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("url", "expected"), [("HTTP://A.Example/Terms/?q=1#top", "http://a.example/terms"), ("ftp://a.example/x", None), ("", None), (None, None), ("/terms", None)])
def test_canonical(spark, url, expected):
    assert one(spark, urls.canonical(F.col("u")), u=url) == expected


def test_host(spark):
    assert one(spark, urls.host(F.col("u")), u="https://me@WWW.A.example:443/x") == "a.example"


@pytest.mark.parametrize(("link", "expected"), [("/t", "https://a.example/t"), ("t", "https://a.example/p/t"), ("//b.example/t", "https://b.example/t"), ("mailto:x@y.example", None), ("", None), (None, None), ("https://c.example/#x", "https://c.example/"), ("../x/./y", "https://a.example/x/y"), ("../../../z", "https://a.example/z"), ("?a=1", "https://a.example/p/q?a=1"), ("/a/b/..", "https://a.example/a/")])
def test_resolve(spark, link, expected):
    assert one(spark, urls.resolve(F.lit("https://a.example/p/q"), F.col("l")), l=link) == expected


@pytest.mark.parametrize(("url", "expected"), [
    ("https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Ft&x=1", "https://a.example/t"), ("https://www.bing.com/ck/a?p=2&u=a1aHR0cHM6Ly9hLmV4YW1wbGU&n=1", "https://a.example"),
    ("https://www.google.com/url?q=https%3A%2F%2Fa.example%2F", "https://a.example/"), ("https://a.example/go?url=https%3A%2F%2Fb.example%2Fx", "https://a.example/go?url=https%3A%2F%2Fb.example%2Fx"),
    ("https://www.bing.com/ck/a?x=1", ""), ("ftp://a.example", ""), (None, ""),
])
def test_unwrap(spark, url, expected):
    assert one(spark, urls.unwrap_search(F.col("u")), u=url) == expected


@pytest.mark.parametrize(("url", "expected"), [
    ("https://A.example/policies/fr/privacy/", "https://a.example/policies/privacy"), ("https://a.example/shop/policies/fr/privacy", ""), ("https://a.example/policy/fra/x", ""), ("https://a.example/policies/fr", ""), (None, ""),
])
def test_locale_family(spark, url, expected):
    assert one(spark, urls.locale_family(F.col("u")), u=url) == expected


def test_salvaged_json(spark):
    assert one(spark, text.salvaged_json(F.col("t")), t='Here: ```json\n{"a": [1, 2,], }\n``` done') == '{"a": [1, 2] }'
    assert one(spark, text.salvaged_json(F.col("t")), t="nothing") is None


def test_types(spark):
    assert one(spark, classify.document_type(F.col("t")), t=" Privacy Policy ") == "privacy"
    assert one(spark, classify.document_type(F.col("t")), t=None) == "other"
    assert one(spark, classify.type_of_url(F.col("t")), t="https://a.example/legal/refund-rules") == "returns"


def test_levels(spark):
    got = spark.createDataFrame([(x,) for x in (0, 5, 44, 45, 60, 80, 81, 100)], "s int").select(classify.level(F.col("s")).alias("l")).collect()
    assert [r.l for r in got] == ["low", "low", "low", "medium", "medium", "medium", "high", "high"]


def test_chunks():
    body = "word " * 3300
    parts = chunks.chunked(body)
    assert all(len(p) <= chunks.SIZE for p in parts) and len(parts[-1]) <= chunks.OVERLAP and parts[-1] in parts[-2]
    assert chunks.chunked("short") == ["short"] and chunks.chunked("") == []
    assert len(chunks.chunked("x" * 20_000)) >= 2


@pytest.mark.parametrize(("body", "expected"), [
    ("# One\n## Two\nTERMS OF USE: x", 3), ("\n".join(f"# h{k}" for k in range(9)), 6), ("   # one\n\n \u00a0# two", 2), ("x # no\nABC: no\nTerms Of Use: no\n#no", 0), ("", 0), ("# One\nadd to cart buy now", 0),
])
def test_relevance_counts_headings(spark, body, expected):
    df = spark.createDataFrame([(body,)], "t string")
    assert chunks.with_relevance(df, "t", replace(POLICY, relevance=())).first().relevance == expected


def test_overall_and_rebound(spark):
    rows = spark.createDataFrame([("r", 90, 1), ("r", 85, 2), ("r", None, 3), ("e", None, 4)], "run string, s int, id int")
    got = {r.run: (r.overall_top, r.overall_weighted) for r in scores.overall(rows, "run", "s", "id").collect()}
    assert got["r"] == (88, 88) and got["e"] == (0, 0)
    expected = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("r", 3, "c")], "run string, position int, clause_id string")
    answers = spark.createDataFrame([("r", 1, "z", "first"), ("r", 2, "b", "second"), ("r", 3, "b", "third"), ("r", 4, "q", "extra")], "run string, position int, clause_id string, answer string")
    assert {r.clause_id: r.answer for r in scores.rebound(expected, answers, "run").collect()} == {"a": "first", "b": "second", "c": "third"}


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and got[101] == 100 and got[201] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_stream_of_runs(spark, tmp_path):
    source = spark.read.parquet(f"{BASE}/runs.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = runs.latest_stream(stream).writeStream.outputMode("append").format("memory").queryName("held_runs").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    held = {r.run_id for r in spark.table("held_runs").where("event = 'held'").collect()}
    assert held == {r.run_id for r in source.where("run_id is not null and stored_at is not null").select("run_id").distinct().collect()}


def test_stream_expires(spark, tmp_path):
    schema = "run_id string, stored_at timestamp, status string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = runs.latest_stream(stream, ttl=60, late="1 second").writeStream.outputMode("append").format("memory").queryName("expired_runs").option("checkpointLocation", str(tmp_path / "state")).start()
    for k, rows in enumerate(('{"run_id": "a", "stored_at": "2024-01-01T00:00:00Z", "status": "x"}\n{"run_id": "a", "stored_at": "2023-12-31T00:00:00Z", "status": "old"}', '{"run_id": "b", "stored_at": "2024-01-01T01:00:00Z", "status": "y"}', '{"run_id": "c", "stored_at": "2024-01-01T01:00:01Z", "status": "z"}')):
        (tmp_path / "in" / f"{k}.json").write_text(rows)
        q.processAllAvailable()
    q.stop()
    got = [(r.run_id, r.status, r.event) for r in spark.table("expired_runs").collect()]
    assert ("a", "x", "held") in got and ("a", "x", "expired") in got and not [x for x in got if x[1] == "old"] and ("c", "z", "expired") not in got


def same(spark, catalogue, sql, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(BASE).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    a, b = catalogue[name](spark, BASE).toPandas(), con.execute(sql[name]).df()
    assert sorted(a.columns) == sorted(b.columns)

    def rows(d):
        d = d[sorted(d.columns)]
        return sorted(tuple("None" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in d.astype(object).where(d.notna(), None).itertuples(index=False, name=None))

    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    same(spark, queries.QUERIES, queries.SQL, name)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, BASE).count() >= 0
