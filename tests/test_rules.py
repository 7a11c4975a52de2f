import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from lexloom.functions import html, text
from lexloom.operators import answers, categories, classify, documents, extract, factors, filters, pairs, scores, summary
from lexloom.operators.lexicon import CLAUSE_RULES
from lexloom.sources import pages


def row(spark, schema, *values):
    return spark.createDataFrame([tuple(values)], schema)


@pytest.mark.parametrize(("clause", "expected"), [
    ("We may amend this privacy notice from time to time to reflect changes in how we collect data.", "other"), ("We collect personal information when you visit us.", "data_collection"),
    ("This plan renews automatically each year.", "other"), ("The plan will renew automatically each year.", "auto_renewal"), ("Fees are refunded within ten days.", "refund"), ("We share records with service providers.", "data_sharing"),
    ("These rules are governed by the laws of Norland.", "governing_law"), ("A monthly subscription costs five euros.", "subscription"), ("The IPO subscription is closed.", "other"), ("Nothing of note.", "other"), ("", "other"), (None, "other"),
    ("Prefund the wallet first.", "other"),
])
def test_suggested_category(spark, clause, expected):
    assert row(spark, "t string", clause).select(categories.suggested(text.classifier_form(F.col("t"))).alias("c")).first().c == expected


@pytest.mark.parametrize(("proposed", "clause", "expected"), [
    ("data_collection", "We reserve the right to revise this policy periodically, as our collection of data changes.", "other"), ("data_collection", "We collect personal data from visitors.", "data_collection"),
    ("governing_law", "Your controller handles the collection and disclosure of personal information under applicable national laws.", "data_collection"), ("governing_law", "We keep your personal information as applicable law requires.", "privacy"),
    ("governing_law", "Disputes go to the courts of Norland.", "governing_law"), ("refund", "A fee is charged for each transaction.", "payments"), ("other", "You must not copy the service; copying is prohibited.", "prohibited_use"), ("license", "Some words.", "license"),
])
def test_reconciled_category(spark, proposed, clause, expected):
    df = filters.prepared(row(spark, "p string, t string", proposed, clause), "t").withColumn("form", text.classifier_form(F.col("flat"))).withColumn("s", categories.suggested(F.col("form")))
    assert df.select(categories.reconciled(F.col("p"), F.col("form"), F.col("s")).alias("c")).first().c == expected


#: For each clause rule a clause that it is to find and one that it is not.
CASES = {
    "Age Requirement": ("You have to be at least 18 to join.", "We ship 18 parcels a day."), "Prohibited Use": ("You must not resell the tool.", "You may resell the tool."), "Data Collection": ("We collect contact details.", "The museum shows a painting."),
    "Data Sharing": ("We disclose records to third parties.", "We keep records in a safe."), "Cookies and Tracking": ("The site sets cookies.", "The shop sells bread."), "Data Retention": ("We retain your data for a year.", "We answer within a day."),
    "Policy Changes": ("We may amend these terms.", "The terms are short."), "Account Termination": ("We may suspend your account.", "Your account is free."), "Limitation of Liability": ("We are not liable for loss.", "We pay for loss."),
    "Arbitration": ("Disputes go to arbitration.", "Disputes go to court."), "Class Action Waiver": ("You waive class actions.", "You attend a class."), "Indemnification": ("You will indemnify us.", "You will inform us."),
    "User Content License": ("You grant a licence to your content.", "Your content is yours."), "Government Disclosure": ("We answer court orders.", "We answer letters."), "Advertising and Targeting": ("We show personalised ads.", "We show the menu."),
    "Sensitive Personal Information": ("We hold health data.", "We hold stock."), "Cancellation and Refunds": ("Refunds take a week.", "Parcels take a week."), "Payment Obligations": ("You pay the fee by card.", "The service is free."),
    "Subscription and Auto-Renewal": ("The plan auto-renews.", "The plan ends."), "Governing Law": ("Governed by the law of Norland.", "Made in Norland."), "Intellectual Property": ("All trademarks are ours.", "All marks were good."), "Warranty Disclaimer": ("It comes without any warranty.", "It comes with a lamp."),
}


def test_clause_rules(spark):
    rows = [(title, k, CASES[title][k].lower()) for title, _, _ in CLAUSE_RULES for k in (0, 1)]
    got = spark.createDataFrame(rows, "title string, k int, low string").select("title", "k", classify.rule_titles(F.col("low")).alias("found")).collect()
    assert len(CASES) == len(CLAUSE_RULES) and [(r.title, r.k) for r in got if (r.title in r.found) != (r.k == 0)] == []


@pytest.mark.parametrize(("found", "kept"), [
    (["cookie_tracking", "analytics_tracking"], ["cookie_tracking"]), (["liability_limitation", "damage_cap", "loss_exclusion"], ["damage_cap"]), (["consequential_damage_exclusion", "liability_limitation"], ["consequential_damage_exclusion"]),
    (["liability_limitation", "consequential_damage_exclusion"], ["liability_limitation", "consequential_damage_exclusion"]), (["data_sale"], ["data_sale"]), ([], []), (["data_retention", "indefinite_data_retention", "data_sale"], ["indefinite_data_retention", "data_sale"]),
])
def test_suppression(spark, found, kept):
    assert row(spark, "f array<string>", found).select(factors.suppressed(F.col("f")).alias("x")).first().x == kept


def test_factor_scores(spark):
    rows = [(1, "", None, [" DATA_SALE ", "unknown", "data_sale"]), (2, "Biometric and health data, sensitive data, and we sell data.", "high", []), (3, None, None, None)]
    got = {r.id: r for r in factors.scored(spark.createDataFrame(rows, "id int, source_text string, risk_reason string, given array<string>"), given="given").collect()}
    assert got[1].risk_factors == ["data_sale"] and got[1].factor_score == 25 and got[1].factor_level == "low"
    assert got[2].factor_score >= 90 and got[2].factor_level == "high" and got[3].factor_score == 5


FILLER = "The parties agree on what follows, and each keeps a copy of it for the time that the matter takes. " * 16


@pytest.mark.parametrize(("url", "content", "kind", "expected"), [
    ("https://a.example/privacy", "Privacy Policy. We shall keep personal data; you must tell us. Definitions and scope follow. " + FILLER, "privacy", True), ("https://a.example/privacy", "Privacy Policy of cookies.", "privacy", False),
    ("https://a.example/forum/privacy", "Privacy Policy. We shall keep personal data; you must tell us. Definitions and scope. " + FILLER, "privacy", False), ("https://a.example/returns", "Terms and conditions. You must pay. You shall wait. " + FILLER, "returns", False),
    ("https://a.example/terms", "Terms of use. Add to cart. Buy now. Definitions, scope. You must pay. " + FILLER, "terms", False), ("https://a.example/x", None, "other", False),
])
def test_policy_content(spark, url, content, kind, expected):
    df = filters.signals(filters.prepared(row(spark, "url string, content string, kind string", url, content, kind), "content"))
    assert df.select(filters.is_policy_content(F.col("url"), F.col("kind")).alias("x")).first().x is expected


@pytest.mark.parametrize(("excerpt", "category", "expected"), [
    ("You must tell us of any loss of your card within two days.", "other", True), ("Home | About us | Careers | Blog | Sign in | Sitemap and more of it", "other", False), ("The weather was fine on the day of the fair in town.", "other", False),
    ("Online auto renewal may be found in the menu of this page.", "auto_renewal", False), ("The plan may automatically renew unless you cancel it in time.", "auto_renewal", True), ("You must.", "other", False), (None, None, False),
])
def test_clause_filter(spark, excerpt, category, expected):
    df = filters.prepared(row(spark, "t string, c string", excerpt, category), "t")
    assert df.select(filters.is_clause(F.col("c")).alias("x")).first().x is expected


@pytest.mark.parametrize(("source", "excerpt", "expected"), [
    ("The Institute of Cartography grants you a narrow right.", "tography grants you a narrow right", "The Institute of Cartography grants you a narrow right."), ("The first ends. All texts on this site are ours. The last.", "his site are ours", "All texts on this site are ours."),
    ("and data, and we use it to serve you well. Next we go on.", "and data, and we use it to serve you well", ""), ("OR IMPLIED, INCLUDING FITNESS FOR ANY PURPOSE AT ALL.", "IMPLIED, INCLUDING FITNESS FOR ANY PURPOSE", ""),
    ("A clean sentence of enough words. Another of them follows.", "Another of them follows.", "Another of them follows."), ("Some text of a page.", "not in it at all", "not in it at all"), ("Some text", "", ""), (None, "x", "x"), ("İstanbul is named in the rules of the shop. End.", "named in the rules", "İstanbul is named in the rules of the shop."),
])
def test_boundaries(spark, source, excerpt, expected):
    assert extract.repair(source, excerpt) == expected
    assert row(spark, "s string, e string", source, excerpt).select(extract.repaired("s", "e").alias("x")).first().x == expected


@pytest.mark.parametrize(("source", "excerpt", "expected"), [
    ("We keep the “records” of each visit &amp; more.", 'we keep the "records"  of each visit & more .', True), ("We keep the records of each visit for a whole year.", "We keep the records ... for a whole year", True),
    ("We keep the records of each visit for a whole year.", "for a whole year ... We keep the records", False), ("We keep it.", "We keep it.", False), ("We keep the records of each visit.", "We keep the record of every visit here.", False), (None, "x" * 30, False),
])
def test_grounding(spark, source, excerpt, expected):
    assert row(spark, "s string, e string", source, excerpt).select(text.grounded(F.col("s"), F.col("e")).alias("x")).first().x is expected


SECTIONS = """# 1. Age
Minors, that is people who are under 18, are not allowed to use this website.

# 2. Property
All copyright in this website and in what it holds belongs to the Institute of Norland.

# 3. Limits
You must not publish, sell or show to others any part of what the website holds.

# 4. Content
You grant the Institute a worldwide licence to use and to publish your content in any form.

# 5. Liability
In no event shall the Institute be held liable for anything out of the use of the website; it is not liable at all.
"""


def test_clauses_keep_topics_apart(spark):
    rows = [(1, SECTIONS), (2, None), (3, ""), (4, "Too short to hold a clause.")]
    got = extract.clauses(spark.createDataFrame(rows, "id bigint, content string"), "id", "content").collect()
    by = {}
    for r in got:
        by.setdefault(r.category, []).append(r.source_text)
    assert {r.id for r in got} == {1} and {"age_requirement", "intellectual_property", "prohibited_use", "license", "limitation_of_liability"} <= set(by)
    assert not any("under 18" in x for x in by["intellectual_property"])
    assert all(r.clause_id.startswith("clause-") and len(r.clause_id) == 23 for r in got)


def test_evidence_counts_an_excerpt_once(spark):
    body = "First of all. We share your data with business partners and with third parties who ask for it. And the last."
    df = spark.createDataFrame([("https://a.example/x#1", 0, body), ("https://a.example/x", 0, body), ("https://a.example/x", 1, ""), (None, 0, None)], "document_url string, chunk_index int, chunk string")
    got = extract.evidence(df).collect()
    assert [r.source_text for r in got if r.category == "data_sharing"] == ["We share your data with business partners and with third parties who ask for it."]
    assert len({r.clause_id for r in got}) == len(got)


def test_containment_against_all_pairs(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["日本語の文を保存します", "é", "x-y"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice((30, 60)))) for _ in range(30)]
    texts += [t[k : k + r.randrange(85, 120)] for t in texts[:20] for k in (3, 11)] + [texts[0], "a" * 100, "b" + "a" * 120 + "b", "short"]
    rows = [(k, "https://a.example" if k % 2 else "https://b.example", "terms", t) for k, t in enumerate(texts)] + [(900, None, None, None), (901, None, None, "")]
    keyed = documents.clause_keys(spark.createDataFrame(rows, "id bigint, url string, kind string, t string"), "url", "kind", "t")
    forms = {x.id: (x.doc, x.form) for x in keyed.collect()}
    expected = {(a, b) for a in forms for b in forms if forms[a][0] == forms[b][0] and len(forms[a][1]) >= 80 and len(forms[a][1]) < len(forms[b][1]) and forms[a][1] in forms[b][1]}
    assert {(x.inner, x.outer) for x in documents.contained(keyed, "id").collect()} == expected and len(expected) > 10


def test_near_documents_against_all_pairs(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    texts = []
    for _ in range(12):
        t = [r.choice(words) for _ in range(240)]
        texts.append(" ".join(t))
        for n in (1, 3, 30):
            u = list(t)
            for _ in range(n):
                u[r.randrange(len(u))] = r.choice(words)
            texts.append(" ".join(u))
    rows = [("s", k, t) for k, t in enumerate(texts)] + [("s", 90, None), ("s", 91, "")]
    got = {(x.k_x, x.k_y) for x in documents.near_pairs(spark.createDataFrame(rows, "s string, k bigint, form string"), "s", "k", "form").collect()}
    expected = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if documents.similar(texts[a], texts[b])}
    assert got == expected and len(expected) >= 24


def test_matching_blocks_are_those_of_a_sequence_matcher():
    r = random.Random(8)
    for n in (5, 200, 700):
        for letters in ("ab", "abcdefgh "):
            a = [r.choice(letters) for _ in range(n)]
            b = list(a)
            for _ in range(8):
                k = r.randrange(n)
                b[k : k + r.randrange(4)] = [r.choice(letters) for _ in range(r.randrange(4))]
            a, b = "".join(a), "".join(b)
            same = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
            assert {(i + k, j + k) for i, j, m in documents.matching_blocks(a, b) for k in range(m)} == {(i + k, j + k) for i, j, m in same for k in range(m)}
            assert sum(m for _, _, m in same) <= documents.subsequence(a, b) == documents.subsequence(b, a) <= n + 32


def test_long_documents_are_compared_in_time():
    r = random.Random(9)
    a = " ".join(r.choice(("data", "user", "we", "may", "shop", "keep")) + str(r.randrange(300)) for _ in range(2_800))
    b = a.replace(" data1", " item1")
    began = time.process_time()
    assert documents.similar(a, b) and not documents.similar(a, a[: len(a) // 2] + a[: len(a) // 2][::-1])
    assert time.process_time() - began < 2


def _words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_documents_are_compared_as_a_whole(spark):
    r = random.Random(11)
    head, middle, other, tail = (" ".join(_words(r, n)) for n in (1_500, 800, 800, 1_500))
    a, b = f"{head} {middle} {tail}", f"{head} {other} {tail}"
    assert not documents.similar(a, b)  # both ends of 10,000 characters are the same
    c = " ".join(_words(r, 6_000))
    d = " ".join(_words(r, 180)) + c[180 * 7 - 1 :]
    assert documents.similar(c, d)  # of the first 20,000 characters too many differ, of all of them few
    rows = [("s", k, f"https://a.example/{k}", t) for k, t in enumerate((a, b, c, d))]
    got = documents.deduped(spark.createDataFrame(rows, "site string, id bigint, url string, content string"), "site", "id", "url", "content")
    assert {x.id: x.group for x in got.collect()} == {0: 0, 1: 1, 2: 2}


def test_long_words_are_compared_to_their_characters():
    r = random.Random(12)
    long = "".join(r.choice("0123456789abcdef") for _ in range(1_500))
    assert documents.matching_ratio(f"key {long}", f"key {long[:700]}-{long[701:]}") > 0.99
    words = ["".join(r.choice("abcdefghij") for _ in range(40)) for _ in range(60)]
    assert documents.similar(" ".join(words), " ".join(f"{x[:20]}z{x[21:]}" if k % 4 else x for k, x in enumerate(words)))


def test_changes_in_many_lines_are_compared_in_time():
    lines = [f"item {k:06d} of the goods that the shop holds." for k in range(1_400)]
    began = time.process_time()
    assert documents.similar(" ".join(lines), " ".join(x if k % 4 else x.replace("goods", "wares") for k, x in enumerate(lines)))
    assert time.process_time() - began < 2


def test_sequences_bound_common_subsequences():
    r = random.Random(13)
    refused = 0
    for n in (1, 4, 5, 30, 200):
        for _ in range(40):
            a = [r.choice("abcdefgh ") for _ in range(n)]
            b = list(a)
            for _ in range(r.choice((0, 1, 9))):
                k = r.randrange(n)
                b[k : k + r.randrange(4)] = [r.choice("abcdefgh ") for _ in range(r.randrange(4))]
            a, b = "".join(a), "".join(b)
            assert documents.sequences_allow(a, b, documents.subsequence(a, b))
            refused += not documents.sequences_allow(a, "".join(reversed(b)), 0.96 * (len(a) + len(b)) / 2)
    assert refused > 20


def test_documents_deduped(spark):
    long = "Terms of the shop. " + " ".join(f"clause {k} holds for part {k * 7} of the goods." for k in range(60))
    rows = [
        (1, "https://a.example/terms", long), (2, "https://A.example/terms/", "other text"), (3, "https://a.example/copy", long.upper()), (4, "https://a.example/policies/fr/terms", long.replace("clause 3 ", "item 3 ")), (5, None, "x"), (6, "https://a.example/empty", ""), (7, "https://a.example/none", None),
    ]
    df = spark.createDataFrame([("s", *x) for x in rows], "site string, id bigint, url string, content string")
    got = {x.id: x.group for x in documents.deduped(df, "site", "id", "url", "content").collect()}
    assert got == {4: 1, 5: 5}


def test_pairs_meet_in_blocks(spark):
    rows = [("h", k, k * 2) for k in range(50)] + [("t", 1, 2), ("t", 7, 14), ("u", 3, 6), (None, 4, 8), (None, 5, 10)]
    got = sorted((x.k_x, x.k_y, x.v_x, x.v_y) for x in pairs.meet(spark.createDataFrame(rows, "b string, k int, v int"), "b", "k", ["v"], block=8).collect())
    assert got == sorted([(a, b, 2 * a, 2 * b) for a in range(50) for b in range(a + 1, 50)] + [(1, 7, 2, 14)])


def test_html(spark):
    page = "<html><style>x</style><nav class=n>Menu</nav><div id='cookie-bar'>Accept</div><article><h1>Head</h1><p>One &amp; two<br>three</p></article><SCRIPT>a<b</SCRIPT><p>after</p></html>"
    got = row(spark, "h string", page).select(html.html_to_text(F.col("h")).alias("t"), html.html_main_text(F.col("h")).alias("m")).first()
    assert "One & two" in got.t and "a<b" not in got.t and got.m == "Head\nOne & two\nthree"
    assert html.main_content(None) is None and html.main_content("") == ""
    links = row(spark, "h string", "<a href='/x' class=y><b>Go</b>\n on</a><a name=z>no</a><A HREF=\"/y\"></A>").select(html.anchors(F.col("h")).alias("a")).first().a
    assert [(x.href, x.label) for x in links] == [("/x", "Go on"), ("/y", "")]


@pytest.mark.parametrize(("raw", "expected"), [
    ('Sure:\n```json\n[{"title": "A", "source_text": "x"},]\n```', ["A"]), ('{"analyses": [{"clause_id": "1", "title": "B"}]}', ["B"]), ('one {"title": "C"} broken { "title": and {"title": "D",}', ["C", "D"]), ("no json", []), ("", []), (None, []), ("[]", []),
])
def test_answers(spark, raw, expected):
    got = row(spark, "r string", raw).select(answers.parsed_items(F.col("r")).alias("x")).first().x
    assert [x.title for x in got] == expected


def test_strict_object(spark):
    def strict(raw):
        return row(spark, "r string", raw).select(answers.strict_object(F.col("r")).alias("x")).first().x

    assert strict('```json\n{"a": 1}\n```') == '{"a": 1}' and strict("[1]") is None and strict('{"a": ') is None and strict(None) is None


@pytest.mark.parametrize(("score", "level", "hundred", "ten"), [("44", None, "low", "critical"), ("45", "", "medium", "critical"), ("81", "Moderate", "medium", "medium"), ("5", None, "low", "medium"), ("x", None, "low", "low"), (None, "CRITICAL ", "critical", "critical")])
def test_answer_levels(spark, score, level, hundred, ten):
    s, v = F.col("s"), F.col("v")
    got = row(spark, "s string, v string", score, level).select(answers.level100(v, answers.score100(s)).alias("h"), answers.level10(v, answers.score10(s)).alias("t")).first()
    assert (got.h, got.t) == (hundred, ten)


class Flaky:
    def __init__(self, fails, error="503 unavailable"):
        self.fails, self.error, self.asked = fails, error, []

    def generate(self, system_prompt, user_prompt, model=None):
        self.asked.append(model)
        if len(self.asked) <= self.fails:
            raise RuntimeError(self.error)
        return "[]"


def test_asking_again():
    slept = []
    client = Flaky(2)
    assert answers.ask(client, "s", "u", ("m",), 2, slept.append) == "[]" and slept == [1.0, 2.0] and client.asked == ["m"] * 3
    client = Flaky(1, "bad request")
    assert answers.ask(client, "s", "u", ("m", "n"), 2, slept.append) == "[]" and client.asked == ["m", "n"]
    with pytest.raises(RuntimeError):
        answers.ask(Flaky(9), "s", "u", ("m",), 1, slept.append)


def test_explained(spark):
    df = spark.createDataFrame([("r", 0, "a", "x"), ("r", 0, "b", "y"), ("r", 1, "c", "z")], "run_id string, batch int, clause_id string, text string")

    class Echo:
        def generate(self, system_prompt, user_prompt, model=None):
            if '"c"' in user_prompt:
                raise RuntimeError("refused")
            return user_prompt

    got = {x.batch: x for x in answers.explained(df, Echo, "system").collect()}
    assert '"clause_id": "b"' in got[0].raw and got[0].error is None and got[1].raw is None and got[1].error == "refused"


def test_rebound_uses_each_answer_once(spark):
    expected = spark.createDataFrame([("r", 1, "a"), ("r", 2, "a"), ("r", 3, "b"), ("r", 4, None)], "run string, position int, clause_id string")
    given = spark.createDataFrame([("r", 1, "a", "one"), ("r", 2, "a", "two"), ("r", 3, "zz", "three"), ("r", 4, "a", "four"), ("r", 5, "b", None)], "run string, position int, clause_id string, answer string")
    assert {r.position: r.answer for r in scores.rebound(expected, given, "run").collect()} == {1: "one", 2: "two", 3: None, 4: "three"}


def test_page_sources(spark, tmp_path):
    long = "A text of a document that has a good many words in it. " * 12
    rows = [("a", "dynamic", long + "x"), ("a", "crawl", "short"), ("a", "static", long), ("b", "crawl", None), ("c", "odd", long), ("c", "reader", long)]
    got = {r.k: r.method for r in pages.best_source(spark.createDataFrame(rows, "k string, method string, text string"), "k").collect()}
    assert got == {"a": "static", "c": "reader"}
    t = row(spark, "m string, c string, r string", " ", "<p>One</p>", "<p>Two</p>").select(pages.page_text(F.col("m"), F.col("c"), F.col("r")).alias("x")).first().x
    assert t == "One"
    (tmp_path / "a.pdf").write_bytes(b"x" * 500 + b"%PDF-1.7")
    (tmp_path / "b.pdf").write_bytes(b"x" * 2000 + b"%PDF-1.7")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-" + b"x" * 5000)
    assert [r.path.rsplit("/", 1)[-1] for r in pages.pdf_files(spark, str(tmp_path), 4000).collect()] == ["a.pdf"]
    body = F.lit(b"%PDF-1.4")
    lines = "\n".join(f"line {k} of the document that was read out of its pages" for k in range(20))
    found = row(spark, "x string, y string", "pdf viewer loading...", lines).select(pages.pdf_text(body, F.col("x"), F.col("y")).alias("p")).first().p
    assert found.source == "second" and found.text.startswith("line 0") and row(spark, "x string", lines).select(pages.pdf_text(F.lit(b"no"), F.col("x"), F.col("x")).alias("p")).first().p.text == ""


@pytest.mark.parametrize(("title", "category", "source", "expected"), [
    ("Fees  and\nterms", "other", "", "Fees and terms"), ("Untitled", "payments", "", "Payment Obligations"), (None, "none", "We use cookies.", "Cookies and Tracking"), ("n/a", None, None, "Clause"), ("w " * 60, None, None, ("w " * 30)[:59].rstrip() + "…"),
])
def test_display_title(spark, title, category, source, expected):
    df = row(spark, "t string, c string, s string", title, category, source)
    assert df.select(summary.display_title(F.col("t"), F.col("c"), F.col("s")).alias("x")).first().x == expected


def test_summary_takes_the_score_of_the_evidence(spark):
    clauses = spark.createDataFrame([("a", 1, 90, "HIGH", "T", "R"), ("a", 2, 10, "low", None, None), ("b", 3, 50, "medium", "U", "S"), ("c", 4, None, None, None, None)], "g string, row_id bigint, risk_score int, risk_level string, title string, risk_reason string")
    found = spark.createDataFrame([("a", "x", 30), ("a", "y", 20)], "g string, clause_id string, factor_score int")
    got = {r.g: (r.overall_score, r.high, r.medium, r.low, r.findings) for r in summary.summarised(clauses, found, "g").collect()}
    assert got == {"a": (25, 1, 0, 1, ["T: R"]), "b": (50, 0, 1, 0, []), "c": (0, 0, 0, 0, [])}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "site string, id bigint, url string, content string")
    assert documents.deduped(docs, "site", "id", "url", "content").count() == 0
    assert extract.clauses(docs, "id", "content").count() == 0
    keyed = documents.clause_keys(docs.withColumn("kind", F.lit("x")), "url", "kind", "content")
    assert documents.uncontained(documents.exact_clauses(keyed, "id"), "id").count() == 0
    assert factors.scored(spark.createDataFrame([], "source_text string")).count() == 0
