import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from lexloom.llm import encode, leakage, mainbody, nearpairs, pieces, quality, queries, residue, sentences, sitelines
from lexloom.llm.words import WORD, shingles, word_hashes
from lexloom.operators import sieve
from tests.test_core import BASE, same

LONG = "A sentence of some words. " * 900


def test_cuts_keep_limits_and_text():
    r = random.Random(3)
    for text in (LONG, "x" * 30_000, "para one.\n\n" * 2000, "日本語の文。" * 4000, "a" * 9001, "".join(r.choice("ab \n.é") for _ in range(40_000))):
        ends, at, whole = pieces.cuts(text), 0, ""
        for k, (end, _) in enumerate(ends):
            start = max(0, at - pieces.OVERLAP) if k else 0
            assert end > at and end - start <= pieces.LIMIT
            whole += text[at:end]
            at = end
        assert whole == text
    assert pieces.cuts("short") == [(5, "end")]
    with pytest.raises(ValueError):
        pieces.cuts("x", 10, 10)


def test_pieces_frame(spark):
    df = spark.createDataFrame([(1, LONG, "p"), (2, "short", "q"), (3, "", "r"), (4, None, "s")], "id bigint, t string, piece string")
    got = pieces.pieces(df.drop("piece"), "t", ["id"]).orderBy("id", "piece_no").collect()
    assert {r.id for r in got} == {1, 2} and all(len(r.piece) <= pieces.LIMIT and r.end_pos - r.start_pos == len(r.piece) for r in got)
    first, second = got[0], got[1]
    assert second.piece[: pieces.OVERLAP] == first.piece[-pieces.OVERLAP :]


def test_site_lines(spark):
    rows = [(k, "https://www.A.example:80/x", f"Head {k}\r\nAll Rights!\nown {k} text", None) for k in range(8)] + [(20, None, "all rights", None), (21, "https://b.example", "all rights", None), (22, "https://a.example", None, None)]
    df = spark.createDataFrame(rows, "scrape_id bigint, url string, content string, scraped_at timestamp")
    assert {(r.scrape_id, r.line_no) for r in sitelines.repeated_lines(df).collect()} == {(k, 2) for k in range(8)}
    assert {r.scrape_id: r.content for r in sitelines.cleaned(df).collect()}[3] == "Head 3\r\nown 3 text"
    assert sitelines.repeated_lines(df.limit(0)).count() == 0


def test_articles_published_again_are_no_boilerplate(spark):
    rows = [(k, "https://a.example/x", "The one article\nAll rights", None) for k in range(9)] + [(20 + k, "https://a.example/x", f"page {k}\nAll rights", None) for k in range(9)]
    df = spark.createDataFrame(rows, "scrape_id bigint, url string, content string, scraped_at timestamp")
    assert {r.line_no for r in sitelines.repeated_lines(df).where("scrape_id < 20").collect()} == {1, 2}
    assert {r.scrape_id: r.content for r in sitelines.cleaned(df).collect()}[3] == "The one article"


def test_main_body():
    page = "Home\nAbout us\nSearch\nWe use cookies to make Acme work and to measure visits.\nAccept all\n# Terms of Acme\nWritten by A. Person\nYou may not copy this text.\n\nContact\nWrite to us at any time.\nShare this page\n© 2020 Acme Ltd. All rights reserved."
    assert mainbody.main_text(page) == "# Terms of Acme\nYou may not copy this text.\n\nContact\nWrite to us at any time."
    assert mainbody.main_text("") == "" and mainbody.main_text("Home\nSearch") == ""
    assert mainbody.main_text("404 Not Found") == "404 Not Found"


def test_long_lines_of_a_site():
    notice = " ".join(f"Acme and {k} partners process data." for k in range(60))
    assert len(notice) > 900 and mainbody.main_text(f"Terms of Acme\n{notice}\nYou may not copy this text.") == "Terms of Acme\nYou may not copy this text."


@pytest.mark.parametrize(("body", "label"), [
    ("404 Not Found", "error"), ("Please enable JavaScript to view this page.", "notice"), ("Insert your own text here. Placeholder text for section 2.", "filler"),
    ("These terms bind {{company}} and its users. Send notices to [legal_entity] at once.", "blanks"), ("", ""),
    ("The service may be down for maintenance, in which case the clinic answers with code 503 and keeps your password.", ""),
    ("In a letter the field {{first_name}} is replaced by the name on the licence. We keep it.", ""), ("JavaScript must be on for the panel, while your appeal works without it. We keep your data for a year and delete it then.", ""),
])
def test_evidence(body, label):
    assert residue.evidence(body)[0] == label


def test_residue_spreads(spark):
    r = random.Random(9)
    base = " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(600)) + " "
    rows = [("t", 1, base + "Send notices to {{company}} and {{city}}."), ("t", 2, base + "Send notices to {{company}} where the field stands."), ("t", 3, base + "Send notices to us."), ("t", 4, None), ("t", 5, "")]
    got = {r.row_id: r.how for r in residue.residue(spark.createDataFrame(rows, "tbl string, row_id bigint, text string")).collect()}
    assert got == {1: "trusted", 2: "spread"}


def test_what_has_no_cue_is_named_by_what_it_is_like(spark):
    r = random.Random(10)
    words = ["".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(3)) for _ in range(60)]
    known = " ".join([*words[:30], "dummy text", *words[30:]])
    rows = [("t", 1, known), ("t", 2, known.replace("dummy", "dumy")), ("t", 3, " ".join(words[:20])), ("t", 4, " ".join(reversed(words)))]
    got = {x.row_id: (x.label, x.how) for x in residue.residue(spark.createDataFrame(rows, "tbl string, row_id bigint, text string")).collect()}
    assert got == {1: ("filler", "trusted"), 2: ("filler", "spread")}


def test_what_has_no_cue_is_named_at_the_threshold_and_over_others(spark):
    r = random.Random(12)
    words = ["".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(4)) for _ in range(300)]
    known = " ".join([*words[:150], "dummy text", *words[150:]])
    changed = [*words[:150], "dumy", "text", *words[150:]]
    near, far = ([x + "q" if k % 60 in at else x for k, x in enumerate(changed)] for at in ((10,), (10, 35)))
    near, far, off = (" ".join(x) for x in (near, far, [x + "q" if k % 30 == 5 else x for k, x in enumerate(changed)]))
    sets = [set(residue.features(x).tolist()) for x in (known, near, far, off)]
    alike = [[len(a & b) / len(a | b) for b in sets] for a in sets]
    assert 0.8 <= alike[0][1] < 0.86 and 0.8 <= alike[1][2] < 0.86 and max(alike[0][2], *alike[3][:3]) < 0.8
    hashes = [residue.simhash(residue.features(x)) for x in (known, near, far)]
    assert (hashes[0] ^ hashes[1]).bit_count() > residue.NEAR and (hashes[1] ^ hashes[2]).bit_count() > residue.NEAR
    rows = [("t", k, x) for k, x in enumerate((known, near, far, off), 1)]
    got = {x.row_id: (x.label, x.how) for x in residue.residue(spark.createDataFrame(rows, "tbl string, row_id bigint, text string")).collect()}
    assert got == {1: ("filler", "trusted"), 2: ("filler", "spread"), 3: ("filler", "spread")}


def _shuffled(spark):
    """Bytes that the stages of the session have written for shuffles so far."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def _pages_without_cues():
    """A filler, the same without its cue, and long texts without any."""
    r = random.Random(14)
    words = ["".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(4)) for _ in range(60)]
    known = " ".join([*words[:30], "dummy text", *words[30:]])
    return [(1, known), (2, known.replace("dummy", "dumy"))] + [(k, " ".join("".join(r.choices("bcdfgaeiou", k=7)) for _ in range(2000))) for k in range(3, 103)]


def _rows_and_shuffled(spark, df):
    """The rows of what ``df()`` gives, and the bytes shuffled for them where no side of a join is small enough to be broadcast."""
    before = _shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = df().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return rows, sum(n for k, n in _shuffled(spark).items() if k not in before)


def test_texts_without_cues_are_not_shuffled_to_meet_a_few(spark):
    pages = _pages_without_cues()
    df = spark.createDataFrame([("t", *x) for x in pages], "tbl string, row_id bigint, text string")
    got, written = _rows_and_shuffled(spark, lambda: residue.residue(df))
    assert {x.row_id: (x.label, x.how) for x in got} == {1: ("filler", "trusted"), 2: ("filler", "spread")}
    assert written < 0.2 * sum(len(x) for _, x in pages)


def test_statistics_do_not_shuffle_texts(spark, tmp_path):
    pages = _pages_without_cues()
    for name, rows, schema in (
        ("agent1_request", pages, "request_id bigint, browser_page_text string"),
        ("firecrawl_scrape", [(1, "A page of a few words.")], "scrape_id bigint, content string"),
        ("clause_analysis", [(1, "We keep what you tell us for a year.")], "row_id bigint, source_text string"),
        ("common_word", [("the",), ("you",)], "word string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got, written = _rows_and_shuffled(spark, lambda: queries.p5_statistics(spark, str(tmp_path)))
    assert len(got) == len(pages) + 1 and all(x.kind in ("prose", "residue") for x in got if x.row_id < 3)
    assert written < 0.2 * sum(len(x) for _, x in pages)


def test_sieve_keeps_every_key(spark):
    r = random.Random(15)
    keys, others = ([r.randrange(-(2**63), 2**63) for _ in range(5000)] for _ in range(2))
    table = sieve.sieve(spark.createDataFrame([(k,) for k in keys], "k bigint"))
    assert sieve.passing(table, np.array(keys)).all() and sieve.passing(table, np.array(others)).mean() < 0.05
    assert not sieve.passing(sieve.sieve(spark.createDataFrame([], "k bigint")), np.array(keys)).any()
    df = spark.createDataFrame([(1, [keys[0], keys[1]]), (2, []), (3, [keys[2]])], "id bigint, k array<bigint>")
    assert {(x.id, x.k) for x in sieve.exploded(df, spark.sparkContext.broadcast(table)).collect()} == {(1, keys[0]), (1, keys[1]), (3, keys[2])}


@pytest.mark.parametrize("blank", ["<%= company_name %>", "#effective date#", "«RETENTION PERIOD»", "«brandName»", "{{x}}", "*|NAME|*", "@@a b@@", "[insert date]"])
def test_blanks(blank):
    body = f"These terms bind {blank} and all who use the shop. We keep what {blank} tells us for a year, and no longer."
    assert residue.evidence(body)[0] == "blanks" and residue.evidence(body.replace(blank, "the company"))[0] == ""
    assert residue.evidence("x " * 5000 + body)[0] == "blanks"  # of any length
    assert residue.evidence("The undefined shop tells undefined that the rules hold.")[0] == "blanks" and residue.evidence("An undefined term has its usual meaning.")[0] == ""


def _connected(pairs):
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return lambda a, b: find(a) == find(b)


def _alike(texts):
    sets = [set(residue.features(t).tolist()) for t in texts]
    return {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= residue.ALIKE * len(sets[a] | sets[b])}


def test_all_pairs_of_a_simhash_bucket(spark, monkeypatch):
    monkeypatch.setattr(residue, "BLOCK", 16, raising=False)  # block against block
    r = random.Random(11)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600)]
    texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(80)]
    texts += [t + " wxx" for t in texts[:20]]  # alike, with others between them in the bucket
    # texts of the same phrases, whose rarest shingles many others have
    phrases = [" ".join(r.choice(words) for _ in range(30)) for _ in range(8)]
    for chosen in itertools.combinations(phrases, 6):
        texts += [" ".join(chosen).replace(" ", f" x{chr(97 + k)} ", k) for k in range(3)]
    r.shuffle(texts)
    # one bucket in each table: all hashes equal, so the order is that of the ids
    df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "class_id bigint, simhash bigint, body string")
    truth = _alike(texts)
    got = {(x.a, x.b) for x in residue.near_pairs(df).collect()}
    one = _connected(got)
    assert len(truth) > 100 and got <= truth and all(one(a, b) for a, b in truth)


def test_recall_near_the_least_similarity(spark):
    r = random.Random(12)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600)]
    texts = []
    for _ in range(40):
        t = [r.choice(words) for _ in range(100)]
        texts.append(" ".join(t))
        t[20], t[60] = "xx", "yy"  # 86 of 106 shingles are common
        texts.append(" ".join(t))
    truth = _alike(texts)
    df = spark.createDataFrame([(k, residue.simhash(residue.features(t)) - 2**63, t) for k, t in enumerate(texts)], "class_id bigint, simhash bigint, body string")
    one = _connected((x.a, x.b) for x in residue.near_pairs(df).collect())
    assert len(truth) == 40 and all(one(a, b) for a, b in truth)


@pytest.mark.parametrize(("text", "kind"), [
    ("We may change these terms.", "prose"), ("- one thing\n- two things\n- three things", "list"), ("a | b | c\n1 | 2 | 3\n4 | 5 | 6", "table"), ("if(!a.b)c.push(d[3]);var e=function(f){return g.h||2};", "junk"),
    ("", "prose"), ("当社は記録を保存します。", "prose"), ("KEEP ALL RECORDS FOR A YEAR.", "prose"),
])
def test_quality(text, kind):
    assert quality.statistics(text, frozenset({"the", "for", "a"}))[1] == kind


def test_lines_are_judged_where_no_rule_is_broken():
    common = frozenset({"the", "for", "a", "of"})
    rows = "".join(f"- the cost of the goods in the group {'abcdefghijklmnopq'[k]}.\n" for k in range(17))
    values, kind, reasons = quality.statistics(rows + "All of it holds for the year.\n" * 3, common)
    assert (kind, reasons) == ("list", "list_lines") and dict(zip(quality.NAMES, values, strict=True))["prose_share"] < 0.2
    prose = "We keep the data of a buyer for as long as the law asks for it, and no longer than that.\n" * 9
    values, kind, reasons = quality.statistics(prose + "\n".join(f"- the item {k}." for k in range(3)), common)
    named = dict(zip(quality.NAMES, values, strict=True))
    assert (kind, reasons, named["bullet_line_share"]) == ("prose", "", 3 / 12) and named["prose_share"] < 1


@pytest.mark.parametrize(("text", "reasons"), [
    ("We keep the records of the visit for a year and delete them then. " * 5, set()), ("We keep the records for a year.", {"few_words"}), ("the a " + "word " * 100_001 + "\nEnd.", {"many_words"}),
    ("the a " + "internationalisation " * 60 + ".", {"long_words"}), ("a b the c. " * 20, {"short_words"}), ("the #word for #words. " * 20, {"symbols"}), ("- the word for words here\n" * 20, {"bullet_lines", "few_closing_marks", "list_lines"}),
    ("the word for words of all kinds here...\n" * 20, {"ellipsis_lines", "symbols"}), ("the 123 word 4567 for 12345. " * 20, {"words_without_letters"}), ("some words that none knows. " * 20, {"few_common_words"}), ("", set()),
])
def test_published_rules(text, reasons):
    assert set(quality.statistics(text, frozenset({"the", "for", "a"}))[2].split(",")) - {""} == reasons


def test_only_records_of_p4_are_no_cases_of_p5(spark, tmp_path):
    code = "if(!a.b)c.push(d[3]);var e=function(f){return g.h||2};\nvar x={{name}};if(y){z.push(<nav>)};{{host}}"
    lines = "\n".join(f"- {w} thing of the list" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"))
    rows = [(1, lines + "\n- {{company}} and {{city}}"), (2, lines + "\n- {{company}} where the field stands"), (3, lines)]
    spark.createDataFrame(rows, "request_id bigint, browser_page_text string").write.parquet(f"{tmp_path}/agent1_request.parquet")
    spark.createDataFrame([(9, None)], "scrape_id bigint, content string").write.parquet(f"{tmp_path}/firecrawl_scrape.parquet")
    spark.createDataFrame([(1, code)], "row_id bigint, source_text string").write.parquet(f"{tmp_path}/clause_analysis.parquet")
    spark.createDataFrame([("en", "the")], "lang string, word string").write.parquet(f"{tmp_path}/common_word.parquet")
    assert {(r.row_id, r.how) for r in queries.p4_labels(spark, str(tmp_path)).collect()} == {(1, "trusted"), (2, "spread")}
    assert {tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect()} == {("agent1_request", 3), ("clause_analysis", 1)}


def test_near_pairs_against_all_pairs(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(40):
        t = [r.choice(words) for _ in range(r.choice((32, 60, 200)))]
        texts.append(t)
        for _ in range(3):
            u = list(t)
            for _ in range(r.randrange(0, 6)):
                u[r.randrange(len(u))] = r.choice(words)
            texts.append(u)
    rows = [("t", k, " ".join(t)) for k, t in enumerate(texts)] + [("t", 900, None), ("t", 901, ""), ("t", 902, "few words")]
    got = {(x.id_a, x.id_b) for x in nearpairs.pairs(spark.createDataFrame(rows, "tbl string, row_id bigint, text string")).collect()}
    sets = [set(zip(t, t[1:], t[2:])) for t in texts]
    expected = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got == expected


def test_frequent_shingles_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearpairs, "BLOCK", 8)
    r = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    form = [r.choice(words) for _ in range(60)]  # a form that most records fill in
    texts = []
    for k in range(60):
        t = list(form)
        for _ in range(k % 5):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(t)
    texts += [[r.choice(words) for _ in range(40)] for _ in range(20)]
    sets = [set(zip(t, t[1:], t[2:])) for t in texts]
    expected = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    df = spark.createDataFrame([("t", k, " ".join(t)) for k, t in enumerate(texts)], "tbl string, row_id bigint, text string")
    counts = np.where(np.arange(1 << 10) % 4, 200, 0).astype(np.uint8)  # three in four shingles may be frequent
    seen = nearpairs.survey(df, nearpairs.slots_for(df)).where("kind = 0")
    salted = nearpairs.prefixes(seen, counts, 0.7, 1)
    assert salted.where("salt > 0").count() > 0
    assert {(x.id_a, x.id_b) for x in nearpairs.pairs(df, hot=1).collect()} == expected and len(expected) > 400


def test_copies_are_not_squared(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [("t", k, text) for k in range(100)] + [("t", 500, text + " x")]
    got = {(r.id_a, r.id_b) for r in nearpairs.pairs(spark.createDataFrame(rows, "tbl string, row_id bigint, text string")).collect()}
    assert {(0, k) for k in range(1, 100)} <= got and len(got) == 99 + 100  # 100 x 1 is within EXPAND, 100 x 100 is not


def test_different_texts_of_equal_words(spark):
    text = " ".join(f"w{k}" for k in range(50))
    # 40 and 45 records of two texts with the same words; 100 of one text, 3 of another with the same words, 50 of a class alike to it
    other, third = text.replace("w", "v"), text.replace("w", "v") + " x"
    rows = [(k, text) for k in range(40)] + [(k, text.upper()) for k in range(100, 145)] + [(k, other) for k in range(200, 300)] + [(k, other + "!") for k in range(300, 303)] + [(k, third) for k in range(400, 450)]
    got = [(r.id_a, r.id_b) for r in nearpairs.pairs(spark.createDataFrame([("t", *x) for x in rows], "tbl string, row_id bigint, text string")).collect()]
    first = [k for k, _ in rows if k < 200]
    expected = {(a, b) for a in first for b in first if a < b} | {(200, k) for k in range(201, 300)} | {(a, b) for a in range(200, 303) for b in range(300, 303) if a < b}
    expected |= {(a, b) for a in range(400, 450) for b in range(a + 1, 450)} | {(200, 400)} | {(a, b) for a in range(300, 303) for b in range(400, 450)}
    assert len(got) == len(set(got)) and set(got) == expected


def test_encoding_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(1)
    texts = ["", "it's 's's\n's  't 'sfoo ''s x'll'llx  \n \n a", "<|endoftext|> 日本語 ไทย हिन्दी 🙂", *("".join(r.choice("ab'stre ll\n\t1²é日.,!  ") for _ in range(60)) for _ in range(400))]
    assert encode.encode(texts, encode.vocabulary()) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encoding_frame(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in encode.encoded(df, "text", "doc_id").collect()}
    assert got[2] == [] and got[3] == [] and len(got[1]) == 2
    starts = {r.doc_id: (r.starts, r.n_ids) for r in encode.slice_offsets(df, "text", "doc_id").collect()}
    assert starts[1] == ([0, 1], [1, 1]) and starts[2] == ([], [])


def test_leaks_against_all_grams(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice((5, 12, 40))))) for k in range(12)] + [(90, None), (91, "")]
    docs = []
    for k in range(60):
        t = [r.choice(words) for _ in range(50)]
        source = (r.choice(items)[1] or "").split()
        docs.append((k, " ".join(t[:20] + source[: r.randrange(8, 30)] + t[20:])))
    docs += [(100, None), (101, "")]
    grams = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - 11):
            grams[tuple(w[k : k + 12])].add(i)
    expected = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - 11):
            expected |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == expected and expected


@pytest.mark.parametrize(("text", "expected"), [
    ("Dr. J. Doe pays 3.5 euros, e.g. today. It ends at 9 p.m. Then we go.", ["Dr. J. Doe pays 3.5 euros, e.g. today.", "It ends at 9 p.m.", "Then we go."]),
    ("“Is it safe?” asks the desk. “Keep it!” is no term.", ["“Is it safe?” asks the desk.", "“Keep it!” is no term."]),
    ("Am 5. Juni 2018 prüfen wir es. Nr. 4 bzw. Nr. 5 endet!", ["Am 5. Juni 2018 prüfen wir es.", "Nr. 4 bzw. Nr. 5 endet!"]),
    ("銀行は保存できます。「渡しません。」とAは述べています。", ["銀行は保存できます。", "「渡しません。」とAは述べています。"]),
    ("Heading\nThe text is here. It goes on.\n\n- one\n- two", ["Heading", "The text is here.", "It goes on.", "- one", "- two"]),
    ("हम इसे रखते हैं। डॉ. Juna देखते हैं।", ["हम इसे रखते हैं।", "डॉ. Juna देखते हैं।"]), ("", []), (" \n　 ", []),
])
def test_sentences(text, expected):
    assert [text[a:z] for a, z in sentences.sentences(text)] == expected


def test_long_quotations_and_contexts():
    inner = " ".join(f"The rule {k} holds for all." for k in range(60))
    assert [x for x in _cut(f"“{inner}” says the desk. It ends.")] == [f"“{inner}” says the desk.", "It ends."]
    assert _cut("It ends." + " " * 300 + "then it goes on. The end.") == ["It ends." + " " * 300 + "then it goes on.", "The end."]


def _cut(text):
    return [text[a:z] for a, z in sentences.sentences(text)]


def test_abbreviations_by_language():
    assert "art" in sentences.abbreviations(("de",))[1] and "al" not in sentences.abbreviations(("en",))[1] and "z.b" in sentences.abbreviations(())[0]
    assert sentences.languages("the law of the land") == ("en",) and sentences.languages("") == () and "hi" in sentences.languages("हम इसे")


def test_thai_late_in_a_unit():
    thai = ["เราเก็บข้อมูลของท่านไว้หนึ่งปี", "หลังจากนั้นเราจะลบข้อมูลทั้งหมด"]
    text = "We keep the records of a visit, " * 10 + "and in Thai: " + " ".join(thai)
    assert [text[a:z] for a, z in sentences.sentences(text)][-1] == thai[1]


def test_shingles_and_words():
    h = word_hashes("A b, a B!")
    assert len(h) == 4 and h[0] == h[2] and h[1] == h[3]
    assert len(shingles(h, 3)) == 2 and len(shingles(h, 9)) == 0 and shingles(h, 2)[0] == shingles(h, 2)[2] and np.unique(shingles(h, 2)).size == 2


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    same(spark, queries.QUERIES, queries.SQL, name)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_whole(spark, name):
    assert queries.QUERIES[name](spark, BASE).count() > 0
