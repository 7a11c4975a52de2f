"""Problem 5: statistics of a text, and fixed rules that tell prose from lists, tables and junk.

All characters of a batch become one array of code points; a table gives each its class, and sums over lines and tokens
give the statistics. RULES are published fixed thresholds over them (number of words, mean word length, symbols by words,
bullets, ellipses and closing punctuation by lines, words with letters, common words, broken characters). Each that a text
breaks is recorded. The rules are made for long web pages in English, so that very short prose and prose without spaces break
some, and a long list with closing marks breaks none: what a text is, the mass of its lines by kind decides, and is recorded
in the same way. The lines of every text are judged.

Cases: a null or empty text is no case and has zeros; texts of any length are treated whole.
"""

import functools
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.mainbody import main_text
from lexloom.operators.cluster import arrow_map

#: Character classes.
SPACE, LETTER, DIGIT, STOP, OTHER_PUNCT, SYMBOL, WIDE, BAD, SEPARATOR, UPPER = range(10)
STOPS = ".!?…。！？｡।॥؟۔"
_BULLET = re.compile(r"\s*(?:[-*+•·‣◦▪–—]\s|\(?\d{1,3}[.)]\s|\(?[A-Za-z][.)]\s)")
#: Items in one line: marks between them; numbers in front; nothing but commas, strokes or semicolons.
_INLINE = re.compile(r"[•·‣◦▪]|(?:^|[\s;,/])[*-](?=\s)")
_NUMBERED = re.compile(r"(?:^|[\s;,/•])\(?(?:\d{1,3}|[a-z])[.)](?=\s)")
_PARTS = re.compile(r"(?<!\d),|,(?!\d)|[;/|•·、，；]")
#: Letters that do not follow each other in words.
_IMPLAUSIBLE = re.compile(r"q[^uaie]|[bcdfghjklmnpqrstvwxz]{5}|[jvwxz][bcdfgjkmpqtvxz]|[bcdfgkpt][jqxv]|x[bdfgjkmnrsvwz]|[aeiouy]{5}")
_NOISE = re.compile(r"[^\W\d_][!;:|^~*_][^\W\d_]|(?:^|\s)[!;:|^~*_][^\W\d_]|[!;:|^~*_]{2}")
_WORDS = re.compile(r"[^\W_]+")
_MOJIBAKE = re.compile(r"Ã.|Â.|â€.|ï¿½|ðŸ|�|[À-ÿ][\x80-\xbf]")
_CODE = re.compile(r"[{};]\s*$|^\s*[{}]|=>|\w\(.*\)\s*[{;]|\b(?:function|var|const|let|return|window|document|null|undefined|import|def|class|public|void)\b[ .(=]|</?[a-z]+[^>]*>|&[a-z]+;|\w+:\s*[\w#-]+;|[=!]==?|\|\||&&")
_COLUMNS = re.compile(r"\s*\|\s*|\t+|\s*;\s*|\s{3,}|\s+,\s+")
NAMES = ("n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "stop_line_share", "bullet_line_share", "table_line_share", "common_word_share", "junk_share", "prose_share", "n_common_words", "symbol_word_ratio", "ellipsis_line_share", "letter_word_share", "marked_line_share", "broken_share")

#: Reason, statistic, least and most value: of Gopher (Rae et al. 2021, table A1); few_closing_marks of FineWeb (Penedo et al. 2024);
#: broken_characters, a replacement character anywhere, is none of a paper's.
RULES = (
    ("few_words", "n_words", 50, None),
    ("many_words", "n_words", None, 100_000),
    ("short_words", "mean_word_length", 3, None),
    ("long_words", "mean_word_length", None, 10),
    ("symbols", "symbol_word_ratio", None, 0.1),
    ("bullet_lines", "marked_line_share", None, 0.9),
    ("ellipsis_lines", "ellipsis_line_share", None, 0.3),
    ("words_without_letters", "letter_word_share", 0.8, None),
    ("few_common_words", "n_common_words", 2, None),
    ("few_closing_marks", "stop_line_share", 0.12, None),
    ("broken_characters", "broken_share", None, 0.0),
)


@functools.cache
def classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, SYMBOL, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LM":
            table[c] = UPPER if kind == "Lu" else LETTER
        elif kind[0] == "N":
            table[c] = DIGIT
        elif kind[0] == "Z" or c in (9, 10, 13):
            table[c] = SPACE
        elif kind[0] == "P":
            table[c] = OTHER_PUNCT
        elif kind in ("Cc", "Cn", "Co", "Cs") or c == 0xFFFD:
            table[c] = BAD
    for a, z in ((0x0E00, 0x0E7F), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
        part = table[a : z + 1]
        part[part == LETTER] = WIDE
    for c in STOPS:
        table[ord(c)] = STOP
    for c in "|\t;":
        table[ord(c)] = SEPARATOR
    return table


def line_counts(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line, its characters by class, an array of (lines, 10); what stands between its spaces; and how many of these have a letter."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes()[points]
    line = np.repeat(np.arange(len(lines), dtype=np.int32), lengths)
    counts = np.bincount(line * 10 + kinds, minlength=10 * len(lines)).reshape(-1, 10)
    if not len(points):
        return counts, np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
    space = kinds == SPACE
    new = ~space  # the first character of a token
    new[1:] &= space[:-1] | (line[1:] != line[:-1])
    token = np.cumsum(new) - 1
    letter = (kinds == LETTER) | (kinds == UPPER) | (kinds == WIDE)
    lettered = np.zeros(int(token[-1]) + 1, bool)
    lettered[token[letter]] = True
    of = line[new]
    return counts, np.bincount(of, minlength=len(lines)), np.bincount(of[lettered], minlength=len(lines))


PROSE, LIST, TABLE, JUNK, HEAD = "prose", "list", "table", "junk", "heading"


def _cells(line: str) -> int:
    return len([x for x in _COLUMNS.split(line.strip().strip("|")) if x.strip()])


def line_kind(line: str, n: np.ndarray, common: frozenset[str]) -> str:
    """What one line is, from its counts and, where those leave it open, its text."""
    letters, digits, wide = int(n[LETTER] + n[UPPER]), int(n[DIGIT]), int(n[WIDE])
    marks, bad = int(n[SYMBOL] + n[OTHER_PUNCT] + n[SEPARATOR]), int(n[BAD])
    seen = letters + digits + wide + marks + bad + int(n[STOP])
    if not seen:
        return HEAD
    bare = line.strip()
    ended = bare.rstrip("\"'”’»)]*_ ")[-1:] in STOPS and (letters or wide)
    if ended and not bad and marks <= 0.08 * seen and n[SYMBOL] <= 0.01 * seen and (bare[0].isalpha() or bare[0] in "“„«「(\"") and "   " not in bare and letters + wide > 0.7 * seen and not (_BULLET.match(line) or "•" in bare):
        return PROSE
    words = bare.split()
    if bad > 0.02 * seen or bad + int(n[SYMBOL]) > 1 and len(_MOJIBAKE.findall(bare)) > 0.02 * len(bare) + 1:
        return JUNK  # broken characters
    if len(bare) > 40:
        long = sum(len(w) for w in words if len(w) > 40 and not w.startswith(("http", "www.")))
        if long > 0.5 * seen and not wide and _encoded(bare):
            return JUNK
        if letters + wide + digits < 0.55 * seen and letters + wide < 0.3 * seen and marks > 0.35 * seen and not _COLUMNS.search(bare):
            return JUNK  # ornaments
    if seen > 20 and marks > 0.1 * seen and not wide:
        if marks > 0.14 * seen and (len(_CODE.findall(bare)) >= 2 or _CODE.search(bare) and marks > 0.2 * seen):
            return JUNK
        noise = _NOISE.findall(bare)
        if len(noise) > 0.25 * len(words) and len({x for y in noise for x in y if not x.isalnum() and not x.isspace()}) > 2:
            return JUNK
    if letters > 24 and not wide and len(words) > 4 and letters > 0.6 * seen:
        plain = [w for w in _WORDS.findall(bare.lower()) if len(w) > 3 and w.isascii()]
        if len(plain) > 4 and sum(1 for w in plain if _IMPLAUSIBLE.search(w)) > 0.3 * len(plain) and sum(w in common for w in bare.lower().split()) < 0.08 * len(words):
            return JUNK
    if len(bare) > 24 and not wide and _mixed(words):
        return JUNK
    cells = _cells(bare) if (n[SEPARATOR] or "   " in bare or " , " in bare) else 1
    if cells >= 3 and len(bare) / cells < 32 and not (ended and n[STOP] > 1 and letters > 0.75 * seen):
        return TABLE
    if not ended or n[STOP] < 3:
        marked = len(_INLINE.findall(bare))
        if marked >= 3 and len(bare) / marked < 70 or len(_NUMBERED.findall(bare)) >= 3 and _NUMBERED.match(bare):
            return LIST
    if _BULLET.match(line):
        return LIST
    if not ended and len(bare) > 50:
        parts = [x for x in _PARTS.split(bare) if x.strip()]
        if len(parts) >= 6 and (len(words) <= 3.6 * len(parts) and not wide or wide and len(bare) <= 16 * len(parts)):
            return LIST
    if wide >= 0.3 * seen:
        return PROSE if ended or wide > 24 else HEAD
    if ended:
        return PROSE
    return PROSE if len(words) >= 12 and letters > 0.7 * seen else HEAD


def _encoded(bare: str) -> bool:
    return bool(re.search(r"\d", bare)) or len(bare) > 120


def _mixed(words: list[str]) -> bool:
    """Strings of letters and digits in turn, as encoded data has them."""
    odd = sum(1 for w in words if len(w) > 7 and re.search(r"[A-Za-z]\d+[A-Za-z]|\d[A-Za-z]+\d", w) and "." not in w)
    return odd > 0.4 * len(words)


def statistics(text: str, common: frozenset[str]) -> tuple[tuple, str, str]:
    """(the values of NAMES, the kind of text, the rules it breaks) of one text."""
    return batch_statistics([text], common)[0]


def batch_statistics(texts: list[str], common: frozenset[str]) -> list[tuple[tuple, str, str]]:
    split = [[x for x in t.split("\n") if x and not x.isspace()] for t in texts]
    flat = [x for lines in split for x in lines]
    counts, tokens, lettered = line_counts(flat)
    out, at = [], 0
    for text, lines in zip(texts, split, strict=True):
        z = at + len(lines)
        out.append(_judge(text, lines, counts[at:z], int(tokens[at:z].sum()), int(lettered[at:z].sum()), common))
        at = z
    return out


def _judge(text: str, lines: list[str], n: np.ndarray, tokens: int, lettered: int, common: frozenset[str]) -> tuple[tuple, str, str]:
    if not lines:
        return ((len(text), 0, 0, *[0.0] * 9, 0, *[0.0] * 5), PROSE, "")
    total = n.sum(0)
    words = _WORDS.findall(text.lower())
    letters = int(total[LETTER] + total[UPPER] + total[WIDE] + total[DIGIT])
    counted = len(lines)
    stop = sum(x.rstrip().rstrip("\"'”’»)]")[-1:] in STOPS for x in lines)
    seen = max(1, int(total.sum() - total[SPACE]))
    usual = sum(map(common.__contains__, words))
    marked = sum(_BULLET.match(x) is not None for x in lines) / counted
    measured = {
        "n_chars": len(text), "n_words": len(words), "n_lines": counted, "mean_word_length": letters / max(1, len(words)), "symbol_ratio": float(total[SYMBOL] + total[SEPARATOR] + total[BAD]) / seen, "digit_ratio": float(total[DIGIT]) / seen,
        "stop_line_share": stop / counted, "common_word_share": usual / max(1, len(words)), "n_common_words": usual, "symbol_word_ratio": (text.count("#") + text.count("...") + text.count("…")) / max(1, len(words)),
        "ellipsis_line_share": sum(x.rstrip().endswith(("...", "…")) for x in lines) / counted, "letter_word_share": lettered / max(1, tokens), "marked_line_share": marked, "broken_share": text.count("\ufffd") / seen,
    }
    reasons = broken(measured)
    mass = {PROSE: 0, LIST: 0, TABLE: 0, JUNK: 0, HEAD: 0}
    run = _plain_run(lines, [line_kind(x, c, common) for x, c in zip(lines, n, strict=True)])
    for x, kind in zip(lines, run, strict=True):
        mass[kind] += len(x.strip())
    weight = max(1, sum(mass.values()))
    measured |= {"bullet_line_share": run.count(LIST) / counted, "table_line_share": run.count(TABLE) / counted, "junk_share": mass[JUNK] / weight, "prose_share": mass[PROSE] / weight}
    body = max(1, weight - mass[HEAD])
    found = [f"{kind}_lines" for kind in (JUNK, TABLE, LIST) if mass[kind] > 0.5 * body]
    if not found and mass[LIST] + mass[TABLE] + mass[JUNK] > 0.6 * body:
        found.append("no_prose")
    kind = PROSE if not found else LIST if found[0] == "no_prose" else found[0].removesuffix("_lines")
    return tuple(measured[x] for x in NAMES), kind, ",".join(reasons + found)


def broken(named: dict) -> list[str]:
    """The RULES that the statistics ``named`` break."""
    return [reason for reason, name, least, most in RULES if least is not None and named[name] < least or most is not None and named[name] > most]


def _plain_run(lines: list[str], kinds: list[str]) -> list[str]:
    """Headings in a row are the items of a list without marks; between other items they are items."""
    out = list(kinds)
    k = 0
    while k < len(kinds):
        if kinds[k] != HEAD:
            k += 1
            continue
        z = k
        while z < len(kinds) and kinds[z] == HEAD:
            z += 1
        if z - k >= 4 or z - k >= 2 and (k and kinds[k - 1] in (LIST, TABLE) and z < len(kinds) and kinds[z] in (LIST, TABLE)):
            for j in range(k, z):
                out[j] = LIST
        k = z
    return out


SCHEMA = "tbl string, row_id bigint, " + ", ".join(f"{x} {'bigint' if x.startswith('n_') else 'double'}" for x in NAMES) + ", kind string, reasons string"


def quality(df: DataFrame, common: frozenset[str], body: bool) -> DataFrame:
    """SCHEMA's columns for each row of ``df`` (tbl, row_id, text); body: whether the text is a page whose main body counts."""

    def run(batches):
        for b in batches:
            texts = [x or "" for x in b.column(2).to_pylist()]
            if body:
                texts = [main_text(x) for x in texts]
            got = batch_statistics(texts, common)
            columns = [b.column(0), b.column(1)]
            columns += [pa.array([g[0][i] for g in got], pa.int64() if x.startswith("n_") else pa.float64()) for i, x in enumerate(NAMES)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], ["tbl", "row_id", *NAMES, "kind", "reasons"])

    return arrow_map(df.select("tbl", "row_id", "text"), run, SCHEMA)


def without(found: DataFrame, named: DataFrame) -> DataFrame:
    """``found`` (SCHEMA), where the rows of ``named`` (tbl, row_id) that are no prose have the kind 'residue' instead."""
    marked = found.join(named.withColumn("named", F.lit(True)), ["tbl", "row_id"], "left")
    return marked.withColumn("kind", F.when(F.col("named") & (F.col("kind") != PROSE), "residue").otherwise(F.col("kind"))).drop("named")
