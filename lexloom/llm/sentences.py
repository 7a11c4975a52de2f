"""Problem 9: the sentences of texts in any script.

A text is first cut into units: a blank line ends one, and so does any line break that is not the wrapping of a
paragraph (a wrapped line is one to which the next line's first word could not have been added). Inside a unit the
standard sentence-break properties decide: a terminator, its closing quotes and brackets, white space. A full stop is
suppressed after abbreviations (those of all languages, less the words of the languages a text is in), initials and ordinals, and before a lower-case continuation; a terminator
inside quotation marks ends nothing where the sentence goes on after them. Thai, which has no terminator, is cut at the
spaces between clauses.

Cases: null, empty and blank texts have no rows; a unit without a terminator is one sentence; positions count code
points from 0; repeated rows give repeated results.
"""

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.operators.cluster import arrow_map

#: Terminators that end a sentence wherever they stand (property STerm but for ! and ?).
STERM = "։؟۔।॥၊။።፧፨᙮᠃᠉᥄᥅᭚᭛᭞᭟᰻᰼᱾᱿‼‽⁇⁈⁉⸮。꓿꘎꘏꛳꛷꡶꡷꣎꣏꩝꩞꩟꫰꫱꯫﹒﹖﹗！？｡"
CLOSE = "\"'”’»›)]}」』）】〉》｣"
#: By language: abbreviations after which a sentence goes on, whatever follows; and those after which it goes on before a number.
ABBREVIATIONS = {
    "en": ("dr mr mrs ms prof st sr jr. rev gen hon pres gov capt lt vs e.g i.e cf viz approx incl resp", "no nos fig figs sec secs art arts ch chap vol p pp para pars par cl s ss ed eq ref tab annex app n"),
    "de": ("dr prof st hr fr frau herr z.b d.h u.a o.ä bzw ggf vgl bspw sog usw.u ca inkl exkl zzgl resp", "nr nrn art abs ziff kap s lit tab anl n"),
    "fr": ("dr m mm mme mlle st p.ex c.-à-d env cf resp incl ca", "no nos art arts al p pp par chap fig s n"),
    "es": ("dr dra sr sra srta prof st p.ej p.ex ee aprox cf vs ca", "núm no nos art arts pág págs pag párr cap fig s p pp n"),
    "hi": ("डॉ श्री सुश्री", ""),
    "ar": ("د أ م", ""),
}
#: Words by which a text's languages are told. Fixed values.
COMMON = {
    "en": "the of and to is for with by our are not which will", "de": "der die das und für nicht mit von wir ist auf eine des", "fr": "le la les des et du une nous pour dans est pas par", "es": "el los las y de una nosotros para con por que del se",
}
_COMMON = {lang: frozenset(words.split()) for lang, words in COMMON.items()}
_SCRIPTS = (("hi", re.compile("[\u0900-\u097f]")), ("ar", re.compile("[\u0600-\u06ff]")))
LEAST_PART = 0.2  #: of the commonest language's hits that another must have to count as one of a text's


#: Abbreviations of one language that are words of another: where a text has that other and not the first, they are words.
WORDS_OF = {"en": "al cap art par no env tab app gen ee s", "de": "al cap no par para env ch app", "fr": "al no para cl sr st hon app", "es": "para par no al cl ch gen hon st env app"}


@lru_cache(maxsize=256)
def abbreviations(languages: tuple[str, ...]) -> tuple[frozenset[str], frozenset[str]]:
    """(abbreviations before anything, before numbers) for a text in some languages: those of all languages, as a text may quote any,
    but for the ones that are words of one of its languages and abbreviations of none of them."""
    out = []
    for k in (0, 1):
        own = {w for x in languages for w in ABBREVIATIONS[x][k].split()}
        words = {w for x in languages for w in WORDS_OF.get(x, "").split()} - own
        out.append(frozenset(w for x in ABBREVIATIONS.values() for w in x[k].split()) - words)
    return out[0], out[1]


def languages(text: str) -> tuple[str, ...]:
    """The languages of a text that have abbreviations: by its common words and scripts, since a column that names one may be wrong; none for no sign of any."""
    counts = Counter(text.lower().split())
    hits = {lang: sum(counts[w] for w in words) for lang, words in _COMMON.items()}
    most = max(hits.values())
    found = [lang for lang, n in hits.items() if n and n >= LEAST_PART * most]
    return tuple(found + [lang for lang, script in _SCRIPTS if script.search(text)])


#: Abbreviations that may end a sentence: it goes on before a lower-case letter only, or before one of the listed words.
FIRM = {"co": ("kg", "kgaa", "ohg", "inc", "ltd"), "inc": (), "ltd": (), "corp": (), "etc": (), "a.m": (), "p.m": (), "u.s": (), "u.k": (), "usw": ()}
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
REPORT = re.compile(r"[^。！？!?]{0,40}?(?:说|道|称|表示|指出|问|写|回答|补充|解释|説明|述べ|言|語|尋ね|答え|書)")

_CAND = re.compile(rf"[.!?…{STERM}．]+")
_AFTER = re.compile(rf"[{re.escape(CLOSE)}]*(?:[^\S\n]?[»›][{re.escape(CLOSE)}]*)?")
_WORD_BEFORE = re.compile(r"[^\s(\[{“„«\"'’」「—–/]+\Z")
_LIST = re.compile(r"\s*(?:[-*+•·‣◦▪–—]\s|\(?\d{1,3}[.)]\s|\(?[A-Za-z][)]\s)")
_BULLET = re.compile(r"\s*[-*+•·‣◦▪]\s")
_MARK = re.compile(r"\s*\(?(?:\d{1,3}(?:\.\d{1,3})*|[A-Za-z])\.(?=\s)")
_THAI = re.compile("[\u0e00-\u0e7f]")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[^\S\n]*\n?[^\S\n]+(?=[฀-๿])|(?<=[฀-๿])\n(?=[฀-๿])")
_FIRST_LETTER = re.compile(r"[^\W\d_]")
_QUOTES = re.compile(r"[“”„«»「」『』\"]")
_NEXT = re.compile(r"\S")
WIDEST_WRAP, LEAST_WRAP = 120, 35


def _wide(c: str) -> bool:
    return "ก" <= c <= "๿" or "぀" <= c <= "鿿" or "가" <= c <= "힣" or "＀" <= c <= "￯"


def _first_word(line: str) -> int:
    """Length of what a wrapping would have moved up first."""
    if not line:
        return 0
    return 1 if _wide(line[0]) else len(line.split(None, 1)[0])


def _continues(before: str, line: str) -> bool:
    """Whether a line goes on with what the one before left open: it starts in lower case, and that has no end."""
    return line[0].islower() and not line[1:2].isupper() and before[-1] not in ".!?:;" and len(before) >= LEAST_WRAP // 2


def units(text: str) -> list[tuple[int, int]]:
    """[start, end) of the units of a text, white space included."""
    blocks: list[list[tuple[int, int, str]]] = [[]]  # lines with places, by block
    at = 0
    for line in text.split("\n"):
        bare = line.strip()
        if bare:
            blocks[-1].append((at, at + len(line), bare))
        elif blocks[-1]:
            blocks.append([])
        at += len(line) + 1
    facts, flows, wrapped_doc = [], [], False
    for block in blocks:
        if len(block) < 2:
            facts.append((False, 0))
            flows.append(False)
            continue
        low = max(len(x[2]) for x in block)
        fits = [len(a[2]) + 1 + _first_word(b[2]) for a, b in zip(block, block[1:])]
        same = LEAST_WRAP <= low <= WIDEST_WRAP and low < min(fits) and not any(_BULLET.match(x[2]) for x in block[1:])
        facts.append((same, low))
        wrapped_doc |= same and len(block) > 2
        flows.append(any(_continues(a[2], b[2]) for a, b in zip(block, block[1:])))
    out: list[tuple[int, int]] = []
    for block, (same, low), flow in zip(blocks, facts, flows, strict=True):
        for k, (a, z, bare) in enumerate(block):
            join = False
            if k and not _BULLET.match(bare):
                before = block[k - 1][2]
                full = LEAST_WRAP <= low <= WIDEST_WRAP and len(before) >= LEAST_WRAP and len(before) + 1 + _first_word(bare) > 0.85 * low
                join = same or _continues(before, bare) or (flow or wrapped_doc) and full and not _LIST.match(bare)
            if join:
                out[-1] = (out[-1][0], z)
            else:
                out.append((a, z))
    return out


def _quoted(text: str) -> list[tuple[int, int]]:
    """Places of matched quotations, in order; one inside another is part of it."""
    found, stack = [], []
    for m in _QUOTES.finditer(text):
        c, i = m.group(), m.start()
        if c in "„«「『":
            stack.append((c, i))
        elif c == "“":
            if stack and stack[-1][0] == "„":
                found.append((stack.pop()[1], i))
            else:
                stack.append((c, i))
        elif c == '"':
            if stack and stack[-1][0] == '"':
                found.append((stack.pop()[1], i))
            else:
                stack.append((c, i))
        else:
            opener = {"”": "“„", "»": "«", "」": "「", "』": "『"}[c]
            while stack and stack[-1][0] not in opener:
                stack.pop()
            if stack:
                found.append((stack.pop()[1], i))
    outer: list[tuple[int, int]] = []
    for a, z in sorted(found):
        if not outer or a > outer[-1][1]:
            outer.append((a, z))
    return outer


def _lower_next(text: str, at: int) -> bool:
    """Whether the next letter from ``at`` on is a lower-case one that starts no capitalised name (iName)."""
    m = _FIRST_LETTER.search(text, at)
    if not m:
        return False
    c, i = m.group(), m.start()
    return c.islower() and not text[i + 1 : i + 2].isupper()


_WORD_AT = re.compile(r"\w*")


def _next(text: str, at: int) -> int:
    """The place of the next character from ``at`` on that is no white space."""
    m = _NEXT.search(text, at)
    return m.start() if m else len(text)


def _char(text: str, at: int) -> str:
    n = _next(text, at)
    return text[n : n + 1]


def _word_before(text: str, at: int) -> re.Match | None:
    """The word that ends at a place: back to white space, an opening mark or a dash."""
    k = at
    while k and not text[k - 1].isspace():
        k -= 1
    return _WORD_BEFORE.search(text[k:at])


def _ends(text: str, quotes: list[tuple[int, int]], always: frozenset[str], before_number: frozenset[str]) -> list[int]:
    """Places after the sentences' last characters in a unit, without its end."""
    out, size = [], len(text)
    mark = _MARK.match(text)
    skip = mark.end() if mark else 0
    for m in _CAND.finditer(text):
        i, j = m.span()
        if j <= skip:
            continue
        signs = m.group()
        end = _AFTER.match(text, j).end()
        if end >= size:
            break
        inside = None
        if quotes:  # the last that begins before
            k = bisect_left(quotes, (i, 0)) - 1
            if k >= 0 and i < quotes[k][1]:
                inside = quotes[k]
        if inside and end <= inside[1]:
            continue  # the quotation goes on
        following = text[end]
        space = following.isspace()
        hard = any(c in STERM for c in signs)
        if inside:
            # the terminator closes a quotation; the sentence ends with it unless it goes on
            n = _next(text, end)
            rest = text[n : n + 1]
            if not rest or rest[0] in ",;:，、；：" or rest[0] in "とって" or rest[0] == "—":
                continue
            if _wide(rest[0]) or hard:
                if REPORT.match(text, n):
                    continue
            elif _lower_next(text, end):
                continue
            elif not space:
                continue
            out.append(end)
            continue
        if hard:
            if following in ",;，、；":
                continue
            out.append(end)
            continue
        if "!" in signs or "?" in signs:
            if space or _wide(following) or following in "“„«「":
                if not (_char(text, end) in ",;"):
                    out.append(end)
            continue
        # full stops
        if not space:
            left = text[max(0, i - 2) : i]
            if len(signs) == 1 and end == j and following.isupper() and text[j + 1 : j + 2].islower() and len(left) == 2 and left.islower() and left.isalpha():
                w = _word_before(text, i)
                if w and not any(c in w.group() for c in "@/."):
                    out.append(end)
            elif end > j and following in "“„«「(" or _wide(following) and not text[i - 1 : i].isdigit():
                out.append(end)
            continue
        if _lower_next(text, end):
            continue
        if len(signs) == 1 and end == j:
            w = _word_before(text, i)
            word = w.group().lower() if w else ""
            n = _next(text, end)
            after, following_word = text[n : n + 1], _WORD_AT.match(text, n).group()
            if word in always:
                continue
            letters = word.rsplit(".", 1)[-1].rsplit("'", 1)[-1].rsplit("’", 1)[-1]
            if letters in before_number and (after.isdigit() or after.isupper() and len(following_word) == 1):
                continue
            if len(letters) == 1 and letters.isalpha() and word not in FIRM and not _wide(letters):
                continue  # an initial
            if word in FIRM:
                if following_word.lower() in FIRM[word]:
                    continue
            elif word.isdigit() and len(word) <= 2 and following_word.lower() in MONTHS:
                continue
        out.append(end)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """[start, end) of the sentences of a text, in code points, without white space at either end."""
    out: list[tuple[int, int]] = []
    always, before_number = abbreviations(languages(text))
    for a, z in units(text):
        unit = text[a:z]
        ends = _ends(unit, _quoted(unit) if _QUOTES.search(unit) else [], always, before_number)
        if _THAI.search(unit):
            gaps = [m.start() for m in _THAI_GAP.finditer(unit)]
            if gaps:
                ends = sorted({*ends, *_thai(unit, gaps)})
        before = 0
        for end in [*ends, len(unit)]:
            piece = unit[before:end]
            bare = piece.strip()
            if bare:
                start = a + before + len(piece) - len(piece.lstrip())
                if out and out[-1][1] > a and not any(c.isalnum() for c in bare) and all(unicodedata.category(c)[0] in "PSM" or c.isspace() for c in bare) and len(bare) <= 2 and bare in CLOSE:
                    out[-1] = (out[-1][0], start + len(bare))  # a stray closing mark
                else:
                    out.append((start, start + len(bare)))
            before = end
    return out


def _thai(unit: str, gaps: list[int]) -> list[int]:
    """The gaps that part clauses: both sides are long enough to be one."""
    kept, before = [], 0
    for k, g in enumerate(gaps):
        after = gaps[k + 1] if k + 1 < len(gaps) else len(unit)
        if g - before >= 8 and after - g >= 8:
            kept.append(g)
            before = g
    return kept


def sentence_spans(df: DataFrame, text: str, key: str) -> DataFrame:
    """``key`` (a bigint), start_pos, end_pos of every sentence of ``text``."""

    def run(batches):
        for b in batches:
            rows, starts, ends = [], [], []
            for n, t in enumerate(b.column(1).to_pylist()):
                if t:
                    for a, z in sentences(t):
                        rows.append(n)
                        starts.append(a)
                        ends.append(z)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [key, "start_pos", "end_pos"])

    return arrow_map(df.select(key, text), run, f"`{key}` bigint, start_pos int, end_pos int")
