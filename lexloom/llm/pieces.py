"""Problem 1: texts over a size limit, cut into pieces at natural boundaries, with an overlap.

Balanced targets: the least number of pieces is computed, targets of equal length are placed, each is moved to the
strongest boundary near it, and a piece is added where a limit fails. Texts within the limit never reach Python.

Cases: a null or empty text has no pieces; a text without any boundary is cut between characters (never before a
combining mark); other columns of the input are left out, so names cannot clash; repeated rows give repeated pieces.
"""

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.cluster import arrow_map

LIMIT, OVERLAP = 9000, 300
#: Boundaries by strength; a cut falls after the match.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*")),
    ("line", re.compile(r"\n\s*")),
    ("sentence", re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？｡।؟۔][”’」』）]*\s*")),
    ("clause", re.compile(r"[;:,]\s+|[；，、：،]\s*")),
    ("word", re.compile(r"\s+")),
)
NEAR = 0.12  #: part of a piece's length by which a cut may leave its target
SCHEMA = "piece_no int, n_pieces int, start_pos int, end_pos int, cut string, piece string"


def _snap(text: str, target: int, low: int, high: int) -> tuple[int, str]:
    """The strongest boundary in [low, high], of equally strong ones the nearest to target."""
    window = text[low:high]
    for name, pattern in BOUNDARIES:
        best = min((low + m.end() for m in pattern.finditer(window)), key=lambda p: (abs(p - target), p), default=None)
        if best is not None and low < best <= high:
            return best, name
    at = min(max(target, low + 1), high)
    while at > low + 1 and (unicodedata.combining(text[at]) or unicodedata.category(text[at]) in ("Mc", "Me") or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at, "character"


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """Ends of the pieces, the last being the text's, with the sort of boundary each falls on.

    Piece k is text[end(k-1) - overlap : end(k)], so every piece but the first repeats the last ``overlap`` characters
    of the one before. ``0 <= overlap < limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    size, step = len(text), limit - overlap
    if size <= limit:
        return [(size, "end")]
    count = 1 + -(-(size - limit) // step)
    while True:
        ends: list[tuple[int, str]] = []
        at, fine = 0, True
        share = (size + overlap * (count - 1)) / count
        for k in range(1, count):
            target = round(share * k - overlap * (k - 1))
            most = at + (limit if k == 1 else step)
            least = max(at + 1, at + overlap + 1 if k == 1 else at + 1, size - step * (count - k))  # what is left must fit
            near = max(1, int(NEAR * share))
            low, high = max(least, target - near), min(most, target + near, size - 1)
            if low > high:
                low, high = least, min(most, size - 1)
            if low > high:
                fine = False
                break
            at, name = _snap(text, target, low - 1, high)
            ends.append((at, name))
        # a limit fails: no room, or no better boundary than a space for want of room
        if fine and (all(n in ("paragraph", "line", "sentence") for _, n in ends) or count > 1 + 2 * -(-(size - limit) // step)):
            return [*ends, (size, "end")]
        if fine and not any(p.search(text, max(0, e - 2 * overlap), e + 2 * overlap) for (e, n) in ends if n in ("clause", "word", "character") for _, p in BOUNDARIES[:3]):
            return [*ends, (size, "end")]
        count += 1


def pieces(df: DataFrame, text: str, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``keys`` and SCHEMA's columns: the pieces of ``text``, numbered from 1; positions count characters from 0."""
    base = df.where(F.length(text) > 0).select(*keys, F.col(text).alias("_text"), F.length(text).alias("_size"))
    one = F.lit(1)
    short = base.where(F.col("_size") <= limit).select(*keys, one.alias("piece_no"), one.alias("n_pieces"), F.lit(0).alias("start_pos"), F.col("_size").alias("end_pos"), F.lit("end").alias("cut"), F.col("_text").alias("piece"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keys).schema)

    def run(batches):
        for b in batches:
            rows, out = [], []
            for n, t in enumerate(b.column("_text").to_pylist()):
                ends, before = cuts(t, limit, overlap), 0
                for k, (end, name) in enumerate(ends, 1):
                    start = max(0, before - overlap) if k > 1 else 0
                    rows.append(n)
                    out.append((k, len(ends), start, end, name, t[start:end]))
                    before = end
            take = pa.array(rows, pa.int32())
            columns = [b.column(k).take(take) for k in keys]
            kinds = [pa.int32()] * 4 + [pa.string()] * 2
            columns += [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "piece_no", "n_pieces", "start_pos", "end_pos", "cut", "piece"])

    long = arrow_map(base.where(F.col("_size") > limit).select(*keys, "_text"), run, f"{schema}, {SCHEMA}")
    return short.unionByName(long)
