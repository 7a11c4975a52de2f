"""Problem 7: the ids of a public byte-level BPE vocabulary for every text.

Pre-tokenisation is vectorised and uses no regex: the texts of a batch become one array of code points, a table gives
each its class, and scans locate the boundaries. A position's transition function depends on its neighbours' classes
alone but for the runs, and "start of my run" is an associative scan (a running maximum over run starts), so the whole
batch is cut at once. The slices feed pair merging, whose results are cached; starts and ends are kept for decoding.

Cases: an empty or null text gives an empty list; strings that look like special tokens are ordinary text.
"""

import base64
import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.operators.cluster import arrow_map

NAME = "byte_bpe_50k"
LETTER, NUMBER, SPACE, OTHER, BREAK = 0, 1, 2, 3, 4
CACHE = 400_000  #: slices whose ids a worker keeps
#: What Unicode calls White_Space.
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def vocabulary(name: str = NAME) -> str:
    """Path of a public vocabulary's rank file."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(sys.maxunicode + 2, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[list(WHITE)] = SPACE
    table[-1] = BREAK
    return table


def boundaries(points: np.ndarray) -> np.ndarray:
    """Starts of the slices in an array of code points in which sys.maxunicode + 1 parts the texts.

    Runs of letters, numbers and other characters take one space before them; white space before a slice leaves it its
    last character; ``'s 't 're 've 'm 'll 'd`` are slices where an apostrophe follows no space.
    """
    size = len(points)
    if not size:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.ones(size, bool)
    first[1:] = kind[1:] != kind[:-1]
    first |= kind == BREAK
    where = np.arange(size)
    run = np.maximum.accumulate(np.where(first, where, 0))  # start of each position's run: an associative scan
    starts = first.copy()
    after = np.full(size + 1, BREAK, np.uint8)
    after[:size] = kind
    last_white = (kind == SPACE) & (after[1:] != SPACE)  # the last of a run of white space
    joined = last_white & (after[1:] != BREAK)  # something follows it
    starts |= joined  # it leaves the run
    plain = joined & (points == 0x20)
    starts[1:] &= ~plain[:-1]  # and, if a plain space, takes the run that follows
    # contractions
    quote = np.flatnonzero((points == 0x27) & first & (after[1:] == LETTER))
    if len(quote):
        quote = quote[starts[quote]]
        padded = np.concatenate([points, np.full(3, sys.maxunicode + 1, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        single = np.isin(one, [ord(x) for x in "stmd"])
        double = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        length = np.where(single, 2, np.where(double, 3, 0))
        quote, length = quote[length > 0], length[length > 0]
        starts[quote + 1] = False
        end = quote + length
        inside = end < size
        end, quote = end[inside], quote[inside]
        # what is left of the run of letters is a slice of its own
        rest = end[(kind[end] == LETTER) & (run[end] == quote + 1)]
        starts[rest] = True
    return np.flatnonzero(starts)


@functools.cache
def _merger(path: str):
    """bytes -> ids, by merging the pair of least rank again and again."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Cache(dict):
    """slice -> ids; forgets all when full."""

    def __init__(self, path: str):
        self.merge = _merger(path)

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= CACHE:
            self.clear()
        ids = self.merge(piece.encode())
        if len(piece) < 64:
            self[piece] = ids
        return ids


@functools.cache
def cache(path: str) -> Cache:
    return Cache(path)


def slices(texts: list[str]) -> list[list[int]]:
    """For each text, the starts of its slices and its length."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    points[ends] = sys.maxunicode + 1
    starts = boundaries(points)
    at = np.searchsorted(starts, ends)
    first = ends - lengths
    out, before = [], 0
    for k in range(len(texts)):
        out.append((starts[before : at[k] + 1] - first[k]).tolist())  # the last one is the break's place: the length
        before = at[k] + 1
    return out


def encode(texts: list[str], path: str) -> list[list[int]]:
    """The ids of each text."""
    known, out = cache(path), []
    for text, cut in zip(texts, slices(texts), strict=True):
        ids: list[int] = []
        for a, b in zip(cut, cut[1:]):
            ids += known[text[a:b]]
        out.append(ids)
    return out


def encoded(df: DataFrame, text: str, key: str, path: str | None = None) -> DataFrame:
    """``key`` (a bigint) and ids of every row of ``df``; path: the rank file of the vocabulary."""
    path = path or vocabulary()

    def run(batches):
        for b in batches:
            ids = encode([x or "" for x in b.column(1).to_pylist()], path)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], [key, "ids"])

    return arrow_map(df.select(key, text), run, f"`{key}` bigint, ids array<int>")


def slice_offsets(df: DataFrame, text: str, key: str, path: str | None = None) -> DataFrame:
    """``key``, starts (of each slice, in characters), n_ids (of each slice): with ids, what decodes any part of a text."""
    path = path or vocabulary()

    def run(batches):
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            cut, known = slices(texts), cache(path)
            counts = [[len(known[t[a:z]]) for a, z in zip(c, c[1:])] for t, c in zip(texts, cut, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c[:-1] for c in cut], pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], [key, "starts", "n_ids"])

    return arrow_map(df.select(key, text), run, f"`{key}` bigint, starts array<int>, n_ids array<int>")
