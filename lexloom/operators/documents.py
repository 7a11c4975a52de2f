"""Documents and clauses that say the same: exact copies, near copies, excerpts inside longer ones."""

import difflib
import functools
import math
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import text as t
from lexloom.functions import urls
from lexloom.operators.cluster import arrow_map, durable
from lexloom.operators.graph import components
from lexloom.operators.pairs import first_of, meet

SHORT, RATIO, ALIKE = 1000, 0.90, 0.96
SEQUENCE = 5  #: characters of the sequences that bound a ratio from above
#: Products of lengths up to which the longest common subsequence, which bounds the ratio closer, takes less time than the ratio.
BOUNDED = 20_000**2
BANDS, ROWS, SHINGLE = 16, 2, 3
LEAST_CONTAINED, GRAM = 80, 6


_TOKEN = re.compile(r"[a-z0-9]+|\s|[^\sa-z0-9]")


#: Products of lengths up to which two ranges are matched by ``difflib``.
DIRECT = 20_000


def _longest(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """i, j, n of the longest block of ``a`` that stands in ``b`` too, the first in ``a`` and then in ``b`` of equal ones; then of those
    of its length the next beyond it in both, and so on: what lies between them has shorter ones only. None is longer than ``most``.

    ``a``, ``b``: 64-bit hashes. A block has its beginnings, so its length is found by halving, with a hash of each window."""

    def windows(sums: np.ndarray, n: int) -> np.ndarray:
        return sums[n:] - sums[:-n] * powers[n]

    powers = np.full(min(len(a), len(b), most) + 1, _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = [_rolled(a), _rolled(b)]
    low, high, found = 0, len(powers) - 1, None
    while low < high:
        n = (low + high + 1) // 2
        x, y = (windows(s, n) for s in sums)
        shared = np.isin(x, y, kind="sort")
        if shared.any():
            low, found = n, (x, y, shared)
        else:
            high = n - 1
    if not found:
        return []
    x, y, shared = found
    places, order = np.flatnonzero(shared), np.argsort(y, kind="stable")
    begin, end = (np.searchsorted(y[order], x[places], side).tolist() for side in ("left", "right"))
    out, at, k = [], 0, 0
    while at < len(places) and k <= len(y):
        # the places in ``b`` of one window ascend
        if order[end[at] - 1] < k:
            at += 1
            continue
        same = order[begin[at] : end[at]]
        i, j = int(places[at]), int(same[np.searchsorted(same, k)])
        out.append((i, j, low))
        at, k = int(np.searchsorted(places, i + low)), j + low
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rolled(x: np.ndarray) -> np.ndarray:
    """sums[k + 1] = sums[k] * _BASE + x[k], modulo 2 ** 64, in steps that double."""
    out, factor, step = x.copy(), int(_BASE), 1
    while step < len(out):
        out[step:] = out[step:] + out[:-step] * np.uint64(factor)
        factor, step = factor * factor % 2**64, 2 * step
    return np.concatenate([np.zeros(1, np.uint64), out])


def matching_blocks(p: list[str] | str, q: list[str] | str) -> list[tuple[int, int, int]]:
    """``difflib.SequenceMatcher(None, p, q, autojunk=False).get_matching_blocks()``, adjacent blocks left apart, in time that does not
    grow with the product of the lengths."""
    if len(p) * len(q) <= DIRECT:
        return difflib.SequenceMatcher(None, p, q, autojunk=False).get_matching_blocks()[:-1]
    a, b = (np.fromiter((xxhash.xxh3_64_intdigest(x) for x in s), np.uint64, len(s)) for s in (p, q))
    out, open_ = [], [(0, len(p), 0, len(q), len(p))]
    while open_:
        i, j, k, z, most = open_.pop()
        if (j - i) * (z - k) <= DIRECT:
            out += [(i + x, k + y, n) for x, y, n in difflib.SequenceMatcher(None, p[i:j], q[k:z], autojunk=False).get_matching_blocks()[:-1]]
            continue
        found = [(i + x, k + y, n) for x, y, n in _longest(a[i:j], b[k:z], most)]
        out += found
        for x, y, n in [*found, (j, z, 0)] if found else []:
            if i < x and k < y:
                open_.append((i, x, k, y, found[0][2] - 1))
            i, k = x + n, y + n
    return sorted(out)


def matching_ratio(a: str, b: str) -> float:
    """Twice the characters of matching blocks by all characters, as a sequence matcher counts them: blocks of tokens first, then
    characters within what is left between them, which keeps a comparison of long texts from growing with their square."""
    p, q = _TOKEN.findall(a), _TOKEN.findall(b)
    same = i = k = 0
    for j, z, n in [*matching_blocks(p, q), (len(p), len(q), 0)]:
        if i < j and k < z:
            same += sum(m for _, _, m in matching_blocks("".join(p[i:j]), "".join(q[k:z])))
        same += sum(map(len, p[j : j + n]))
        i, k = j + n, z + n
    return 2 * same / max(1, len(a) + len(b))


def subsequence(a: str, b: str, least: float = 0) -> int:
    """The length of the longest common subsequence of characters, by bits of one number for all of ``a``; or, once it is sure to be under ``least``, -1."""
    head = len(os.path.commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    places = _places(a)
    full = (1 << len(a)) - 1
    left = full
    need = math.ceil(least - 1e-6) - head - tail
    for t, c in enumerate(b):
        # what reaches ``need`` has matched the first t characters within the first t + len(a) - need of ``a``
        if t % 256 == 255 and need > 0:
            reach = min(len(a), max(0, t + len(a) - need))
            if reach - (left & ((1 << reach) - 1)).bit_count() + len(b) - t < need:
                return -1
        if at := places.get(c):
            hit = left & at
            left = (left + hit | left - hit) & full
    return head + tail + len(a) - left.bit_count()


def _places(a: str) -> dict[str, int]:
    """For each character of ``a`` a number with a bit at each of its places."""
    points = _points(a)
    return {chr(c): int.from_bytes(np.packbits(points == c, bitorder="little").tobytes(), "little") for c in np.unique(points)}


def _points(x: str) -> np.ndarray:
    return np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)


def sequences_allow(a: str, b: str, least: float) -> bool:
    """Whether common sequences of SEQUENCE characters leave room for a common subsequence of ``least``; False is certain.

    A character of ``a`` outside of it ends at most SEQUENCE of the sequences of ``a``, one of ``b`` parts at most one less. Sequences are
    counted by hash, and those that fall together only add to what is common."""
    size = min(1 << (4 * max(len(a), len(b))).bit_length(), 1 << 22)
    counts = []
    for x in map(_points, (a, b)):
        n = max(0, len(x) - SEQUENCE + 1)
        h = np.zeros(n, np.uint64)
        for k in range(SEQUENCE):
            h = h * _BASE + x[k : k + n]
        counts.append(np.bincount((_mixed(h) & np.uint64(size - 1)).astype(np.int64), minlength=size))
    m = math.ceil(least - 1e-6)
    out_a, out_b = len(a) - m, len(b) - m
    need = max(len(a) - SEQUENCE * out_a - (SEQUENCE - 1) * out_b, len(b) - SEQUENCE * out_b - (SEQUENCE - 1) * out_a) - SEQUENCE + 1
    return out_a >= 0 and out_b >= 0 and int(np.minimum(*counts).sum()) >= need


def similar(a: str, b: str) -> bool:
    """Whether two normal forms (``undated``) are of one document: equal if the shorter has under SHORT characters, else of about
    one length and, over all of both, of a matching ratio of ALIKE."""
    if not a or not b:
        return False
    if a == b:
        return True
    short, long = sorted((len(a), len(b)))
    if short < SHORT or short < RATIO * long:
        return False
    # matching blocks are a common subsequence, so the longest one bounds the ratio from above; sequences that are common bound that
    least = ALIKE * (len(a) + len(b)) / 2
    if not sequences_allow(a, b, least) or len(a) * len(b) <= BOUNDED and subsequence(a, b, least) < least - 1e-6:
        return False
    return matching_ratio(a, b) >= ALIKE


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * _BASE
    return x ^ (x >> np.uint64(31))


#: A factor (odd) and a summand for each of the minima: hashes of hashes, modulo 2 ** 64.
_FACTORS, _ADDED = _mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(2, -1, 1)
_FACTORS = _FACTORS | np.uint64(1)
PIECE = 1024  #: sequences that are re-keyed at once
_hash = functools.lru_cache(300_000)(xxhash.xxh3_64_intdigest)


def _keyed(grams: np.ndarray) -> np.ndarray:
    x = grams * _FACTORS + _ADDED
    return (x ^ (x >> np.uint64(32))) * _BASE


def bands(form: str) -> np.ndarray:
    """BANDS keys out of the least of the hashes of a form's sequences of SHINGLE words, each re-keyed for each of the minima; fewer words are one sequence."""
    words = form.split(" ")
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    grams = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        grams = _mixed(grams * _BASE + h[k : len(h) - size + 1 + k])
    grams = np.unique(grams)
    least = np.min([_keyed(grams[at : at + PIECE]).min(axis=1) for at in range(0, len(grams), PIECE)], axis=0).reshape(BANDS, ROWS)
    keys = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys * _BASE + least[:, k])
    return keys


def _banded(df: DataFrame, key: str, scope: str) -> DataFrame:
    """``key``, size (of the form), bands of each row of ``df`` (key, scope, form)."""

    def run(batches):
        for b in batches:
            forms = b.column(1).to_pylist()
            keys = np.concatenate([np.zeros(0, np.uint64), *(bands(x) for x in forms)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in forms], pa.int32()), b.column(2), pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys))], [key, "size", scope, "bands"])

    kinds = dict(df.dtypes)
    return arrow_map(df.select(key, "form", scope), run, f"`{key}` {kinds[key]}, size int, `{scope}` {kinds[scope]}, bands array<bigint>")


def near_pairs(df: DataFrame, scope: str, key: str, form: str) -> DataFrame:
    """key_x, key_y (key_x < key_y): rows of one ``scope`` whose forms are ``similar``.

    Candidates share one of BANDS keys of least hashes and are of about one length; a pair is verified once. Two texts of a
    share of common sequences of 0.6 meet with a probability over 0.99; equal forms always meet. Null forms match nothing."""
    base = df.where(F.length(form) > 0).select(scope, key, F.col(form).alias("form"))
    banded = _banded(base, key, scope).select(key, "size", scope, F.posexplode("bands").alias("place", "band"))
    rows = durable(banded.select(key, "size", F.xxhash64(scope, "place", "band").alias("bucket")))
    close = (F.least("size_x", "size_y") >= RATIO * F.greatest("size_x", "size_y")) & ((F.least("size_x", "size_y") >= SHORT) | (F.col("size_x") == F.col("size_y")))
    wanted = durable(meet(rows, "bucket", key, ["size"]).where(close).select(f"{key}_x", f"{key}_y").distinct())
    texts = base.select(key, scope, "form")
    both = wanted.join(texts.toDF(f"{key}_x", "scope_x", "form_x"), f"{key}_x").join(texts.toDF(f"{key}_y", "scope_y", "form_y"), f"{key}_y")
    return both.where(F.col("scope_x") == F.col("scope_y")).where(_similar("form_x", "form_y")).select(f"{key}_x", f"{key}_y")


def deduped(df: DataFrame, scope: str, key: str, url: str, content: str) -> DataFrame:
    """``key``, scope, url (canonical), family, n_chars, group (the least key of its near copies): one row a document.

    In a scope, of one URL the first row (by key) stays, of one fingerprint the first, of near copies one with a locale's
    family where others have none, then the longest, then the first. The reference's loop decides pair by pair in the order
    of arrival; this is the same but for chains of near copies, which count as one group. Empty contents are left out;
    rows without a URL are told apart by content alone."""
    base = df.where(F.length(content) > 0).select(scope, key, F.coalesce(urls.canonical(F.col(url)), F.concat(F.lit("?"), F.col(key).cast("string"))).alias("url"), F.col(content).alias("content"))
    base = first_of(base, [F.col(scope), F.col("url")], [F.col(key)])
    base = base.select(scope, key, "url", F.length("content").alias("n_chars"), t.fingerprint(F.col("content")).alias("fingerprint"), t.undated(F.col("content")).alias("form"))
    once = durable(first_of(base, [F.col(scope), F.col("fingerprint")], [F.col(key)]))
    linked = components(near_pairs(once, scope, key, "form"), f"{key}_x", f"{key}_y").withColumnsRenamed({"node": key, "component": "group"})
    grouped = once.join(linked, key, "left").withColumn("group", F.coalesce("group", key)).withColumn("family", urls.locale_family(F.col("url")))
    best = first_of(grouped, [F.col("group")], [F.col("family") == "", F.desc("n_chars"), F.col(key)])
    return best.select(key, scope, "url", "family", "n_chars", "group")


def clause_keys(df: DataFrame, url: str, kind: str, source: str) -> DataFrame:
    """``df`` and doc, type (the scope of a clause), form: what clauses are compared by; rows without a source are left out."""
    return df.where(F.length(source) > 0).withColumn("doc", F.coalesce(urls.canonical_with_query(F.col(url)), F.lit(""))).withColumn("type", F.coalesce(F.lower(F.trim(kind)), F.lit("legal"))).withColumn("form", t.dedupe_form(F.col(source)))


def exact_clauses(df: DataFrame, key: str) -> DataFrame:
    """Of the rows of ``clause_keys`` of one scope and form the first by ``key``."""
    return first_of(df, [F.col("doc"), F.col("type"), F.sha2("form", 256)], [F.col(key)])


def contained(df: DataFrame, key: str) -> DataFrame:
    """inner, outer (keys): rows of ``clause_keys``, of different forms, whose form of at least LEAST_CONTAINED characters stands in a longer one of its scope.

    A text inside another has its inner tokens whole there. So the outer side is keyed by all its sequences of GRAM tokens,
    the inner by the rarest of its own, and only what meets is searched; nothing of a scope is compared with all of it. Texts too
    short of tokens for a sequence of their own meet their scope's longer texts that have such a token."""
    base = durable(df.select(key, "doc", "type", "form", F.xxhash64("doc", "type").alias("scope")))
    tokens = base.select(key, "scope", F.length("form").alias("size"), F.explode(F.array(F.regexp_extract_all("form", F.lit(r"[a-z0-9]+|[^\sa-z0-9]"), F.lit(0)))).alias("tokens"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("tokens") - GRAM + 1, F.lit(1))), lambda i: F.xxhash64("scope", F.slice("tokens", i, F.lit(GRAM))))
    outer = tokens.where(F.size("tokens") >= GRAM).select(F.col(key).alias("outer"), F.col("size").alias("outer_size"), F.explode(F.array_distinct(grams)).alias("gram"))
    inner = tokens.where(F.col("size") >= LEAST_CONTAINED)
    own = F.slice(grams, F.lit(2), F.size("tokens") - GRAM - 1)  # without the first and the last token
    each = inner.where(F.size("tokens") >= GRAM + 2).select(F.col(key).alias("inner"), F.col("size").alias("inner_size"), F.explode(F.array_distinct(own)).alias("gram"))
    rare = each.join(outer.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "gram", "left")
    # a sequence that no other text has decides at once; else the rarest is looked up
    probe = first_of(rare, [F.col("inner")], [F.asc_nulls_first("n"), F.col("gram")]).where("n is not null").select("inner", "inner_size", "gram")
    met = probe.join(outer, "gram").where("inner_size < outer_size").select("inner", "outer")
    few = inner.where(F.size("tokens") < GRAM + 2).select("scope", F.col(key).alias("inner"), F.col("size").alias("inner_size"))
    met = met.unionByName(few.join(tokens.select("scope", F.col(key).alias("outer"), F.col("size").alias("outer_size")), "scope").where("inner_size < outer_size").select("inner", "outer"))
    texts = base.select(key, "form")
    both = met.join(texts.toDF("inner", "form_i"), "inner").join(texts.toDF("outer", "form_o"), "outer")
    return both.where(F.contains("form_o", F.col("form_i"))).select("inner", "outer")


def uncontained(df: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` (``clause_keys``, exact copies dropped) that stand in no longer row of their scope."""
    inner = contained(df, key).select(F.col("inner").alias(key)).distinct()
    return df.join(inner, key, "left_anti")
