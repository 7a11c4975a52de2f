"""Problem 8: passages of held-out items inside the corpus.

The corpus is indexed by suffix arrays over words, one per shard (an Arrow batch of a partition): the suffixes that can
match (their first WORDS words all belong to the items' vocabulary) are sorted, and every suffix of every item is looked
up by binary search; neighbours in the array give the longest verbatim match and where it lies. Documents are read once
and never shuffled; what moves is the few matches. The items reach the executors as blocks of at most BLOCK_CHARS
characters, which pass through the driver one at a time; each shard is searched for all blocks in the one pass.

Cases: null and empty texts and texts under WORDS words match nothing; an item that occurs twice among the items is
reported under both ids; a document that stands twice is reported twice.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.words import WORD
from lexloom.operators.cluster import arrow_map

WORDS = 12
BLOCK_CHARS = 16_000_000  #: characters of the items in a block, whose index has some 100 MB
HELD_BLOCKS = 4  #: blocks that a worker holds at once
SCHEMA = "doc_id bigint, item_id bigint, item_word int, doc_word int, n_words int"


class Items:
    """A block of items: their vocabulary, and all their suffixes of at least ``least`` words in order."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        self.least, self.vocabulary = least, {}
        self.item, self.word = [], []
        flat: list[int] = []
        starts: list[int] = []
        for i, text in zip(ids, texts, strict=True):
            words = WORD.findall((text or "").lower())
            if len(words) < least:
                continue
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for k in range(len(words) - least + 1):
                starts.append(len(flat) + k)
                self.item.append(i)
                self.word.append(k)
            flat += [*numbers, 0]
        self.flat, self.starts = np.array([*flat, *[0] * least], np.int32), np.array(starts, np.int64)
        self.item, self.word = np.array(self.item, np.int64), np.array(self.word, np.int64)
        self.keys = _keys(self.flat, self.starts, least)


def _keys(flat: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """The first ``least`` words of suffixes as byte strings that sort as the suffixes do."""
    if not len(starts):
        return np.zeros(0, f"S{4 * least}")
    return np.ascontiguousarray(flat[starts[:, None] + np.arange(least)].astype(">u4")).view(f"S{4 * least}")[:, 0]


def search(texts: list[str | None], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text's place, item, word of the item, word of the text, length in words) of the longest matches, over one shard."""
    least, known = items.least, items.vocabulary.get
    parts, offsets, at = [], [], 0
    for text in texts:
        words = WORD.findall(text.lower()) if text else ()
        offsets.append(at)
        part = np.zeros(len(words) + 1, np.int32)
        part[: len(words)] = np.fromiter((known(w, 0) for w in words), np.int32, len(words))
        parts.append(part)
        at += len(part)
    flat = np.concatenate([*parts, np.zeros(least, np.int32)])
    zeros = np.concatenate([[0], np.cumsum(flat == 0)])
    starts = np.flatnonzero(zeros[least : len(flat) + 1] == zeros[: len(flat) - least + 1])
    if not len(starts) or not len(items.starts):
        return []
    keys = _keys(flat, starts, least)
    order = np.argsort(keys, kind="stable")  # the suffix array, as deep as a match must be
    keys, starts = keys[order], starts[order]
    low, high = np.searchsorted(keys, items.keys, "left"), np.searchsorted(keys, items.keys, "right")
    hit = np.flatnonzero(high > low)
    count = high[hit] - low[hit]
    q = np.repeat(hit, count)
    if not len(q):
        return []
    within = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
    p, a = starts[low[q] + within], items.starts[q]
    # what begins before both is part of a longer match
    before = (a > 0) & (p > 0) & (items.flat[a - 1] != 0) & (items.flat[a - 1] == flat[p - 1])
    q, p, a = q[~before], p[~before], a[~before]
    size = np.full(len(q), least)
    open_ = np.arange(len(q))
    while len(open_):  # all open matches grow by a word at once
        x, y = items.flat[a[open_] + size[open_]], flat[p[open_] + size[open_]]
        open_ = open_[(x != 0) & (x == y)]
        size[open_] += 1
    places = np.array(offsets, np.int64)
    doc = np.searchsorted(places, p, "right") - 1
    return list(zip(doc.tolist(), items.item[q].tolist(), items.word[q].tolist(), (p - places[doc]).tolist(), size.tolist(), strict=True))


def item_blocks(items: DataFrame, words: int) -> Iterator[Items]:
    """The items as blocks of at most BLOCK_CHARS characters (or one longer item), one after the other."""
    ids, texts, size = [], [], 0
    for r in items.select("item_id", "text").where("text is not null").toLocalIterator():
        if ids and size + len(r.text) > BLOCK_CHARS:
            yield Items(ids, texts, words)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield Items(ids, texts, words)


def matches(docs: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """SCHEMA's columns: every longest run of at least ``words`` words that a document (doc_id, text) and an item (item_id, text) share."""
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(block) for block in item_blocks(items, words)]

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for block in blocks:
                rows = search(texts, block.value)
                if len(blocks) > HELD_BLOCKS:
                    block._value = None  # read again from the worker's disk when its turn comes
                columns = [pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[j] for r in rows], pa.int32()) for j in (2, 3, 4))], ["doc_id", "item_id", "item_word", "doc_word", "n_words"])

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)


def leaks(docs: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, item_id, n_words (of the longest match), n_matches: the items a document holds."""
    return matches(docs, items, words).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.count("*").alias("n_matches"))


def clean_ids(docs: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id of the documents that hold no item."""
    return docs.select("doc_id").join(matches(docs, items, words).select("doc_id").distinct(), "doc_id", "left_anti")
