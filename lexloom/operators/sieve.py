"""A table of bits over keys, by which rows that meet none of the keys are left out before anything is shuffled."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.cluster import arrow_map

#: Bits for a key, and the least and most of a table (32 MB). Of a fuller table more rows pass than have to; a row that meets a key always passes.
BITS, LEAST, MOST = 16, 1 << 16, 1 << 28
#: A key's two bits are taken from these places of the key on.
PLACES = (0, 28)


def sieve(keys: DataFrame) -> np.ndarray:
    """The table of ``keys`` (one column of evenly spread bigints): as words of 64 bits, set on the executors."""
    size = min(MOST, max(LEAST, 1 << (BITS * keys.count()).bit_length()))
    spots = keys.toDF("key").select(F.explode(F.array(*(F.shiftrightunsigned("key", p).bitwiseAND(size - 1) for p in PLACES))).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 AS int))")).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def passing(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each of ``keys``, whether it can be one of the table's: always where it is one, seldom else."""
    keys, last = keys.view(np.uint64), np.uint64(64 * len(table) - 1)
    spots = [(keys >> np.uint64(p)) & last for p in PLACES]
    bits = [table[s >> np.uint64(6)] >> (s & np.uint64(63)) for s in spots]
    return (bits[0] & bits[1] & np.uint64(1)).astype(bool)


def exploded(df: DataFrame, table) -> DataFrame:
    """The rows of ``df`` for each key in its last column, an array of bigints, that passes ``table`` (a broadcast ``sieve``)."""
    names = df.columns
    others = range(len(names) - 1)

    def run(batches):
        for b in batches:
            lists = b.column(len(others))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            fine = passing(table.value, flat)
            rows = pc.list_parent_indices(lists).filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in others), pa.array(flat[fine])], names)

    return arrow_map(df, run, ", ".join(f"{x} {kind}" for x, kind in df.dtypes[:-1]) + f", {names[-1]} bigint")
