"""Problem 6: pairs of records of one table whose word shingles overlap by a share or more.

An exact similarity join by prefix filtering. Copies (the same words in the same order) are one class first. The texts are
read once, to hashes of their words, which the later passes read; the same pass counts the shingles of all records in a
sketch, which orders shingles from rare to frequent; it only decides how much work there is, the order being the same for all. Of each class the rarest shingles, as many as a similar partner cannot all lack,
are its prefix; by the size of the sets, prefixes are longer, and two classes must share not one but several of their
shingles (their prefix n-gram). Classes that share prefix shingles meet in a join, where the length filter, the positional filter and
the suffix filter (bitmaps bound the distance of the sets from below) drop most; what is left is verified
once per pair on the whole texts.

Prefix shingles that one class alone has are dropped before the join by a window over the shuffled prefixes, so the
join handles a small rest. A shingle that may stand in very many records is spread over salts before it is counted, and
the classes of one shingle meet block against block. Copies are expanded to pairs of their records while the product of both classes is at
most EXPAND. Larger classes are parted by identical text, and pairs of different texts are expanded by the same rule;
only where more than EXPAND pairs of records have the same two texts, or one text, they stay as a pair of representatives (the least
ids) plus one row that ties each record to its text's representative, so no link is lost and no copies are squared.

Cases: null and empty texts and texts of fewer than ``least_words`` words have no pairs; ties in the order are broken by
hash; repeated rows are copies of each other.
"""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.words import WORD, hashes, mixed, shingles
from lexloom.operators.cluster import arrow_map, durable

SHINGLE, SHARE, LEAST_WORDS = 3, 0.7, 30
LEAST_SLOTS, MOST_SLOTS = 1 << 22, 1 << 24  #: counters of the sketch; as ranks of one byte each it is 4 to 16 MB
PARTS = 64  #: pieces a sketch is added up in
MAPS = ("m0", "m1")  #: bitmaps of a set, 64 bits each
LARGEST_MAPPED = 160  #: size of the largest sets that have bitmaps
LARGE, SHARED = 90, 3  #: sets of at least LARGE shingles have longer prefixes, of which two similar ones share SHARED
HELD = 4_000_000  #: shingles a task holds before it counts them
HOT = 100_000  #: occurrences from which a shingle's rows are spread over SALTS keys
SALTS, BLOCK = 64, 1024  #: keys of a frequent shingle; its classes that meet in one piece
EXPAND = 4096  #: largest product of two classes' sizes that is expanded
SMALL = 1_000_000  #: rows of two numbers (some 16 MB) up to which a side is broadcast


class Batch:
    """The records of a batch that count: their words' hashes, end to end, and the keys of their classes."""

    def __init__(self, tbl: list[str], texts: list[str | None]):
        words = [WORD.findall(t.lower()) if t else () for t in texts]
        self.rows = [k for k, w in enumerate(words) if len(w) >= LEAST_WORDS]
        words = [words[k] for k in self.rows]
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.flat = np.fromiter(map(hashes.__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(self.lengths.sum()))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.same = np.array([xxhash.xxh3_64_intdigest(texts[k].encode("utf-8", "surrogatepass")) for k in self.rows], np.uint64).view(np.int64)
        self.salts = np.array([zlib.crc32(tbl[k].encode()) for k in self.rows], np.uint64)
        if self.rows:
            place = (np.arange(len(self.flat)) - np.repeat(self.starts, self.lengths)).astype(np.uint64)
            x = mixed(self.flat + place * np.uint64(0x9E3779B97F4A7C15) + np.repeat(self.salts, self.lengths))
            self.a = np.add.reduceat(x, self.starts).view(np.int64)
            self.b = np.add.reduceat(mixed(x ^ np.uint64(0x5851F42D4C957F2D)), self.starts).view(np.int64)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the shingles, the record of each), with repetitions."""
        record = np.repeat(np.arange(len(self.rows)), self.lengths)
        s = shingles(self.flat, SHINGLE)
        fine = record[: len(s)] == record[SHINGLE - 1 :]
        return s[fine], record[: len(s)][fine]


def slots_for(df: DataFrame) -> int:
    """Counters of a sketch: one for 64 bytes of ``df``'s files (partitions times their largest size), between LEAST_SLOTS and MOST_SLOTS."""
    read = df.rdd.getNumPartitions() * int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (read // 64).bit_length()))


def survey(df: DataFrame, slots: int) -> DataFrame:
    """kind 0: tbl, row_id, a, b (the class's key), same (a hash of the text), words (hashes), of each record that counts; kind 1: part, counts of the shingles.

    The one pass over the texts; all that follows reads the words' hashes."""
    names = ["kind", "tbl", "row_id", "a", "b", "same", "words", "counts"]

    def run(batches):
        sketch, held, size = np.zeros(slots, np.int32), [], 0

        def count():
            if held:
                np.add(sketch, np.bincount(np.concatenate(held), minlength=slots), out=sketch, casting="unsafe")
                held.clear()

        for batch in batches:
            tbl = batch.column(0).to_pylist()
            got = Batch(tbl, batch.column(2).to_pylist())
            n = len(got.rows)
            if not n:
                continue
            held.append((got.shingles()[0] % np.uint64(slots)).astype(np.int64))
            size += len(held[-1])
            if size > HELD:
                count()
                size = 0
            take = pa.array(got.rows, pa.int32())
            words = pa.ListArray.from_arrays(pa.array(np.append(got.starts, len(got.flat)).astype(np.int32)), pa.array(got.flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int8()), batch.column(0).take(take), batch.column(1).take(take), pa.array(got.a), pa.array(got.b), pa.array(got.same), words, pa.nulls(n, pa.binary())], names)
        count()
        if sketch.any():
            yield pa.RecordBatch.from_arrays([pa.array([1] * PARTS, pa.int8()), pa.nulls(PARTS, pa.string()), pa.array(range(PARTS), pa.int64()), *[pa.nulls(PARTS, pa.int64())] * 3, pa.nulls(PARTS, pa.list_(pa.int64())), pa.array([_packed(p) for p in np.split(sketch, PARTS)], pa.binary())], names)

    return arrow_map(df.select("tbl", "row_id", "text"), run, "kind tinyint, tbl string, row_id bigint, a bigint, b bigint, same bigint, words array<bigint>, counts binary")


def _packed(counts: np.ndarray) -> bytes:
    """Counters by planes of their bytes, which are mostly zeros."""
    return zlib.compress(np.ascontiguousarray(np.minimum(counts, 2**31 - 1).astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view("<i4")[:, 0].astype(np.int64)


def _rank(count):
    return np.minimum(255, 10 * np.log2(1 + count)).astype(np.uint8)


def _added(surveyed: DataFrame, slots: int) -> np.ndarray:
    """The sketch of all as ranks of one byte: the logarithms of the counters, which are added up on the executors."""

    def within(batches):  # first within a partition, so that a part's sum reads one row a partition
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for part, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                totals[part] = totals[part] + _unpacked(x) if part in totals else _unpacked(x)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int64()), pa.array([_packed(x) for x in totals.values()], pa.binary())], ["part", "counts"])

    def add(key, batches):
        total = np.zeros(slots // PARTS, np.int64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                total += _unpacked(x)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([_rank(total).tobytes()], pa.binary())], ["part", "ranks"])

    parts = arrow_map(surveyed.where("kind = 1").select(F.col("row_id").alias("part"), "counts"), within, "part bigint, counts binary")
    grouped = parts.groupBy("part").applyInArrow(_summed(add), "part bigint, ranks binary")
    out = np.zeros(slots, np.uint8)
    for r in grouped.collect():
        out[r.part * (slots // PARTS) : (r.part + 1) * (slots // PARTS)] = np.frombuffer(r.ranks, np.uint8)
    return out


def _summed(add):
    def one(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(add(key, table.to_batches()))

    return one


def _bitmaps(s: np.ndarray, record: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """64 * len(MAPS) bits a set: the parity of its shingles by hash. Two sets differ in no fewer shingles than their maps in bits.

    Sets too large for their maps to tell anything have zeros, which no filter looks at.
    """
    spots = len(MAPS) * 64
    cell = record * spots + (mixed(s) % np.uint64(spots)).astype(np.int64)
    odd = np.bincount(cell, minlength=spots * len(sizes)) & 1
    words = np.packbits(odd.astype(np.uint8).reshape(-1, 8), axis=1).reshape(len(sizes), len(MAPS), 8).view(">u8")[:, :, 0].astype(np.uint64).view(np.int64)
    words = np.where((sizes <= LARGEST_MAPPED)[:, None], words, 0)
    return [np.ascontiguousarray(words[:, k]) for k in range(len(MAPS))]


def prefixes(records: DataFrame, counts: np.ndarray, share: float, hot: int = HOT) -> DataFrame:
    """h (a shingle), salt, a (half of the class's key), size, place (of h in the order), MAPS: the prefixes of ``records`` (tbl, a, words).

    salt is 0 but for shingles whose counter says that they may stand in over ``hot`` records (and in many times more than
    most): their rows are spread over SALTS keys from 1 on."""
    sent = records.sparkSession.sparkContext.broadcast(counts)
    limit = max(int(_rank(hot)), int(counts.mean()) + 40) if len(counts) else 255

    def run(batches):
        order, known = sent.value, set()  # copies within a task are sent once
        for batch in batches:
            a = batch.column(1).to_numpy(zero_copy_only=False)
            fresh = np.ones(len(a), bool)
            for k, key in enumerate(a.tolist()):
                fresh[k] = key not in known
                known.add(key)
            if len(known) > 1_000_000:
                known.clear()
            batch = batch.filter(pa.array(fresh))
            if not batch.num_rows:
                continue
            a = batch.column(1).to_numpy(zero_copy_only=False)
            salts = np.array([zlib.crc32(t.encode()) for t in batch.column(0).to_pylist()], np.uint64)
            s, record = _shingled(batch.column(2))
            rank = order[(s % np.uint64(len(order))).astype(np.int64)]
            # BATCH_ROWS records and the rank take 17 bits; 47 bits of a hash order the rest
            by = np.argsort((record.astype(np.uint64) << np.uint64(8) | rank) << np.uint64(47) | s >> np.uint64(17))
            s, record, rank = s[by], record[by], rank[by]
            once = np.ones(len(s), bool)  # a set: equal shingles of a record are neighbours
            once[1:] = (s[1:] != s[:-1]) | (record[1:] != record[:-1])
            s, record, rank = s[once], record[once], rank[once]
            sizes = np.bincount(record, minlength=len(a))
            place = np.arange(len(s)) - (np.cumsum(sizes) - sizes)[record]
            bitmaps = _bitmaps(s, record, sizes)
            length = np.minimum(sizes, sizes - np.ceil(share * sizes - 1e-9).astype(np.int64) + np.where(sizes >= LARGE, SHARED, 1))
            first = place < length[record]
            s, record, place, rank = s[first], record[first], place[first], rank[first]
            spread = np.where(rank >= limit, 1 + a.view(np.uint64)[record] % np.uint64(SALTS), 0).astype(np.int32)
            columns = [mixed(s ^ salts[record]).view(np.int64), spread, a[record], sizes[record].astype(np.int32), place.astype(np.int32), *(m[record] for m in bitmaps)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "salt", "a", "size", "place", *MAPS])

    return arrow_map(records.select("tbl", "a", "words"), run, "h bigint, salt int, a bigint, size int, place int, " + ", ".join(f"{m} bigint" for m in MAPS))


def _shingled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles, the record of each), with repetitions, of a column of word hashes."""
    flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    record = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    s = shingles(flat, SHINGLE)
    fine = record[: len(s)] == record[SHINGLE - 1 :]
    return s[fine], record[: len(s)][fine]


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (prefixes) whose shingle several classes have, each class once, and n, how many have it.

    One shuffle and sort; a shingle that stands in very many records is spread over salts, and its count is added up from theirs."""
    w = Window.partitionBy("h", "salt")
    once = rows.withColumn("before", F.lag("a").over(w.orderBy("a"))).where("before is null or before != a").drop("before")
    met = durable(once.withColumn("n", F.count("*").over(w).cast("int")).where("n > 1 or salt > 0"))
    cold, hot = met.where("salt = 0"), met.where("salt > 0").drop("n")
    totals = durable(hot.groupBy("h").agg(F.count("*").cast("int").alias("n")).where("n > 1"))
    return cold.unionByName(hot.join(_few(totals, totals.count()), "h"))


def candidates(shared: DataFrame, share: float) -> DataFrame:
    """x, y (halves of class keys, x < y): pairs that the filters leave of the prefixes ``shared``.

    The classes of a shingle that up to BLOCK of them have meet at once, both sides from one shuffle; of a more frequent
    one they meet block by block, BLOCK of them in a block, so that no task has all of them."""
    names = ["size", "place", *MAPS]
    small = shared.where(F.col("n") <= BLOCK).select("h", "a", *names)
    x, y = (small.toDF("h", side, *(f"{c}{side}" for c in names)) for side in "xy")
    met = _passing(x.join(y, "h").where("x < y"), share)
    large = shared.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    x = large.select("h", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("a").alias("x"), *(F.col(c).alias(f"{c}x") for c in names))
    y = large.select("h", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("a").alias("y"), *(F.col(c).alias(f"{c}y") for c in names))
    met = met.unionByName(_passing(x.join(y, ["h", "i", "j"]).where("i < j or x < y"), share))
    return met.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("votes").alias("n")).where(F.col("n") >= SHARED).select("x", "y")


def _passing(met: DataFrame, share: float) -> DataFrame:
    """x, y, votes of the pairs of ``met`` that the filters by length, position and bitmaps leave."""
    sx, sy, px, py = (F.col(c) for c in ("sizex", "sizey", "placex", "placey"))
    need = F.ceil(F.lit(share / (1 + share)) * (sx + sy) - 1e-9)
    length = (sx >= F.ceil(share * sy - 1e-9)) & (sy >= F.ceil(share * sx - 1e-9))
    position = F.least(px, py) + F.least(sx - px, sy - py) >= need
    apart = sum((F.bit_count(F.col(f"{m}x").bitwiseXOR(F.col(f"{m}y"))) for m in MAPS), F.lit(0))
    unmapped = (F.greatest(sx, sy) > LARGEST_MAPPED) & (F.least(sx, sy) > 0)
    suffix = unmapped | (apart <= sx + sy - 2 * need)
    # the smaller set of a pair shares more of itself, so what is shared begins earlier in it
    early = [s - F.ceil(F.lit(2 * share / (1 + share)) * s - 1e-9) + F.when(s >= LARGE, SHARED).otherwise(1) for s in (sx, sy)]
    indexed = ((sx > sy) | (px < early[0])) & ((sy > sx) | (py < early[1]))
    votes = F.when(F.least(sx, sy) >= LARGE, 1).otherwise(SHARED)
    return met.where(length & indexed & position & suffix).select("x", "y", votes.alias("votes"))


def _few(ids: DataFrame, count: int) -> DataFrame:
    """A side of two numbers a row for a join: broadcast if its counted size is small."""
    return F.broadcast(ids) if count <= SMALL else ids


def class_pairs(df: DataFrame, share: float = SHARE, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): tbl, row_id, rep, n (size of its class), same of every record that counts; tbl, x, y (representatives, x < y), similarity."""
    slots = slots_for(df)
    seen = durable(survey(df, slots))
    counts = _added(seen, slots)
    records = seen.where("kind = 0")
    classes = durable(records.groupBy("tbl", "a", "b").agg(F.min("row_id").alias("rep"), F.count("*").alias("n")))
    members = records.select("tbl", "row_id", "a", "b", "same").join(classes, ["tbl", "a", "b"]).select("tbl", "row_id", "rep", "n", "same")
    shared = shared_prefixes(prefixes(records, counts, share, hot))
    found = durable(candidates(shared, share))
    reps = classes.select("a", "tbl", "rep")
    named = durable(found.join(reps.toDF("x", "tbl", "rx"), "x").join(reps.toDF("y", "tbl", "ry"), ["tbl", "y"]).select("tbl", F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")))
    ids = durable(named.select("tbl", F.explode(F.array("x", "y")).alias("row_id")).distinct())
    words = records.select("tbl", "row_id", "words").join(_few(ids, ids.count()), ["tbl", "row_id"], "left_semi")
    both = named.join(words.toDF("tbl", "x", "wx"), ["tbl", "x"]).join(words.toDF("tbl", "y", "wy"), ["tbl", "y"])

    def run(batches):
        for b in batches:
            s = _similarities(b.column(3), b.column(4))
            keep = pa.array(s >= share - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(k).filter(keep) for k in range(3)] + [pa.array(s).filter(keep)], ["tbl", "x", "y", "similarity"])

    return members, arrow_map(both.select("tbl", "x", "y", "wx", "wy"), run, "tbl string, x bigint, y bigint, similarity double")


def _similarities(x: pa.Array, y: pa.Array) -> np.ndarray:
    """For each pair of two columns of word hashes, the share of the shingles that both have in those that at least one has."""
    (p, i), (q, j) = _shingled(x), _shingled(y)
    s, pair = np.concatenate([p, q]), np.concatenate([i, j])
    side = np.repeat(np.array([0, 1], np.int8), [len(p), len(q)])
    by = np.lexsort((side, s, pair))
    s, pair, side = s[by], pair[by], side[by]
    new = np.ones(len(s), bool)  # the first of a pair's equal shingles
    new[1:] = (s[1:] != s[:-1]) | (pair[1:] != pair[:-1])
    second = np.zeros(len(s), bool)  # where the other side's begin
    second[1:] = ~new[1:] & (side[1:] != side[:-1])
    union, both = np.bincount(pair[new], minlength=len(x)), np.bincount(pair[second], minlength=len(x))
    return both / np.maximum(1, union)


def pairs(df: DataFrame, share: float = SHARE, hot: int = HOT) -> DataFrame:
    """tbl, id_a, id_b (id_a < id_b): the pairs of records of ``df`` (tbl, row_id, text), copies as the module says."""
    members, found = class_pairs(df, share, hot)
    found = durable(found.select("tbl", "x", "y"))
    many = durable(members.where("n > 1"))
    # records of one text in classes of copies: u, the text's representative, and m, how many
    units = durable(many.groupBy("tbl", "rep", "same", "n").agg(F.min("row_id").alias("u"), F.count("*").alias("m")))
    held = many.join(units.drop("n"), ["tbl", "rep", "same"])
    # within a class: all pairs of small ones; of large ones all pairs of a text, or representative and record, and the pairs of texts
    own = many.where(f"n * n <= {EXPAND}")
    inner = own.alias("p").join(own.alias("q"), ["tbl", "rep"]).where("p.row_id < q.row_id").select("tbl", F.col("p.row_id").alias("id_a"), F.col("q.row_id").alias("id_b"))
    large = held.where(f"n * n > {EXPAND}")
    few = large.where(f"m * m <= {EXPAND}")
    inner = inner.unionByName(few.alias("p").join(few.alias("q"), ["tbl", "u"]).where("p.row_id < q.row_id").select("tbl", F.col("p.row_id").alias("id_a"), F.col("q.row_id").alias("id_b")))
    tied = large.where(f"m * m > {EXPAND} and row_id != u").select("tbl", F.col("u").alias("id_a"), F.col("row_id").alias("id_b"))
    parts = units.where(f"n * n > {EXPAND}").select("tbl", "rep", "u", "m")
    apart = parts.toDF("tbl", "rep", "ux", "mx").join(parts.toDF("tbl", "rep", "uy", "my"), ["tbl", "rep"]).where("ux < uy").select("tbl", "ux", "mx", "uy", "my")
    # between classes
    sizes = members.where("row_id = rep").select("tbl", "rep", "n")
    sized = found.join(sizes.toDF("tbl", "x", "nx"), ["tbl", "x"]).join(sizes.toDF("tbl", "y", "ny"), ["tbl", "y"])
    one = sized.where("nx * ny = 1").select("tbl", F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    more = sized.where(f"nx * ny between 2 and {EXPAND}").select("tbl", "x", "y")
    xs, ys = members.select("tbl", F.col("rep").alias("x"), F.col("row_id").alias("p")), members.select("tbl", F.col("rep").alias("y"), F.col("row_id").alias("q"))
    cross = more.join(xs, ["tbl", "x"]).join(ys, ["tbl", "y"]).select("tbl", F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
    each = units.select("tbl", "rep", "u", "m")
    wide = sized.where(f"nx * ny > {EXPAND}").join(each.toDF("tbl", "x", "ux", "mx"), ["tbl", "x"], "left").join(each.toDF("tbl", "y", "uy", "my"), ["tbl", "y"], "left")
    wide = wide.select("tbl", F.coalesce("ux", "x").alias("ux"), F.coalesce("mx", F.lit(1)).alias("mx"), F.coalesce("uy", "y").alias("uy"), F.coalesce("my", F.lit(1)).alias("my"))
    return inner.unionByName(tied).unionByName(one).unionByName(cross).unionByName(_of_texts(apart.unionByName(wide), held))


def _of_texts(texts: DataFrame, held: DataFrame) -> DataFrame:
    """tbl, id_a, id_b of pairs of texts (tbl, ux, mx, uy, my): of all their records, or of the representatives if these are over EXPAND."""
    one = texts.where(f"mx * my > {EXPAND}").select("tbl", F.least("ux", "uy").alias("id_a"), F.greatest("ux", "uy").alias("id_b"))
    records = held.select("tbl", "u", "row_id")
    more = texts.where(f"mx * my <= {EXPAND}").join(records.toDF("tbl", "ux", "p"), ["tbl", "ux"], "left").join(records.toDF("tbl", "uy", "q"), ["tbl", "uy"], "left")
    p, q = F.coalesce("p", "ux"), F.coalesce("q", "uy")
    return one.unionByName(more.select("tbl", F.least(p, q).alias("id_a"), F.greatest(p, q).alias("id_b")))


def links(df: DataFrame, share: float = SHARE) -> DataFrame:
    """tbl, row_id, class_id (the least id of the record's copies), n_copies, n_links (other classes it is alike to): one row a record that counts."""
    members, found = class_pairs(df, share)
    each = found.select("tbl", F.explode(F.array("x", "y")).alias("rep")).groupBy("tbl", "rep").agg(F.count("*").alias("n_links"))
    return members.join(each, ["tbl", "rep"], "left").select("tbl", "row_id", F.col("rep").alias("class_id"), F.col("n").alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
