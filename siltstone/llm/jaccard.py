"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact sorted-array intersection.

A document's set holds the hashes of its distinct five-word shingles. Two documents link when
100 * |A and B| >= 80 * |A or B|.

1.  One pass over the texts gives each document its set's size and a 128-bit signature.
    Documents with the same set are one class from here on.
2.  Shingles are ordered by how often they occur. Every second shingle, by hash, is counted over all
    documents; those in so many documents that at most ``MARKED`` of them are left are marked
    in a bit table of fixed size (8 MB). The order is (counted and unmarked, uncounted, marked; hash). By the
    prefix principle two linked sets share one of the first n - ceil(0.8 n) + 1 shingles of each in any order; this
    one only makes it rare that many share one. Where two occurrences are enough to be marked, an unmarked
    counted shingle is in one document only, and its tile, of one class, isn't sent.
3.  A tile is the classes that have one shingle in their prefix. Tiles lie in one order of
    (shingle, size, class), dealt by ranges, so a tile with a third of all classes spreads over many tasks. Each class is
    paired with the one before it, over the borders of ranges too, and the pairs whose bitmaps don't refute them are
    candidates; each class is verified with its least candidate.
4.  Tiles that still hold classes of more than one component are compared, in size bands and in blocks of
    about ``BLOCK`` classes of a band, a pair of blocks to a group, pairs inside a component left out; tiles with the same
    classes count once. The bitmaps' bound is taken there. A first time each class gives its likeliest partner in its block only, so that what is
    one group of near copies becomes one component with as many pairs as copies. The second time all pairs across components
    are given; blocks of a tile's largest component meet the blocks of others, not each other. What passes is verified, so no link
    between components is lost.
5.  Components of all verified links give each document the least doc_id reachable.

Verified means intersection of both full sorted arrays. Arrays and bitmaps are made once, for the classes in tiles of two or more.
``links`` gives all links between different sets, those inside a component too.

Cases: null or empty text, or none of words: size 0, linked with nothing. Fewer than five
words: the whole sequence is the one shingle. Null doc_id: counted, linked with nothing, null
component. Rows that share a doc_id count as rows of one document. Ties and repeated rows fall
into one class. Very long texts are blocks of their own: a kernel takes about 30 bytes of memory for each of a text's. Empty table: no
rows. Extra columns are ignored. Sets are told apart, and shingles, by hashes of 128 and 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_bytes, components, dropped, gram_hashes, mix, run_hash, shuffle_width, stored, table, text_blocks, word_hashes

WORDS = 5
PERCENT = 80
BITS = 2048
#: Bitmaps that go to tiles have at most so many bits.
TILE_BITS = 1 << 14
MARK_BITS = 26
#: At most so many marks, an eighth of the table's places.
MARKED = 1 << (MARK_BITS - 3)
#: Shingles whose hash ends in one of these bits set are not counted.
UNCOUNTED = np.uint64(1)
BLOCK = 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts of a block, one after the other, and n + 1 offsets."""
    words, doc = word_hashes(data, offsets, fold=True)
    n = len(offsets) - 1
    grams, at = gram_hashes(words, doc, size)
    counts = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    few = np.flatnonzero((counts > 0) & (counts < size))
    owner = np.concatenate([doc[at], few])
    grams = np.concatenate([grams, run_hash(words, first[few], counts[few])])
    if len(few):
        order = np.argsort(owner, kind="stable")
        owner, grams = owner[order], grams[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    for i in range(n):
        grams[ends[i] : ends[i + 1]].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(new)])[ends]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return total[ends[1:]] - total[ends[:-1]]


def signatures(grams: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _sums(mix(grams), ends), _sums(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), ends)


def bitmaps(grams: np.ndarray, ends: np.ndarray, most: int | None = None) -> list[bytes]:
    """Bitmaps of the first power of two of four bits or more a shingle, ``BITS`` at least and ``most`` at most; halves laid over each other are the next smaller one."""
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        size = max(BITS, 1 << int(4 * (b - a) - 1).bit_length())
        bits = np.zeros(min(size, most or size), bool)
        bits[(grams[a:b] >> np.uint64(20)) % np.uint64(len(bits))] = True
        out.append(np.packbits(bits).tobytes())
    return out


def _folded(bits: pa.Scalar, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(bits.as_buffer(), np.uint64).reshape(-1, size // 8))


def _cut(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, data, offsets in text_blocks(batch.column(2)):
            grams, ends = shingle_sets(data, offsets)
            s1, s2 = signatures(grams, ends)
            own = [c.slice(start, end - start) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(ends).astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))], ["doc_id", "key", "n", "s1", "s2"])


def _new(values: np.ndarray) -> np.ndarray:
    """Where in a sorted array a new value begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))


# ------------------------------------------------------------ frequent shingles


class Marks:
    """Which counted shingles are frequent; ``single``: the unmarked ones are in one document."""

    def __init__(self, bits: np.ndarray, single: bool):
        self.bits, self.single = bits, single

    def rank(self, grams: np.ndarray) -> np.ndarray:
        """0 for counted and unmarked, 1 for uncounted, 2 for marked shingles."""
        place = grams >> np.uint64(64 - MARK_BITS)
        marked = (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7)).astype(np.uint8))) & 1
        return np.where(grams & UNCOUNTED, 1, 2 * marked.astype(np.int64))


def frequent_marks(docs: DataFrame, width: int, most: int | None = None) -> Marks:
    """Marks for shingles in at least 2^k documents, k the least one or more that leaves at most ``most``."""
    most = most or MARKED
    power = min(20, max(6, (8 * width - 1).bit_length()))  # log2 of the number of ranges of hashes: eight or more to a task
    split = np.arange((1 << power) + 1, dtype=np.float64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                grams = shingle_sets(data, offsets)[0]
                grams = np.sort(grams[grams & UNCOUNTED == 0])
                if not len(grams):
                    continue
                new = _new(grams)
                times = np.minimum(np.diff(np.append(new, len(grams))), 255).astype(np.uint8)
                grams = grams[new]
                at = np.searchsorted(grams >> np.uint64(64 - power), split.astype(np.uint64))
                low = ((grams << np.uint64(power)) >> np.uint64(32)).astype(np.uint32)
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([low[at[i] : at[i + 1]].tobytes() for i in full], pa.binary()), pa.array([times[at[i] : at[i + 1]].tobytes() for i in full], pa.binary())], ["range", "low", "times"])

    def add(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        low, times = np.frombuffer(b"".join(got["low"].to_pylist()), np.uint32), np.frombuffer(b"".join(got["times"].to_pylist()), np.uint8)
        order = np.argsort(low, kind="stable")
        low = low[order]
        new = _new(low)
        level = np.log2(np.add.reduceat(times[order].astype(np.int64), new)).astype(np.int64)
        place = low[new] >> np.uint32(32 - (MARK_BITS - power))
        levels = [k for k in np.unique(level) if k]
        marks = [np.unique(place[level == k]) for k in levels]
        return pa.table({"range": pa.array([key[0].as_py()] * len(levels), pa.int32()), "level": pa.array(levels, pa.int32()), "n": pa.array([len(m) for m in marks], pa.int64()), "marks": pa.array([m.tobytes() for m in marks], pa.binary())})

    got = docs.mapInArrow(count, "range int, low binary, times binary").groupBy("range").applyInArrow(add, "range int, level int, n long, marks binary")
    got = stored(got, "jaccard-marks")
    left, least = 0, 64
    for r in got.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.col("level").desc()).collect():  # at most 64 rows
        left += r["n"]
        if left > most:
            break
        least = r["level"]
    else:
        least = 1
    bits = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    for r in got.where(F.col("level") >= least).toLocalIterator():  # at most ``most`` places in all
        place = (r["range"] << (MARK_BITS - power)) + np.frombuffer(r["marks"], np.uint32).astype(np.int64)
        np.bitwise_or.at(bits, place >> 3, (128 >> (place & 7)).astype(np.uint8))
    dropped(got)
    return Marks(bits, least == 1)


# ----------------------------------------------------------------------- tiles


def prefix_rows(grams: np.ndarray, ends: np.ndarray, marks: Marks, seen: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle, class and size of the prefix of each set of a block that isn't in ``seen``."""
    s1, n = signatures(grams, ends)[0], np.diff(ends)
    rank = marks.rank(grams)
    out, some = [], []
    for i in np.flatnonzero(n).tolist():
        if (name := int(s1[i])) in seen:
            continue
        seen.add(name)
        own, order = grams[ends[i] : ends[i + 1]], rank[ends[i] : ends[i + 1]]
        keep = len(own) - -(-PERCENT * len(own) // 100) + 1
        first = np.argsort(order, kind="stable")[:keep]
        if marks.single:
            first = first[order[first] > 0]
        out.append(own[first])
        some.append(i)
    size = [len(x) for x in out]
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.repeat(s1[some], size), np.repeat(n[some], size)


def prefixes(texts: DataFrame, marks: Marks) -> DataFrame:
    """(s, c, n) of the prefixes of all sets; a set that many rows of a task have goes once."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                s, c, n = prefix_rows(*shingle_sets(data, offsets), shared.value, seen)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(c.view(np.int64)), pa.array(n.astype(np.int64))], ["s", "c", "n"])

    return texts.mapInArrow(emit, "s long, c long, n long")


def chain(rows: DataFrame) -> DataFrame:
    """(a, b): classes that follow each other, by size, in a tile of ``rows`` (s, c, n)."""
    ordered = rows.repartitionByRange("s", "n", "c").sortWithinPartitions("s", "n", "c").withColumn("part", F.spark_partition_id()).select("part", "s", "n", "c")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, s=None, part=None, last=None):
            n = len(a)
            edge = [pa.array([x] * n, t) for x, t in ((s, pa.int64()), (part, pa.int32()), (last, pa.bool_()))]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *edge], ["a", "b", "s", "part", "last"])

        before, part = np.zeros((3, 0), np.int64), 0
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack([c.to_numpy() for c in batch.columns[1:]])
            if not before.shape[1]:
                part = batch.column(0)[0].as_py()
                yield out(x[1:2, 0], x[2:3, 0], int(x[0, 0]), part, False)
            x = np.concatenate([before, x], axis=1)
            same = (x[0, 1:] == x[0, :-1]) & (x[2, 1:] != x[2, :-1]) & (100 * x[1, :-1] >= PERCENT * x[1, 1:])
            pair = np.unique(np.stack([x[2, :-1][same], x[2, 1:][same]]), axis=1)
            yield out(pair[0], pair[1])
            before = x[:, -1:]
        if before.shape[1]:
            yield out(before[1], before[2], int(before[0, 0]), part, True)

    got = stored(ordered.mapInArrow(link, "a long, b long, s long, part int, last boolean"), "jaccard-chain")
    # Where ranges meet: two rows for each range, size in a and class in b.
    edge = got.where("part IS NOT NULL").select("s", "part", "last", F.col("a").alias("n"), F.col("b").alias("c"))
    border = W.orderBy("part", "last")
    edge = edge.select("s", "n", "c", "last", *[F.lag(x).over(border).alias(f"{x}_") for x in ("s", "n", "c")])
    edge = edge.where(f"NOT last AND s = s_ AND c <> c_ AND 100 * n_ >= {PERCENT} * n").select(F.col("c_").alias("a"), F.col("c").alias("b"))
    return got.where("part IS NULL").select("a", "b").unionByName(edge).distinct()


def overlap_bound(bits_a: np.ndarray, n_a: np.ndarray, bits_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """An upper bound on the overlap: a bit set in one and not in the other stands for at least one shingle."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(axis=-1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


def _may_link(overlap, n_a, n_b):
    return 100 * overlap >= PERCENT * (n_a + n_b - overlap)


def unrefuted(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fine bitmaps don't rule out that they link."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            may = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                size = min(len(x.as_buffer()), len(y.as_buffer()))
                may[i] = _may_link(overlap_bound(_folded(x, size), n_a[i], _folded(y, size), n_b[i]), n_a[i], n_b[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[may]), pa.array(np.maximum(a, b)[may])], ["a", "b"])

    of = lambda x: arrays.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"bits_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(bound, "a long, b long")


def verified(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by intersection of their arrays."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                keep.append(bool(_may_link(int((y[at] == x).sum()), len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda x, y: arrays.select(F.col("rep").alias(x), F.col("grams").alias(y))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(exact, "a long, b long")


def cross_pairs(rows: DataFrame, arrays: DataFrame, best: bool = False) -> DataFrame:
    """Pairs (a, b) of unlike ``comp`` in each tile of ``rows`` (s, rep, n, comp) whose bitmaps don't refute them; ``best``: for each class of a group the one with the greatest bound.

    Written step by step: a plan of all steps would start some twenty jobs and broadcasts at once, which the driver's memory holds together.
    """
    tiles = rows.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("d"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y")).where("lo <> hi")
    tiles = stored(tiles.groupBy("x", "y", "d").agg(F.min("s").alias("s")).select("s", "d"), "jaccard-mixed")
    rows = stored(rows.join(tiles, "s"), "jaccard-rows")
    dropped(tiles)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    cell = lambda band, kind, i, j: F.struct(band.alias("band"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    small = rows.where(F.col("d") <= BLOCK).select("s", "rep", "n", "comp", cell(zero, -1, zero, zero).alias("cell"))
    # Linked sizes are at most a factor of 1.25 apart: in one band or two that follow each other.
    large = rows.where(F.col("d") > BLOCK).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("long"))
    if best:
        sizes = stored(large.groupBy("s", "band").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("k")), "jaccard-sizes")
        salt = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("k"))
        large = large.join(sizes, ["s", "band"]).select("s", "rep", "n", "comp", cell(F.col("band"), 0, salt, salt).alias("cell"))
    else:
        # Rows of a tile's largest component meet the others only, so they are copied as often as there are blocks of others.
        by_comp = stored(large.groupBy("s", "band", "comp").agg(F.count("*").alias("rows")), "jaccard-main")
        main = by_comp.groupBy("s", "comp").agg(F.sum("rows").alias("rows")).groupBy("s").agg(F.max(F.struct("rows", "comp")).alias("main"))
        other = F.when(F.col("comp") != F.col("main"), F.col("rows")).otherwise(0)
        sizes = by_comp.join(main.select("s", F.col("main.comp").alias("main")), "s").groupBy("s", "band", "main").agg(F.ceil(F.sum(other) / BLOCK).cast("long").alias("k"), F.ceil(F.sum(F.col("rows") - other) / BLOCK).cast("long").alias("m"))
        # Each band with the blocks of the next one (up) and the one before (down).
        near = F.explode(F.array(*[F.struct((F.col("band") + d).alias("band"), F.lit(d).alias("d")) for d in (0, -1, 1)])).alias("at")
        of = lambda d, x: F.max(F.when(F.col("at.d") == d, F.col(x)))
        sizes = sizes.select("s", near, "main", "k", "m").groupBy("s", F.col("at.band").alias("band")).agg(
            F.max("main").alias("main"), *[of(d, x).alias(x + to) for d, to in ((0, ""), (-1, "_up"), (1, "_down")) for x in ("k", "m")]
        )
        sizes = stored(sizes, "jaccard-sizes")
        dropped(by_comp)
        large = large.join(sizes, ["s", "band"]).withColumn("other", (F.col("comp") != F.col("main")).cast("int"))
        large = large.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(2)), F.when(F.col("other") == 1, F.col("k")).otherwise(F.col("m"))))
        each = lambda k, f: F.transform(F.when(F.coalesce(F.col(k), zero) > 0, F.sequence(zero, F.col(k) - 1)).otherwise(F.array().cast("array<long>")), f)
        # Kinds of groups: others (0), others with main ones (1); others with the next band's others (2), its main ones (3); main ones with the next band's others (4).
        at, under, salt = F.col("band"), F.col("band") - one, F.col("salt")
        others = F.concat(
            each("k", lambda j: cell(at, 0, F.least(salt, j), F.greatest(salt, j))), each("m", lambda j: cell(at, 1, salt, j)),
            each("k_up", lambda j: cell(at, 2, salt, j)), each("m_up", lambda j: cell(at, 3, salt, j)),
            each("k_down", lambda j: cell(under, 2, j, salt)), each("m_down", lambda j: cell(under, 4, j, salt)),
        )
        mains = F.concat(each("k", lambda j: cell(at, 1, j, salt)), each("k_up", lambda j: cell(at, 4, salt, j)), each("k_down", lambda j: cell(under, 3, j, salt)))
        large = large.select("s", "rep", "n", "comp", F.explode(F.when(F.col("other") == 1, others).otherwise(mains)).alias("cell"))
    cells = stored(small.unionByName(large), "jaccard-cells")
    dropped(rows, sizes)
    placed = cells.join(arrays.select("rep", "bits"), "rep")

    def compare(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        n = got["n"].to_numpy()
        order = np.argsort(n, kind="stable")
        ids, n, comp = got["rep"].to_numpy()[order], n[order], got["comp"].to_numpy()[order]
        data, at = arrow_bytes(got["bits"])
        start, size = at[:-1][order], np.diff(at)[order]
        # Sizes of bitmaps go with n, and what could link has the same or twice it: rows of either kind, folded to the smaller.
        maps = {}
        for z in np.unique(size).tolist():
            lo, hi = np.searchsorted(size, z), np.searchsorted(size, 2 * z, side="right")
            maps[z] = lo, np.stack([np.bitwise_or.reduce(data[a : a + k].reshape(-1, z)) for a, k in zip(start[lo:hi], size[lo:hi], strict=True)]).view(np.uint64)
        left, right = [], []
        for i in range(len(ids) - 1):
            b = np.arange(i + 1, int(np.searchsorted(n, 100 * n[i] // PERCENT, side="right")))
            b = b[comp[b] != comp[i]]
            if len(b):
                lo, bits = maps[int(size[i])]
                bound = overlap_bound(bits[i - lo], n[i], bits[b - lo], n[b])
                may = _may_link(bound, n[i], n[b])
                if best and may.any():
                    may = np.flatnonzero(may)
                    may = may[np.argmax(bound[may] / (n[i] + n[b[may]] - bound[may]))][None]
                left.append(np.full(len(b[may]), ids[i]))
                right.append(ids[b[may]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    out = stored(placed.groupBy("s", "cell").applyInArrow(compare, "a long, b long").distinct(), "jaccard-pairs")
    dropped(cells)
    return out


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sets of all rows; classes; (s, c, n) of tiles; n, bitmap and array of the classes in tiles of two or more."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    sets = stored(docs.mapInArrow(_sign, "doc_id long, key long, n long, s1 long, s2 long"), "jaccard-sets")
    members = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = members.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "key")).alias("of"))
    classes = stored(classes.select("n", "s1", "s2", F.col("of.doc_id").alias("rep"), F.col("of.key").alias("key")), "jaccard-classes")
    linkable = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    marks = frequent_marks(linkable.select("text"), shuffle_width(spark))
    sent = stored(prefixes(linkable.select("text"), marks).distinct(), "jaccard-prefixes")
    shared = sent.groupBy("s").agg(F.count("*").alias("d")).where("d > 1").select("s")
    tiles = stored(sent.join(shared, "s", "left_semi"), "jaccard-tiles")
    dropped(sent)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch.column(2)):
                grams, ends = shingle_sets(data, offsets)
                own = [c.slice(start, end - start) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(ends).astype(np.int64)), pa.array(bitmaps(grams, ends, TILE_BITS), pa.binary()), pa.array(bitmaps(grams, ends), pa.binary()), pa.array(_cut(grams, ends), pa.binary())], ["rep", "c", "n", "bits", "fine", "grams"])

    wanted = classes.join(tiles.select(F.col("c").alias("s1")).distinct(), "s1", "left_semi").select(F.col("rep").alias("doc_id"), "key", F.col("s1").alias("c"))
    texts = linkable.join(wanted, ["doc_id", "key"]).groupBy("doc_id", "key", "c").agg(F.first("text").alias("text"))
    whole = stored(texts.select("doc_id", "c", "text").mapInArrow(arrays, "rep long, c long, n long, bits binary, fine binary, grams binary"), "jaccard-arrays")
    return sets, classes, tiles, whole


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links (a, b) between different sets, each by its least doc_id, and (doc_id, rep) of all documents with a set."""
    sets, classes, tiles, whole = _prepared(docs, id_col, text_col)
    rows = tiles.join(whole.select("c", "rep"), "c").select("s", "rep", "n", F.col("rep").alias("comp"))
    found = stored(verified(unrefuted(cross_pairs(rows, whole), whole), whole).distinct(), "jaccard-links")
    members = sets.where("n > 0 AND doc_id IS NOT NULL").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select("doc_id", "rep")
    return found, members


def _with_components(pairs: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(a, b, comp_a, comp_b) of pairs (a, b); what has no component is one of its own."""
    if comp is None:
        return pairs.select("a", "b", F.col("a").alias("comp_a"), F.col("b").alias("comp_b"))
    of = lambda x: comp.select(F.col("id").alias(x), F.col("component").alias(f"comp_{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.select("a", "b", F.coalesce("comp_a", "a").alias("comp_a"), F.coalesce("comp_b", "b").alias("comp_b"))


def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    return _with_components(pairs, comp).where("comp_a <> comp_b").select("a", "b")


def joined(links: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(id, component) where the links (a, b) join the components of ``comp``."""
    edges = _with_components(links, comp).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    top = components(edges, "jaccard-c")
    if comp is None:
        return stored(top, "jaccard-comp")
    top = top.select(F.col("id").alias("old"), F.col("component").alias("new"))
    old = comp.select("id", F.col("component").alias("old")).unionByName(top.join(comp, F.col("old") == F.col("id"), "left_anti").select(F.col("old").alias("id"), "old"))
    return stored(old.join(top, "old", "left").select("id", F.coalesce("new", "old").alias("component")), "jaccard-comp")


def connected(pairs: DataFrame, comp: DataFrame | None, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components with the links of each class to its least candidate, and the pairs that were tried."""
    tried = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "jaccard-tried")
    return joined(stored(verified(tried, whole), "jaccard-links"), comp), tried


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each of ``docs``."""
    sets, classes, tiles, whole = _prepared(docs, id_col, text_col)
    named = lambda c, as_: whole.select(F.col("c").alias(c), F.col("rep").alias(as_))
    pairs = chain(tiles).withColumnsRenamed({"a": "c_a", "b": "c_b"}).join(named("c_a", "a"), "c_a").join(named("c_b", "b"), "c_b").select("a", "b")
    near = stored(unrefuted(pairs, whole), "jaccard-near")
    comp, _ = connected(near, None, whole)
    held = stored(tiles.join(whole.select("c", "rep"), "c").select("s", "rep", "n"), "jaccard-held")
    dropped(tiles)
    rows = lambda: held.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("s", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    # One partner for each class first, so that groups of many near copies are one component before all pairs across are asked for.
    found = cross_pairs(rows(), whole, best=True)
    likely = stored(unrefuted(found, whole), "jaccard-likely")
    dropped(found)
    comp = joined(stored(verified(likely.unionByName(apart(near, comp)).distinct(), whole), "jaccard-links"), comp)
    dropped(near, likely)
    found = cross_pairs(rows(), whole)
    cross = stored(unrefuted(found, whole), "jaccard-cross")
    dropped(found)
    # Each class with its least partner first: most of what is left then lies inside a component.
    comp, tried = connected(cross, comp, whole)
    rest = stored(apart(cross, comp).join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
    comp = joined(stored(verified(rest, whole), "jaccard-links"), comp)
    dropped(whole, cross, rest, held)
    final = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    final = stored(final, "jaccard-final")
    dropped(classes, comp)
    out = sets.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "s1", "s2").join(final, ["n", "s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = sets.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that have one of lesser id in their group."""
    groups = jaccard_groups(docs, id_col, text_col)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM d
), e AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS x, len(s) AS n FROM g),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS m, b.n, count(*) AS k FROM e a JOIN e b
  ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL
), h AS MATERIALIZED (SELECT u, v FROM p WHERE 100 * k >= 80 * (m + n - k)),
l AS MATERIALIZED (SELECT u, v FROM h UNION ALL SELECT v, u FROM h),
r AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
)
SELECT g.doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, c AS component_id
FROM g JOIN (SELECT u, min(v) AS c FROM r GROUP BY u) ON g.doc_id = u
"""
