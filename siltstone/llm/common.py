"""What the operators of this subpackage share: scratch tables, text kernels, components.

Scratch tables live under ``spark.checkpoint.dir``, which driver and executors
share on a cluster. Only where that setting is absent (a test session) a
temporary folder is made.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIRS: dict[str, str] = {}

#: Bytes of text that a kernel works on at once; one longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: Size of an Arrow batch; a longer row is a batch of its own.
BATCH = "4m"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return _OWN_DIRS[app]


#: Spark deletes the shuffle files of an execution as soon as that is over.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: later stages survive lost executors.

    The shuffle files that led to it go with the write, so only tables and the step at work take disk.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(_nullable(df.schema)).parquet(path)
    out._scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables from ``stored`` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        with contextlib.suppress(Exception):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` with the columns of ``ddl`` after its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to kernels by ``BATCH``, not by 10,000 rows: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_sha256(column: str | Column) -> Column:
    return F.sha2(F.col(column) if isinstance(column, str) else column, 256)


# ---------------------------------------------------------------- Arrow text

#: The white space of ``[^\x20\x09-\x0D]+``; in UTF-8 no other character holds these bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def arrow_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    data, offsets = arrow_bytes(column)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


# ------------------------------------------------------------------- hashing

_ODD = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Spans of more bytes than this are hashed one by one, by BLAKE2b.
LONG = 32
_TAIL = ~np.uint64(0) >> (np.uint64(64) - np.arange(1, 9, dtype=np.uint64) * np.uint64(8))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of a key depends on all of its input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, zeros past the end; a view, n + 1 places."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, long: int = LONG, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end]: eight bytes a step, each mixed with all before, so no sums or powers that cancel.

    ``fold``: A-Z count as a-z. Spans of more than ``long`` bytes go by BLAKE2b. Other seeds, other hashes.
    """
    n = ends - starts
    words = eights(FOLD[data] if fold else data)
    out = mix(n.astype(np.uint64) + _STEP + np.uint64(seed))
    rows, done = np.flatnonzero((n > 0) & (n <= long)), 0
    while len(rows):
        left = n[rows] - done
        out[rows] = mix(out[rows] * _ODD ^ (words[starts[rows] + done] & _TAIL[np.minimum(left, 8) - 1]))
        rows, done = rows[left > 8], done + 8
    raw = memoryview(words.base)
    for i in np.flatnonzero(n > long).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def _factors(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP + np.uint64(seed)) | np.uint64(1)


def run_hash(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int, seed: int = 0) -> np.ndarray:
    """Hash of each run values[start : start + size] of hashed values, with a factor of its own for each place; other seeds, other hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if isinstance(sizes, int):
        factors = _factors(sizes, seed)
        out = values[starts] * factors[0]
        for k in range(1, sizes):
            out += values[starts + k] * factors[k]
        return mix(out + np.uint64(sizes))
    factors = _factors(int(sizes.max()), seed)
    out, rows, k = sizes.astype(np.uint64), np.flatnonzero(sizes > 0), 0
    while len(rows):
        out[rows] += values[starts[rows] + k] * factors[k]
        k += 1
        rows = rows[sizes[rows] > k]
    return mix(out)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word ``[^\x20\x09-\x0D]+``; words don't cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(SPACE[data], out=inside[1:])
    first = inside[1:] & ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges + 1]
    last = inside[1:].copy()
    last[:-1] &= ~inside[2:]
    before = edges[edges > 0]
    last[before - 1] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the text number of each word."""
    starts, ends, doc = word_spans(data, offsets)
    return span_hash(data, starts, ends, fold), doc


def gram_hashes(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside one text, and the number of its first word."""
    at = np.flatnonzero(doc[size - 1 :] == doc[: len(doc) - size + 1]) if len(doc) >= size else np.zeros(0, np.int64)
    return run_hash(words, at, size), at


# ---------------------------------------------------------------- components


def components(edges: DataFrame, label: str, max_rounds: int = 40) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b: long); component is the least id reachable.

    Alternating star contraction: each round links every vertex's larger neighbours, and
    then all of its neighbours, to its least neighbour. Neighbour lists are never gathered:
    a round is two min-aggregations, combined before the shuffle, and joins that Spark can
    split, so a vertex with a third of all edges does no harm. Rounds grow with the log of
    the longest path; whether any vertex is left to move, one number, is all the driver sees.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-edges")
    ends = lambda u, v: F.explode(F.array(F.struct(F.col(u).alias("u"), F.col(v).alias("v")), F.struct(F.col(v).alias("u"), F.col(u).alias("v")))).alias("e")
    for _ in range(max_rounds):
        # A forest of stars is final: each leaf has one centre, and no vertex is both.
        roles = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("x"), F.lit(0).alias("leaf")))).alias("r"))
        roles = roles.groupBy("r.x").agg(F.sum("r.leaf").alias("leaves"), F.min("r.leaf").alias("least"))
        if not roles.where("leaves > 1 OR (leaves = 1 AND least = 0)").limit(1).count():
            centres = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres)
        both = now.select(ends("u", "v")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # Large star: neighbours greater than u go to the least of u and its neighbours.
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{label}-large")
        dropped(now)
        # Small star: all lesser neighbours of u, and u, go to the least of them.
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = stored(small.select("e.u", "e.v").where("u <> v").distinct(), f"{label}-round")
        dropped(large)
    raise RuntimeError("components did not settle")
