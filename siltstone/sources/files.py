"""Files as a relation: rel_path, folder, orig_size, content."""

from __future__ import annotations

import os.path
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILE_COLUMNS = ["rel_path", "folder", "orig_size", "content"]
FILE_DDL = "rel_path string, folder string, orig_size long, content binary"


def folder_of(path: str | Column) -> Column:
    """The parent of a path with forward slashes; empty at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def as_files(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """The relation from a path and a binary column."""
    return df.select(path.alias("rel_path"), content.alias("content")).select("rel_path", folder_of("rel_path").alias("folder"), F.octet_length("content").cast("long").alias("orig_size"), "content")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least: int = 16 << 20) -> DataFrame:
    """``df`` dealt evenly over all cores if its files hold under ``least`` bytes a core, by Spark's estimate.

    A small table may be one row group, which one task would read and work on alone. Beyond
    that size the files' own splits keep all cores busy, and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size < least * cores else df


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir``, or a temporary folder where that is absent, and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where there are no other machines."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (shared or tempfile.mkdtemp(prefix="siltstone-")).rstrip("/")


def running_before(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, in ``order``.

    Rows are dealt by ranges of the order and summed within their range; only a row for each range meets in a window. The ordered
    table is written before it is summed, so that retries can't change it.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_rb_at", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("_rb_part", F.shiftright("_rb_at", 33)), "running")
    up_to = lambda over: F.coalesce(F.sum(value).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy("_rb_part").agg(F.sum(value).alias(value))
    ranges = ranges.select("_rb_part", up_to(W.orderBy("_rb_part")).alias("_rb_before"))
    inside = dealt.withColumn(name, up_to(W.partitionBy("_rb_part").orderBy("_rb_at")))
    out = inside.join(F.broadcast(ranges), "_rb_part")  # a row for each range
    return out.withColumn(name, F.col(name) + F.col("_rb_before")).drop("_rb_part", "_rb_at", "_rb_before")


def document_path() -> Column:
    return F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document: lang/source/doc_id.txt."""
    return as_files(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")), document_path(), F.encode("text", "UTF-8"))


#: The same relation in DuckDB SQL.
DOCUMENT_FILES_SQL = "SELECT *, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS folder, octet_length(content)::BIGINT AS orig_size FROM (SELECT concat_ws('/', lang, source, doc_id::VARCHAR || '.txt') AS rel_path, encode(text) AS content FROM documents)"


def page_path() -> Column:
    """Host and path of the URL, less its scheme and query."""
    return F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "pages"), page_path(), F.encode("html", "UTF-8"))


PAGE_FILES_SQL = "SELECT *, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS folder, octet_length(content)::BIGINT AS orig_size FROM (SELECT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS rel_path, encode(html) AS content FROM pages)"


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each conversation, its turns in order, a line each."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    return as_files(turns, F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".txt")), F.encode(text, "UTF-8"))


def scan_directory(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """All regular files below ``root``, paths relative to it.

    Spark's reader leaves out files of no bytes and names that begin with a dot or underscore, so these
    are added from its own listing, which holds names and sizes only.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.resolvePath(fs_path).toString().rstrip("/")
    single = fs.getFileStatus(fs_path).isFile()
    relative = F.element_at(F.split("path", "/"), -1) if single else F.substring(F.col("path"), len(base) + 2, 1 << 30)
    normal = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("path", normal)
    found = as_files(read, F.concat(F.lit(prefix), relative), F.col("content"))
    left_out, walk = [], None if single else fs.listFiles(fs_path, True)
    while walk is not None and walk.hasNext():
        status = walk.next()
        uri = status.getPath().toString()
        name = uri[len(base) + 1 :]
        if status.getLen() == 0 or any(part[:1] in "._" for part in name.split("/")):
            left_out.append((prefix + name, uri, status.getLen()))
    if not left_out:
        return found
    rest = spark.createDataFrame(left_out, "rel_path string, uri string, size long").mapInArrow(_read_whole, "rel_path string, content binary")
    seen = found.join(rest.select("rel_path"), "rel_path", "left_anti").select(*FILE_COLUMNS)
    return seen.unionByName(as_files(rest, F.col("rel_path"), F.col("content")))


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files by URI, one to a batch."""
    from pyarrow import fs

    for batch in batches:
        for name, uri, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            system, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
            data = system.open_input_stream(path).read() if size else b""
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["rel_path", "content"])


def scan_list(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Files and directories mixed: a directory's entries go below its own name, a file keeps its name."""
    parts = []
    for path in paths:
        name = os.path.basename(path.rstrip("/"))
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        is_file = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs_path).isFile()
        parts.append(scan_directory(spark, path, "" if is_file else f"{name}/"))
    if not parts:
        raise ValueError("no input")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def head_sample(files: DataFrame, limit: int | Column) -> DataFrame:
    """The first ``limit`` bytes of each file."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    return files.withColumn("sample", F.expr("substring(content, 1, 0)") if limit == 0 else F.substring(F.col("content"), F.lit(1), n.cast("int")))
