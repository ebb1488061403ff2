"""Plans over files before any byte is read: totals, parallelism, dictionaries, estimates."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heapreplace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import xz_estimate, zip_estimate
from ..sources.files import running_before, stored
from .chunks import chunk_estimate

MIN_DICT, MID_DICT, MAX_DICT = 32 << 10, 64 << 10, 112 << 10
MIN_SAMPLE = 64


def folder_rollup(files: DataFrame) -> DataFrame:
    return files.groupBy("folder").agg(F.count("*").alias("files"), F.sum("orig_size").alias("bytes"))


def parallelism(files: DataFrame, threads: int, wanted: str = "auto") -> DataFrame:
    """One row: top-level folders, and whether folders or files are dealt out."""
    top = files.select("folder").distinct().agg(F.count_if(F.instr("folder", "/") == 0).alias("top_folders"))
    choice = F.lit(wanted) if wanted != "auto" else F.when(F.col("top_folders") >= 2 * threads, "folder").otherwise("file")
    return top.withColumn("parallelism", choice)


def largest_first(files: DataFrame) -> DataFrame:
    return files.select("rel_path", "orig_size").orderBy(F.desc("orig_size"), "rel_path")


def numbered_largest_first(files: DataFrame) -> DataFrame:
    """(rel_path, orig_size, place) of every file, the largest first; null paths and sizes come last, files alike one after the other.

    Files are dealt by ranges of that order and numbered within their range; only a row for each range meets in a
    window. The ordered table is written before it is numbered, so that retries can't renumber.
    """
    spark = files.sparkSession
    order = [F.col("orig_size").desc_nulls_last(), F.col("rel_path").asc_nulls_last()]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("rel_path", "orig_size").repartitionByRange(width, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "largest-first")
    part = F.shiftright("at", 33).alias("part")
    ranges = dealt.groupBy(part).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("part", "start", before.alias("before"))
    placed = dealt.withColumn("part", part).join(F.broadcast(ranges), "part")  # a row for each range
    return placed.select("rel_path", "orig_size", (F.col("at") - F.col("start") + F.col("before") + 1).alias("place"))


def dictionary_params(files: DataFrame) -> DataFrame:
    """One row: dictionary size, sample size for each file, bytes of samples in all."""
    total = files.agg(F.coalesce(F.sum("orig_size"), F.lit(0)).alias("total"), F.count_if(F.col("orig_size") > 0).alias("n"))
    size = F.when(F.col("total") < 10 << 20, MIN_DICT).when(F.col("total") < 100 << 20, MID_DICT).otherwise(MAX_DICT)
    sample = F.greatest(F.least(F.floor(F.col("total") / F.col("n")), F.lit(64 << 10)), F.lit(1 << 10))
    samples = F.least(F.greatest(F.floor(F.col("total") / 20), size * 8, F.col("n") * 4096, F.lit(512 << 10)), F.lit(50 << 20))
    some = F.col("n") > 0
    return total.select(
        F.when(some, size).otherwise(MIN_DICT).cast("long").alias("dict_size"),
        F.when(some, sample).otherwise(16 << 10).cast("long").alias("sample_size"),
        F.when(some, samples).otherwise(1 << 20).cast("long").alias("total_samples"),
    )


def trained_size(sample_bytes: Column, samples: Column, dict_size: Column) -> Column:
    """Bytes of the dictionary that so many sample bytes can train; 0: none."""
    small = F.when(sample_bytes < dict_size * 2, F.greatest(F.floor(sample_bytes / 2), F.lit(1024))).otherwise(dict_size)
    return F.when((sample_bytes < 2048) | (samples < 3), F.lit(0)).otherwise(small).cast("long")


def sample_plan(files: DataFrame, params: DataFrame) -> DataFrame:
    """(rel_path, sample_bytes) in the order of (folder, rel_path), until the budget is reached; the file that crosses it stays.

    The running sum is taken over ranges of that order, so no window holds all files, nor a folder's.
    """
    sized = files.select("folder", "rel_path", "orig_size").crossJoin(F.broadcast(params))  # one row
    sized = sized.withColumn("sample_bytes", F.least("orig_size", "sample_size")).where(F.col("sample_bytes") >= MIN_SAMPLE)
    placed = running_before(sized, ["folder", "rel_path"], "sample_bytes", "before")
    return placed.where(F.col("before") < F.col("total_samples")).select("rel_path", "sample_bytes")


def dry_run(files: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(format, files, orig_bytes, estimated_bytes) of the formats that have an estimate."""
    size = F.col("orig_size")
    base = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("orig_bytes"), F.coalesce(F.sum(zip_estimate(size)), F.lit(0)).alias("zip"), F.coalesce(F.sum(xz_estimate(size)), F.lit(0)).alias("xz"))
    out = base.select(F.explode(F.array(F.struct(F.lit("zip").alias("format"), "files", "orig_bytes", F.col("zip").alias("estimated_bytes")), F.struct(F.lit("xz").alias("format"), "files", "orig_bytes", F.col("xz").alias("estimated_bytes")))).alias("x")).select("x.*")
    if chunks is not None:
        unique = chunks.groupBy("hash").agg(F.first("chunk_len").alias("n")).agg(F.coalesce(F.sum(chunk_estimate(F.col("n"))), F.lit(0)).alias("estimated_bytes"))
        out = out.unionByName(base.select(F.lit("chunked").alias("format"), "files", "orig_bytes").crossJoin(F.broadcast(unique)))  # one row each
    return out


def archive_sizes(files: DataFrame, chunks: DataFrame, dict_bytes: int = 0) -> DataFrame:
    """(version, archive_bytes) of the three archive layouts at the planned payload sizes."""
    path = F.octet_length("rel_path")
    payload = chunk_estimate(F.col("orig_size"))
    per_file = files.select("rel_path", "orig_size").join(chunks.groupBy("rel_path").agg(F.count("*").alias("n")), "rel_path", "left")
    sums = per_file.agg(F.coalesce(F.sum(26 + path + payload), F.lit(0)).alias("v1"), F.coalesce(F.sum(14 + path + 32 * F.coalesce("n", F.lit(0))), F.lit(0)).alias("v2"), F.coalesce(F.sum(18 + path + payload), F.lit(0)).alias("v3"))
    unique = chunks.groupBy("hash").agg(F.first("chunk_len").alias("len")).agg(F.count("*").alias("u"), F.coalesce(F.sum(chunk_estimate(F.col("len"))), F.lit(0)).alias("b"))
    both = sums.crossJoin(F.broadcast(unique))  # one row each
    rows = [F.struct(F.lit(v).alias("version"), size.cast("long").alias("archive_bytes")) for v, size in ((1, 21 + F.col("v1")), (2, 32 + 56 * F.col("u") + F.col("v2") + F.col("b")), (3, 29 + dict_bytes + F.col("v3")))]
    return both.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _fill(load: list[int], count: list[int], size: int, n: int) -> None:
    """``n`` tasks of one size, each to the least loaded worker (ties: the first), as if one by one."""
    workers = len(load)
    if size <= 0:
        count[min(range(workers), key=lambda w: (load[w], w))] += n
        return
    if n > workers:
        # Loads filled up to a level that one by one would reach with tasks to spare.
        below = (n - workers) * size
        for i, top in enumerate(ranked := sorted(load)):
            below += top
            level = below // (i + 1)
            if i + 1 == workers or level <= ranked[i + 1]:
                break
        for w in range(workers):
            whole = max(0, -((load[w] - level) // size))
            load[w], count[w], n = load[w] + whole * size, count[w] + whole, n - whole
    heap = [(x, w) for w, x in enumerate(load)]
    heapify(heap)
    for _ in range(n):
        x, w = heap[0]
        heapreplace(heap, (x + size, w))
        load[w], count[w] = x + size, count[w] + 1


def lpt_assignment(tasks: DataFrame, workers: int) -> DataFrame:
    """(worker, tasks, load): largest task first, to the least loaded worker (ties: the first), for reports.

    Tasks of a size are counted first; only exact sizes and their counts meet in the greedy step, which depends on
    all before it. They are read in order and not held. A null size counts as 0.
    """
    size = F.coalesce("orig_size", F.lit(0)).cast("long").alias("size")
    sizes = tasks.groupBy(size).agg(F.count("*").alias("n"))
    none = tasks.sparkSession.range(1).select(F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("n"))  # else no task runs for an empty table
    sizes = sizes.unionByName(none).repartition(1).sortWithinPartitions(F.desc("size"))

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load, count = [0] * workers, [0] * workers
        for rows in batches:
            for size, n in zip(rows["size"].tolist(), rows["n"].tolist(), strict=True):
                _fill(load, count, size, n)
        yield pd.DataFrame({"worker": range(workers), "tasks": count, "load": load})

    return sizes.mapInPandas(greedy, "worker int, tasks long, load long")


def progress_deltas(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``events`` with delta: what ``value`` grew by since the key's last event, never negative."""
    last = F.lag(value, 1, 0).over(W.partitionBy(key).orderBy(*order))
    return events.withColumn("delta", F.greatest(F.col(value) - last, F.lit(0)))
