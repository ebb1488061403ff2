"""Deduplication of chunks as relations: index, manifest, offsets, statistics, integrity.

All of these are DataFrame plans over ``chunks`` (rel_path, chunk_idx, chunk_len, hash, ...). First
occurrences follow (rel_path, chunk_idx). A hash that many files share is combined before the
shuffle: first occurrences are a minimum per hash, not a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import folder_of, running_before


def guarded_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, and 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") * 100 / whole)


def chunk_estimate(size: Column) -> Column:
    """Planned bytes of a compressed chunk: half, one at least."""
    return F.greatest(F.lit(1), F.floor(size / 2)).cast("long")


def first_occurrences(chunks: DataFrame) -> DataFrame:
    """(hash, rel_path, chunk_idx, chunk_len): where each distinct chunk comes first."""
    first = chunks.groupBy("hash").agg(F.min(F.struct("rel_path", "chunk_idx", "chunk_len")).alias("f"))
    return first.select("hash", "f.rel_path", "f.chunk_idx", "f.chunk_len")


def chunk_index(chunks: DataFrame) -> DataFrame:
    """(hash, original_size, refs, files): a row for each distinct chunk with its reference count."""
    return chunks.groupBy("hash").agg(F.first("chunk_len").alias("original_size"), F.count("*").alias("refs"), F.countDistinct("rel_path").alias("files"))


def file_manifest(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rel_path, orig_size, chunk_hashes): ordered hashes of every file, empty ones included."""
    lists = chunks.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "hash"))).alias("refs"))
    joined = files.select("rel_path", "orig_size").join(lists, "rel_path", "left")
    return joined.select("rel_path", "orig_size", F.coalesce(F.transform("refs", lambda r: r["hash"]), F.array().cast("array<string>")).alias("chunk_hashes"))


def archive_offsets(chunks: DataFrame, size: Column | None = None) -> DataFrame:
    """First occurrences with the offset of each in the data section, in the order of (folder, rel_path, chunk_idx).

    Offsets are running sums over ranges of that order: a folder with a third of all files spreads over many tasks.
    """
    first = first_occurrences(chunks).withColumn("compressed_size", size if size is not None else chunk_estimate(F.col("chunk_len")))
    placed = running_before(first.withColumn("folder", folder_of("rel_path")), ["folder", "rel_path", "chunk_idx"], "compressed_size", "data_offset")
    return placed.select("hash", "rel_path", "chunk_idx", "chunk_len", "compressed_size", "data_offset")


def dedup_stats(chunks: DataFrame, capacity: int = 0) -> DataFrame:
    """One row: total, unique, deduped, bytes saved by the estimate, evictions of a bounded lookup, ratio in percent."""
    per_hash = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.first("chunk_len").alias("len"))
    out = per_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"),
        F.count("*").alias("unique_chunks"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("deduped_chunks"),
        F.coalesce(F.sum((F.col("n") - 1) * chunk_estimate(F.col("len"))), F.lit(0)).cast("long").alias("bytes_saved"),
    )
    evicted = F.greatest(F.lit(0), F.col("unique_chunks") - capacity) if capacity else F.lit(0)
    return out.withColumn("evictions", evicted.cast("long")).withColumn("dedup_ratio", F.round(guarded_percent(F.col("deduped_chunks"), F.col("total_chunks")), 6))


def new_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """First occurrences that an existing index lacks: get-or-add as an anti join."""
    return first_occurrences(chunks).join(index.select("hash"), "hash", "left_anti")


def references(manifest: DataFrame) -> DataFrame:
    """(rel_path, chunk_idx, hash): a row for each reference of a manifest."""
    return manifest.select("rel_path", F.posexplode("chunk_hashes").alias("chunk_idx", "hash"))


def missing_chunks(refs: DataFrame, index: DataFrame) -> DataFrame:
    return refs.join(index.select("hash"), "hash", "left_anti")


def orphaned_chunks(refs: DataFrame, index: DataFrame) -> DataFrame:
    return index.join(refs.select("hash"), "hash", "left_anti")


def restore(manifest: DataFrame, data: DataFrame) -> DataFrame:
    """(rel_path, orig_size, content, size_ok) from ordered references and (hash, data).

    A file's chunks meet in one row, as its content must; the chunks of all others don't.
    """
    parts = references(manifest).join(data.select("hash", "data"), "hash", "left")
    whole = parts.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "data"))).alias("p"), F.count_if(F.col("data").isNull()).alias("gone"))
    joined = manifest.select("rel_path", "orig_size").join(whole, "rel_path", "left")
    content = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["data"])), ""))
    out = joined.select("rel_path", "orig_size", F.coalesce(content, F.lit(b"")).alias("content"), F.coalesce("gone", F.lit(0)).alias("missing"))
    return out.withColumn("size_ok", (F.octet_length("content") == F.col("orig_size")) & (F.col("missing") == 0))


def duplicate_paths(entries: DataFrame, path: str = "rel_path") -> DataFrame:
    """(path, copies) of paths that come twice or more."""
    return entries.groupBy(path).agg(F.count("*").alias("copies")).where("copies > 1")


def reject_duplicate_paths(files: DataFrame) -> DataFrame:
    """``files``, or an error that names a path that comes twice."""
    worst = duplicate_paths(files).limit(1).collect()
    if worst:
        raise ValueError(f"duplicate path: {worst[0][0]}")
    return files


def shared_between(left: DataFrame, right: DataFrame) -> DataFrame:
    """Chunks of ``right`` whose hash ``left`` has: what survives an edit."""
    return right.join(left.select("hash").distinct(), "hash", "left_semi")
