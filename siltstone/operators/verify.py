"""Integrity of archives as one-row aggregates over relations.

Orphaned chunks are counted but do not make an archive invalid; a chunk is corrupt if it can't be
decoded, has another length, or another hash than its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import guarded_percent, missing_chunks, orphaned_chunks


def verify_chunked(files: DataFrame, refs: DataFrame, index: DataFrame) -> DataFrame:
    """One row about files (rel_path, orig_size), references and an index (hash, original_size)."""
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("orig_size"), F.lit(0)).alias("orig_bytes"), F.count_if(F.col("orig_size") == 0).alias("empty_files"), (F.count("*") - F.countDistinct("rel_path")).alias("duplicate_paths"))
    parts = [
        refs.agg(F.count("*").alias("refs")),
        index.agg(F.count("*").alias("index_chunks")),
        missing_chunks(refs, index).agg(F.count("*").alias("missing")),
        orphaned_chunks(refs, index).agg(F.count("*").alias("orphaned")),
    ]
    for part in parts:
        f = f.crossJoin(F.broadcast(part))  # one row each
    return f.withColumn("is_valid", (F.col("missing") == 0) & (F.col("duplicate_paths") == 0)).select("files", "orig_bytes", "empty_files", "refs", "index_chunks", "missing", "orphaned", "duplicate_paths", "is_valid")


def verify_entries(entries: DataFrame) -> DataFrame:
    """One row about entries (path, original_size, compressed_size, data_valid, error)."""
    out = entries.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("original_size"), F.lit(0)).alias("orig_bytes"),
        F.sum("compressed_size").alias("comp_bytes"),
        F.count_if(F.col("original_size") == 0).alias("empty_files"),
        (F.count("path") - F.countDistinct("path")).alias("duplicate_paths"),
        F.count_if("data_valid").alias("verified"),
        F.count_if(~F.col("data_valid")).alias("corrupt"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    return out.withColumn("is_valid", (F.col("corrupt") == 0) & (F.col("duplicate_paths") == 0) & (F.col("errors") == 0))


def ratio_columns(orig: Column, comp: Column, index_chunks: Column | None = None, refs: Column | None = None, files: Column | None = None) -> dict[str, Column]:
    """Ratio, bytes saved (never negative) and its percentage; and for chunks their dedup ratio and number per file."""
    saved = F.greatest(orig - comp, F.lit(0))
    out = {"compression_ratio": guarded_percent(comp, orig), "space_saved": saved, "space_saved_percent": guarded_percent(saved, orig)}
    if index_chunks is not None and refs is not None:
        out["chunk_dedup_ratio"] = F.when(refs == 0, F.lit(0.0)).otherwise(F.greatest(guarded_percent(refs - index_chunks, refs), F.lit(0.0)))
        if files is not None:
            out["chunks_per_file"] = F.when(files == 0, F.lit(0.0)).otherwise(refs / files)
    return out


def error_digest(errors: DataFrame, shown: int = 10) -> DataFrame:
    """One row: errors, the first few, and how many more. A report's limit, nothing else depends on it."""
    total = errors.agg(F.count("*").alias("errors"))
    first = errors.orderBy("error").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("error")), ", ").alias("first_ten"))
    both = total.crossJoin(F.broadcast(first))  # one row each
    return both.select("errors", F.when(F.col("errors") > 0, F.col("first_ten")).alias("first_ten"), F.greatest(F.col("errors") - shown, F.lit(0)).cast("long").alias("more"))


def summary_text(summary: DataFrame, title: str = "archive") -> DataFrame:
    """One row of text: a line for each column of a one-row summary."""
    return summary.select(F.concat_ws("\n", F.lit(title), *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in summary.columns]).alias("summary"))
