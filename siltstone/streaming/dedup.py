"""Incremental deduplication with Structured Streaming.

State is one hash for each distinct chunk, kept by its shuffle partition, so each key has one
writer, on disk in RocksDB, not in the executors' heap. There is no event time: a chunk seen once counts for ever, and the state grows
with distinct chunks; a watermark would change results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.chunking import ChunkOptions, chunk_files


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_chunks(files: DataFrame, options: ChunkOptions) -> DataFrame:
    """Chunks of a stream of (rel_path, content), with totals as observed metrics of each batch."""
    chunks = chunk_files(files, options, data=False)
    return chunks.observe("chunks", F.count("*").alias("chunks"), F.sum("chunk_len").alias("bytes"))


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """Each hash once, when it first comes."""
    return chunks.select("hash", "chunk_len").dropDuplicates(["hash"])


def run_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once by the checkpoint, until the input is used up."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def dedup_folder(spark: SparkSession, files_path: str, schema: str, to_files, out: str, checkpoint: str, options: ChunkOptions) -> DataFrame:
    """Distinct chunks of all Parquet files in a folder, new files adding to what ``out`` holds."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(files_path)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run_to(distinct_chunks(stream_chunks(to_files(stream), options)), out, checkpoint).awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema("hash string, chunk_len long").parquet(out)
