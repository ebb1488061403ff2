"""The three entry points over paths: compress, restore, verify. Each returns a one-row or per-file DataFrame."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import ChunkOptions, chunk_files
from ..functions.codecs import train_dictionary
from ..operators import paths as P
from ..operators.chunks import dedup_stats, guarded_percent, reject_duplicate_paths
from ..operators.planning import dictionary_params, dry_run, sample_plan, trained_size
from ..operators.verify import ratio_columns, verify_entries
from ..sources.archives import ENDINGS, load_archives, write_archive
from ..sources.files import head_sample, scan_directory, scan_list
from .options import PART_BYTES, CompressOptions, OptionError, RestoreOptions, VerifyOptions


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def scan(self, options: CompressOptions) -> DataFrame:
        """The files that the options name, less the ignored ones; a path that comes twice is an error."""
        files = scan_list(self.spark, options.files) if options.files else scan_directory(self.spark, options.input_path)
        if options.use_gitignore:
            rules = P.ignore_rules(P.discover_rules(files))
            if rules:
                files = P.kept_files(files, self.spark.createDataFrame(rules, P.RULES_DDL))
        return reject_duplicate_paths(files)

    def dictionary(self, files: DataFrame) -> bytes:
        """A dictionary from the planned samples: 50 MB of them at most, whatever the input."""
        params = dictionary_params(files)
        plan = sample_plan(files, params)
        p = params.first()
        samples = head_sample(files.join(plan, "rel_path"), p["sample_size"]).orderBy("rel_path").select("sample").toArrow().column(0).to_pylist()
        size = self.spark.range(1).select(trained_size(F.lit(sum(map(len, samples))), F.lit(len(samples)), F.lit(p["dict_size"]))).first()[0]
        return train_dictionary(samples, size)

    def compress(self, options: CompressOptions) -> DataFrame:
        """Write the archive, or with dry_run only plan it; one row of totals."""
        options = options.checked()
        files = self.scan(options)
        if files.limit(1).count() == 0:
            raise OptionError("NO_FILES")
        chunks = chunk_files(files, ChunkOptions(options.chunk_size), data=False) if options.chunk_size else None
        totals = files.agg(F.count("*").alias("files_total"), F.sum("orig_size").alias("orig_bytes"))
        if options.dry_run:
            estimate = dry_run(files, chunks).where(F.col("format") == {"2": "chunked", "xz": "xz"}.get(options.archive, "zip")).select(F.col("estimated_bytes").alias("archive_bytes"))
        else:
            extra = {"average": options.chunk_size} if options.archive == "2" else {"dictionary": self.dictionary(files)} if options.archive == "3" else {}
            base = os.path.abspath(options.output_path) if "://" not in options.output_path else options.output_path
            parts = options.parts or max(1, -(-totals.first()["orig_bytes"] // PART_BYTES))
            write_archive(files, base, options.archive, parts, level=options.level, **extra)
            named = rf"{re.escape(os.path.basename(base))}(_\d{{2,}})?{re.escape(ENDINGS[options.archive])}"
            estimate = self.spark.read.format("binaryFile").load(f"{base}*").where(F.element_at(F.split("path", "/"), -1).rlike(f"^{named}$")).agg(F.sum("length").alias("archive_bytes"))
        out = totals.crossJoin(F.broadcast(estimate))  # one row each
        if chunks is not None:
            capacity = options.chunk_store_mb * (1 << 20) // (options.chunk_size + 120)
            out = out.crossJoin(F.broadcast(dedup_stats(chunks, capacity)))
        return out.withColumn("compression_ratio", guarded_percent(F.col("archive_bytes"), F.col("orig_bytes")))

    def restore(self, options: RestoreOptions) -> DataFrame:
        """Write all entries below the output folder; (path, target, status) of each, nothing outside it."""
        options = options.checked()
        base = options.output_path if "://" in options.output_path else f"file://{os.path.abspath(options.output_path)}"
        root = _located(base)[1]
        entries = load_archives(self.spark, options.input_path).where("path IS NOT NULL")
        placed = entries.withColumn("target", P.safe_join(root, F.col("path")))
        overwrite = options.overwrite

        def write(batches):
            import pyarrow as pa
            from pyarrow import fs

            system = _located(base)[0]
            for batch in batches:
                status = []
                for target, content, error in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    if target is None:
                        status.append("UNSAFE_PATH")
                    elif error:
                        status.append(error)
                    elif not overwrite and system.get_file_info(target).type != fs.FileType.NotFound:
                        status.append("TARGET_EXISTS")
                    else:
                        system.create_dir(target.rpartition("/")[0], recursive=True)
                        with system.open_output_stream(target + ".part") as out:
                            out.write(content)
                        system.move(target + ".part", target)  # a retried task leaves whole files only
                        status.append("OK")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(status, pa.string())], ["path", "target", "status"])

        return placed.select("path", "target", "content", "error").mapInArrow(write, "path string, target string, status string")

    def verify(self, options: VerifyOptions) -> DataFrame:
        """One row about all archives at the path."""
        options = options.checked()
        entries = load_archives(self.spark, options.input_path, options.verify_data)
        out = verify_entries(entries).crossJoin(F.broadcast(entries.groupBy("archive", "format").agg(F.first("archive_bytes").alias("b")).agg(F.sum("b").alias("archive_bytes"), F.array_join(F.array_sort(F.collect_set("format")), ",").alias("format"))))
        return out.withColumns(ratio_columns(F.col("orig_bytes"), F.col("comp_bytes")))


def _located(uri: str) -> tuple:
    """The file system of a URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _exists(name: str) -> bool:
    if "://" not in name:
        return os.path.exists(name)
    from pyarrow import fs

    system, path = _located(name)
    return system.get_file_info(path).type != fs.FileType.NotFound


def resolve_input(name: str) -> str:
    """What a name without a known ending stands for: part 1 of a ZIP, a ZIP, else an archive."""
    if name.endswith((".gdelta", ".zip", ".xz")):
        return name
    for ending in ("_01.zip", ".zip"):
        if _exists(name + ending):
            return name + ending
    return name + ".gdelta"
