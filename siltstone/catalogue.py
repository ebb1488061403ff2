"""Queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions.chunking import ChunkOptions, chunk_files, cut_sql
from .operators import chunks as C
from .operators import paths as P
from .operators import planning as L
from .sources.files import DOCUMENT_FILES_SQL, PAGE_FILES_SQL, document_files, page_files, table, stored

AVG = 256
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or run.__name__] = run
        if sql:
            ORACLE_SQL[name or run.__name__] = sql
        return run

    return add


def document_chunks(spark: SparkSession, sf_dir: str, avg: int = AVG) -> DataFrame:
    """Chunks of all documents, hashes only."""
    return chunk_files(document_files(spark, sf_dir), ChunkOptions(avg), data=False)


def with_chunks(select: str, avg: int = AVG, files: str = DOCUMENT_FILES_SQL) -> str:
    return f"WITH RECURSIVE {cut_sql(ChunkOptions(avg), files)}\n{select}"


def with_files(select: str, files: str = DOCUMENT_FILES_SQL) -> str:
    return f"WITH files AS ({files}) {select}"


def literals(spark: SparkSession, ddl: str, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


# ------------------------------------------------------------------ files


@query(with_files("SELECT rel_path, folder, orig_size FROM files"))
def file_listing(spark, sf_dir):
    return document_files(spark, sf_dir).select("rel_path", "folder", "orig_size")


@query(with_files("SELECT folder, count(*) AS files, sum(orig_size)::BIGINT AS bytes FROM files GROUP BY folder"))
def folder_rollup(spark, sf_dir):
    return L.folder_rollup(document_files(spark, sf_dir))


@query(with_files("SELECT count(*) FILTER (instr(folder, '/') = 0) AS top_folders, CASE WHEN count(*) FILTER (instr(folder, '/') = 0) >= 16 THEN 'folder' ELSE 'file' END AS parallelism FROM (SELECT DISTINCT folder FROM files)"))
def parallelism_choice(spark, sf_dir):
    return L.parallelism(document_files(spark, sf_dir), 8)


@query(with_files("SELECT rel_path, orig_size, row_number() OVER (ORDER BY orig_size DESC, rel_path) AS place FROM files QUALIFY place <= 100"))
def largest_first(spark, sf_dir):
    top = L.largest_first(document_files(spark, sf_dir)).limit(100)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("orig_size"), "rel_path")))


@query(with_files("SELECT rel_path, orig_size, row_number() OVER (ORDER BY orig_size DESC NULLS LAST, rel_path NULLS LAST) AS place FROM files"))
def largest_first_all(spark, sf_dir):
    return L.numbered_largest_first(document_files(spark, sf_dir))


@query(with_files("SELECT sha256(content) AS digest, count(*) AS files, min(rel_path) AS first_path FROM files GROUP BY 1"))
def file_digest_dedup(spark, sf_dir):
    files = document_files(spark, sf_dir)
    return files.select(F.sha2("content", 256).alias("digest"), "rel_path").groupBy("digest").agg(F.count("*").alias("files"), F.min("rel_path").alias("first_path"))


@query(with_files("SELECT rel_path, count(*) AS copies FROM files GROUP BY rel_path HAVING count(*) > 1", PAGE_FILES_SQL))
def duplicate_paths(spark, sf_dir):
    return C.duplicate_paths(page_files(spark, sf_dir))


@query(with_files("SELECT rel_path, sha256(CASE WHEN octet_length(content) > 64 THEN unhex(substr(hex(content), 1, 128)) ELSE content END) AS head_sha256 FROM files"))
def head_sample(spark, sf_dir):
    return document_files(spark, sf_dir).select("rel_path", F.sha2(F.substring("content", 1, 64), 256).alias("head_sha256"))


# ----------------------------------------------------------------- chunks

_CHUNK_COLUMNS = ["rel_path", "chunk_idx", "chunk_offset", "chunk_len", "hash"]


def _cdc(avg: int):
    return lambda spark, sf_dir: document_chunks(spark, sf_dir, avg).select(*_CHUNK_COLUMNS)


for _avg in (256, 1024, 4096):
    query(with_chunks("SELECT * FROM chunks", _avg), f"cdc_chunks_{_avg}")(_cdc(_avg))

_STATS = """
SELECT coalesce(sum(n), 0)::BIGINT AS total_chunks, count(*) AS unique_chunks, coalesce(sum(n - 1), 0)::BIGINT AS deduped_chunks,
       coalesce(sum((n - 1) * greatest(1, len // 2)), 0)::BIGINT AS bytes_saved, {evicted}::BIGINT AS evictions,
       round(CASE WHEN sum(n) = 0 THEN 0.0 ELSE sum(n - 1)::DOUBLE * 100 / sum(n) END, 6) AS dedup_ratio
FROM (SELECT hash, count(*) AS n, any_value(chunk_len) AS len FROM chunks GROUP BY hash)"""


@query(with_chunks(_STATS.format(evicted="0")))
def chunk_dedup_stats(spark, sf_dir):
    return C.dedup_stats(document_chunks(spark, sf_dir))


@query(with_chunks("SELECT cap, greatest(0, u - cap)::BIGINT AS evictions, least(u, cap)::BIGINT AS resident FROM (SELECT count(DISTINCT hash) AS u FROM chunks), (VALUES (100::BIGINT), (1000), (1000000)) t(cap)"))
def store_capacity_stats(spark, sf_dir):
    unique = document_chunks(spark, sf_dir).agg(F.countDistinct("hash").alias("u"))
    caps = unique.withColumn("cap", F.explode(F.array(*[F.lit(c).cast("long") for c in (100, 1000, 1000000)])))
    return caps.select("cap", F.greatest(F.lit(0), F.col("u") - F.col("cap")).cast("long").alias("evictions"), F.least("u", "cap").alias("resident"))


@query(with_chunks("SELECT hash, any_value(chunk_len)::BIGINT AS original_size, count(*) AS refs, count(DISTINCT rel_path) AS files FROM chunks GROUP BY hash"))
def chunk_index(spark, sf_dir):
    return C.chunk_index(document_chunks(spark, sf_dir))


@query(with_chunks("SELECT rel_path, orig_size, coalesce(n, 0) AS n_chunks, sha256(coalesce(h, '')) AS list_sha256 FROM files LEFT JOIN (SELECT rel_path, count(*) AS n, string_agg(hash, '' ORDER BY chunk_idx) AS h FROM chunks GROUP BY rel_path) USING (rel_path)"))
def file_manifest(spark, sf_dir):
    files = document_files(spark, sf_dir)
    manifest = C.file_manifest(files, document_chunks(spark, sf_dir))
    return manifest.select("rel_path", "orig_size", F.size("chunk_hashes").cast("long").alias("n_chunks"), F.sha2(F.array_join("chunk_hashes", ""), 256).alias("list_sha256"))


_FIRST = "(SELECT hash, rel_path, chunk_idx, chunk_len FROM chunks QUALIFY row_number() OVER (PARTITION BY hash ORDER BY rel_path, chunk_idx) = 1)"


@query(with_chunks(f"SELECT * FROM {_FIRST}"))
def first_occurrence(spark, sf_dir):
    return C.first_occurrences(document_chunks(spark, sf_dir))


@query(with_chunks(f"SELECT hash, rel_path, chunk_idx, chunk_len, greatest(1, chunk_len // 2) AS compressed_size, coalesce(sum(greatest(1, chunk_len // 2)) OVER (ORDER BY regexp_extract(rel_path, '^(.*)/[^/]*$', 1), rel_path, chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_offset FROM {_FIRST}"))
def archive_offsets_est(spark, sf_dir):
    return C.archive_offsets(document_chunks(spark, sf_dir))


@query(with_chunks("SELECT coalesce(sum((n - 1) * greatest(1, len // 2)), 0)::BIGINT AS bytes_saved FROM (SELECT count(*) AS n, any_value(chunk_len) AS len FROM chunks GROUP BY hash)"))
def bytes_saved_est(spark, sf_dir):
    return C.dedup_stats(document_chunks(spark, sf_dir)).select("bytes_saved")


@query(with_chunks("SELECT (chunk_len // 64)::BIGINT AS size_class, count(*) AS chunks, sum(chunk_len)::BIGINT AS bytes FROM chunks GROUP BY 1"))
def chunk_size_histogram(spark, sf_dir):
    return document_chunks(spark, sf_dir).groupBy(F.floor(F.col("chunk_len") / 64).alias("size_class")).agg(F.count("*").alias("chunks"), F.sum("chunk_len").alias("bytes"))


@query(with_chunks("SELECT hash, count(DISTINCT regexp_extract(rel_path, '^(.*)/[^/]*$', 1)) AS folders, count(*) AS refs FROM chunks GROUP BY hash HAVING folders > 1"))
def cross_folder_shared_chunks(spark, sf_dir):
    c = document_chunks(spark, sf_dir).withColumn("folder", F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1))
    return c.groupBy("hash").agg(F.countDistinct("folder").alias("folders"), F.count("*").alias("refs")).where("folders > 1")


_PREFIX = "PREPENDED CONTENT: "


def _shifted_sql() -> str:
    shifted = f"SELECT rel_path, encode('{_PREFIX}' || decode(content)) AS content, octet_length(encode('{_PREFIX}' || decode(content)))::BIGINT AS orig_size FROM ({DOCUMENT_FILES_SQL})"
    both = f"SELECT 'a/' || rel_path AS rel_path, content, orig_size FROM ({DOCUMENT_FILES_SQL}) UNION ALL SELECT 'b/' || rel_path, content, orig_size FROM ({shifted})"
    return with_chunks("SELECT count(*) AS shifted_chunks, count(*) FILTER (hash IN (SELECT hash FROM chunks WHERE rel_path LIKE 'a/%')) AS shared_chunks FROM chunks WHERE rel_path LIKE 'b/%'", AVG, both)


@query(_shifted_sql())
def chunk_overlap_shifted(spark, sf_dir):
    files = document_files(spark, sf_dir)
    base = chunk_files(files, ChunkOptions(AVG), data=False)
    moved = chunk_files(files.withColumn("content", F.concat(F.lit(_PREFIX.encode()), "content")), ChunkOptions(AVG), data=False)
    shared = C.shared_between(base, moved).agg(F.count("*").alias("shared_chunks"))
    return moved.agg(F.count("*").alias("shifted_chunks")).crossJoin(F.broadcast(shared))  # one row each


@query(with_files("SELECT rel_path, sha256(content) AS digest, true AS size_ok FROM files"))
def roundtrip_digest(spark, sf_dir):
    """Cut, keep each distinct chunk once, put all files together again."""
    files = document_files(spark, sf_dir)
    c = chunk_files(files, ChunkOptions(AVG))
    data = c.groupBy("hash").agg(F.first("data").alias("data"))
    return C.restore(C.file_manifest(files, c), data).select("rel_path", F.sha2("content", 256).alias("digest"), "size_ok")


@query(with_files("SELECT rel_path, orig_size AS bytes, true AS tiles FROM files WHERE orig_size > 0"))
def chunk_tiling_check(spark, sf_dir):
    c = document_chunks(spark, sf_dir).groupBy("rel_path").agg(F.sum("chunk_len").alias("bytes"), F.max(F.col("chunk_offset") + F.col("chunk_len")).alias("end"), F.count("*").alias("n"), (F.max("chunk_idx") + 1).alias("m"))
    return c.select("rel_path", "bytes", ((F.col("bytes") == F.col("end")) & (F.col("n") == F.col("m"))).alias("tiles"))


_DAMAGED = "SELECT hash, chunk_len AS original_size FROM " + _FIRST + " WHERE substr(hash, 1, 1) <> '0' UNION ALL SELECT sha256('orphan-' || i::VARCHAR), 10 + i FROM range(5) t(i)"


def _damaged(c: DataFrame) -> DataFrame:
    """An index that lacks the hashes that begin with 0 and has five that nothing refers to."""
    orphans = c.sparkSession.range(5).select(F.sha2(F.concat(F.lit("orphan-"), F.col("id").cast("string")), 256).alias("hash"), (F.col("id") + 10).alias("original_size"))
    kept = c.groupBy("hash").agg(F.first("chunk_len").alias("original_size")).where(F.substring("hash", 1, 1) != "0")
    return kept.unionByName(orphans)


@query(with_chunks(f", damaged AS ({_DAMAGED}) SELECT rel_path, chunk_idx, hash FROM chunks WHERE hash NOT IN (SELECT hash FROM damaged)"))
def missing_chunks(spark, sf_dir):
    c = document_chunks(spark, sf_dir)
    return C.missing_chunks(c.select("rel_path", "chunk_idx", "hash"), _damaged(c)).select("rel_path", "chunk_idx", "hash")


@query(with_chunks(f", damaged AS ({_DAMAGED}) SELECT hash, original_size FROM damaged WHERE hash NOT IN (SELECT hash FROM chunks)"))
def orphaned_chunks(spark, sf_dir):
    c = document_chunks(spark, sf_dir)
    return C.orphaned_chunks(c, _damaged(c)).select("hash", "original_size")


@query(with_chunks(f""", damaged AS ({_DAMAGED})
SELECT (SELECT count(*) FROM files) AS files, (SELECT sum(orig_size)::BIGINT FROM files) AS orig_bytes,
       (SELECT count(*) FROM files WHERE orig_size = 0) AS empty_files, (SELECT count(*) FROM chunks) AS refs, (SELECT count(*) FROM damaged) AS index_chunks,
       (SELECT count(*) FROM chunks WHERE hash NOT IN (SELECT hash FROM damaged)) AS missing, (SELECT count(*) FROM damaged WHERE hash NOT IN (SELECT hash FROM chunks)) AS orphaned,
       0::BIGINT AS duplicate_paths, (SELECT count(*) FROM chunks WHERE hash NOT IN (SELECT hash FROM damaged)) = 0 AS is_valid"""))
def verify_summary(spark, sf_dir):
    """Structure of a chunked archive with a damaged index, as one row."""
    from .operators.verify import verify_chunked

    # Written once: four aggregates read the references.
    files, c = document_files(spark, sf_dir), stored(document_chunks(spark, sf_dir).drop("fingerprint"), "refs")
    return verify_chunked(files.select("rel_path", "orig_size"), c.select("rel_path", "chunk_idx", "hash"), _damaged(c))


# ------------------------------------------------------- plans and estimates

_SIZES = """SELECT version, archive_bytes::BIGINT AS archive_bytes FROM (
  SELECT 21 + (SELECT sum(26 + octet_length(encode(rel_path)) + greatest(1, orig_size // 2)) FROM files) AS v1,
         32 + 56 * count(*) + coalesce(sum(greatest(1, len // 2)), 0) + (SELECT sum(14 + octet_length(encode(rel_path)) + 32 * coalesce(n, 0)) FROM files LEFT JOIN (SELECT rel_path, count(*) AS n FROM chunks GROUP BY rel_path) USING (rel_path)) AS v2,
         29 + (SELECT sum(18 + octet_length(encode(rel_path)) + greatest(1, orig_size // 2)) FROM files) AS v3
  FROM (SELECT hash, any_value(chunk_len) AS len FROM chunks GROUP BY hash)
) UNPIVOT (archive_bytes FOR v IN (v1, v2, v3)), LATERAL (SELECT substr(v, 2)::INT AS version)"""


@query(with_chunks(_SIZES))
def archive_sizes(spark, sf_dir):
    return L.archive_sizes(document_files(spark, sf_dir), document_chunks(spark, sf_dir))


@query(with_chunks("SELECT 'zip' AS format, count(*) AS files, sum(orig_size)::BIGINT AS orig_bytes, sum(orig_size // 2)::BIGINT AS estimated_bytes FROM files UNION ALL SELECT 'xz', count(*), sum(orig_size)::BIGINT, sum(orig_size * 30 // 100)::BIGINT FROM files UNION ALL SELECT 'chunked', (SELECT count(*) FROM files), (SELECT sum(orig_size)::BIGINT FROM files), (SELECT sum(greatest(1, len // 2))::BIGINT FROM (SELECT any_value(chunk_len) AS len FROM chunks GROUP BY hash))"))
def dryrun_estimates(spark, sf_dir):
    return L.dry_run(document_files(spark, sf_dir), document_chunks(spark, sf_dir))


_PARAMS = "SELECT (CASE WHEN t < 10485760 THEN 32768 WHEN t < 104857600 THEN 65536 ELSE 114688 END)::BIGINT AS dict_size, greatest(least(t // n, 65536), 1024)::BIGINT AS sample_size, least(greatest(t // 20, (CASE WHEN t < 10485760 THEN 32768 WHEN t < 104857600 THEN 65536 ELSE 114688 END) * 8, n * 4096, 524288), 52428800)::BIGINT AS total_samples FROM (SELECT sum(orig_size)::BIGINT AS t, count(*) FILTER (orig_size > 0) AS n FROM files)"


@query(with_files(_PARAMS))
def dict_params(spark, sf_dir):
    return L.dictionary_params(document_files(spark, sf_dir))


@query(with_files(f"SELECT rel_path, b AS sample_bytes FROM (SELECT rel_path, b, total_samples, coalesce(sum(b) OVER (ORDER BY folder, rel_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT folder, rel_path, least(orig_size, sample_size) AS b, total_samples FROM files, ({_PARAMS})) WHERE b >= 64) WHERE before < total_samples"))
def dict_sample_plan(spark, sf_dir):
    files = document_files(spark, sf_dir)
    return L.sample_plan(files, L.dictionary_params(files))


@query("SELECT dict_size, samples, bytes, (CASE WHEN bytes < 2048 OR samples < 3 THEN 0 WHEN bytes < dict_size * 2 THEN greatest(bytes // 2, 1024) ELSE dict_size END)::BIGINT AS trained FROM (VALUES (32768::BIGINT, 2::BIGINT, 9000::BIGINT), (32768, 10, 2047), (32768, 10, 2048), (32768, 10, 40000), (32768, 10, 65536), (114688, 500, 9000000)) t(dict_size, samples, bytes)")
def dict_trained_size(spark, sf_dir):
    rows = literals(spark, "dict_size long, samples long, bytes long", [(32768, 2, 9000), (32768, 10, 2047), (32768, 10, 2048), (32768, 10, 40000), (32768, 10, 65536), (114688, 500, 9000000)])
    return rows.withColumn("trained", L.trained_size(F.col("bytes"), F.col("samples"), F.col("dict_size")))


@query(None)
def lpt_assignment(spark, sf_dir):
    return L.lpt_assignment(document_files(spark, sf_dir).select("orig_size"), 8)


@query("SELECT event_id, user_id, greatest(total - lag(total, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0)::BIGINT AS delta FROM (SELECT event_id, user_id, ts, (value * 100)::BIGINT AS total FROM (SELECT event_id, user_id, ts, floor(coalesce(value, 0)) AS value FROM events))")
def progress_deltas(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("total", (F.floor(F.coalesce("value", F.lit(0.0))) * 100).cast("long"))
    return L.progress_deltas(events, "user_id", ["ts", "event_id"], "total").select("event_id", "user_id", "delta")


# ---------------------------------------------------------------- scalars


@query(with_files("SELECT rel_path, CASE WHEN s >= 1073741824 THEN printf('%.2f GB', s / 1073741824.0) WHEN s >= 1048576 THEN printf('%.2f MB', s / 1048576.0) WHEN s >= 1024 THEN printf('%.2f KB', s / 1024.0) ELSE printf('%d B', s) END AS text FROM (SELECT rel_path, orig_size * 1000 AS s FROM files)"))
def format_size(spark, sf_dir):
    return document_files(spark, sf_dir).select("rel_path", S.format_size(F.col("orig_size") * 1000).alias("text"))


_SIZE_TEXTS = [("64KB", 64), ("1MB", 1024), ("2GB", 2097152), ("512B", 0), ("2048", 2), ("1.5m", 1536), (" 3k ", 3), ("0", 0), ("", 0), ("64 KB", None), ("KB", None), ("7XB", None), ("1TB", 1073741824)]


@query("SELECT text, kb::BIGINT AS kb FROM (VALUES " + ", ".join(f"('{t}', {'NULL' if k is None else k})" for t, k in _SIZE_TEXTS) + ") t(text, kb)")
def parse_size(spark, sf_dir):
    return literals(spark, "text string", [(t,) for t, _ in _SIZE_TEXTS]).withColumn("kb", S.parse_size(F.col("text")))


@query(with_files("SELECT rel_path, CASE WHEN octet_length(encode(rel_path)) <= 20 THEN rel_path WHEN octet_length(encode(name)) >= 17 THEN '...' || right(name, 17) ELSE '...' || right(rel_path, 17) END AS short FROM (SELECT rel_path, regexp_extract(rel_path, '[^/]*$') AS name FROM files)", PAGE_FILES_SQL))
def truncate_left(spark, sf_dir):
    return page_files(spark, sf_dir).select("rel_path", S.truncate_left(F.col("rel_path"), 20).alias("short"))


@query("SELECT level::BIGINT AS level, (CASE WHEN level <= 1 THEN -1 ELSE level - 1 END)::BIGINT AS deflate, (CASE WHEN level >= 7 THEN 67108864 ELSE 1 << (20 + level)::INT END)::BIGINT AS lzma_dict FROM range(1, 10) t(level)")
def level_maps(spark, sf_dir):
    level = F.col("id")
    return spark.range(1, 10).select(level.alias("level"), S.deflate_level(level).cast("long").alias("deflate"), S.lzma_dictionary(level).alias("lzma_dict"))


@query("SELECT total_kb::BIGINT AS total_kb, (CASE WHEN total_kb = 0 THEN 0 ELSE greatest(least(total_kb * 25 // 100, 4194304), 262144) END)::BIGINT AS auto_kb FROM (VALUES (0), (524288), (8388608), (33554432)) t(total_kb)")
def autosize_table(spark, sf_dir):
    return literals(spark, "total_kb long", [(0,), (524288,), (8388608,), (33554432,)]).withColumn("auto_kb", S.auto_memory_kb(F.col("total_kb")))


@query("SELECT store_mb::BIGINT AS store_mb, chunk::BIGINT AS chunk, (CASE WHEN store_mb = 0 THEN 0 ELSE greatest(1, store_mb::BIGINT * 1048576 // (chunk + 120)) END)::BIGINT AS entries FROM (VALUES (0, 65536), (1, 67108864), (512, 65536), (4096, 4096)) t(store_mb, chunk)")
def store_entries(spark, sf_dir):
    return literals(spark, "store_mb long, chunk long", [(0, 65536), (1, 67108864), (512, 65536), (4096, 4096)]).withColumn("entries", S.max_chunks(F.col("store_mb"), F.col("chunk")))


_HEADS = [(1, S.MAGIC_1 + b"xx", "ARCHIVE1"), (2, S.MAGIC_2, "ARCHIVE2"), (3, S.MAGIC_3 + b"\1", "ARCHIVE3"), (4, b"PK\3\4abcdef", "ZIP"), (5, b"\xfd7zXZ\0abc", "XZ"), (6, b"INVALIDMAGIC", "UNKNOWN"), (7, b"PK\3", "UNKNOWN"), (8, b"", "UNKNOWN")]


@query("SELECT id::BIGINT AS id, format FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, _, f in _HEADS) + ") t(id, format)")
def format_detect(spark, sf_dir):
    return literals(spark, "id long, content binary", [(i, bytearray(c)) for i, c, _ in _HEADS]).select("id", S.archive_format(F.col("content")).alias("format"))


@query("SELECT name, (regexp_replace(name, '(\\.tar\\.xz|\\.zip|\\.xz|\\.gdelta)$', '') || '.gdelta') AS delta, regexp_replace(name, '(\\.tar\\.xz|\\.zip|\\.xz|\\.gdelta)$', '') AS base FROM (VALUES ('a.zip'), ('b.tar.xz'), ('c'), ('d.xz'), ('e.gdelta')) t(name)")
def output_names(spark, sf_dir):
    return literals(spark, "name string", [("a.zip",), ("b.tar.xz",), ("c",), ("d.xz",), ("e.gdelta",)]).select("name", S.output_name(F.col("name"), "delta").alias("delta"), S.output_name(F.col("name"), "zip").alias("base"))


# ------------------------------------------------------------------ paths

_PARTS = ["a_01.zip", "a_02.zip", "a_04.zip", "b_02.zip", "c.zip", "d_01.zip", "e_1.zip", "f_00.zip"]
_PART_ROWS = [("a", 1, "a_01.zip"), ("a", 2, "a_02.zip"), ("d", 1, "d_01.zip"), ("b_02", 1, "b_02.zip")]


@query("SELECT base, part::INT AS part, name FROM (VALUES " + ", ".join(f"('{b}', {p}, '{n}')" for b, p, n in _PART_ROWS) + ") t(base, part, name)")
def multipart_groups(spark, sf_dir):
    return P.archive_parts(literals(spark, "name string", [(n,) for n in _PARTS]))


@query("""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS rel_path FROM pages)
SELECT rel_path, d AS depth, CASE WHEN d = 0 THEN '' ELSE array_to_string(list_filter(string_split(rel_path, '/')[:-2], lambda x: x <> '')[1:d], '/') END AS dir
FROM (SELECT rel_path, unnest(range(len(list_filter(string_split(rel_path, '/')[:-2], lambda x: x <> '')) + 1)) AS d FROM p)""")
def path_hierarchy(spark, sf_dir):
    return page_files(spark, sf_dir).select("rel_path").distinct().select("rel_path", F.posexplode(P.hierarchy("rel_path")).alias("depth", "dir")).withColumn("depth", F.col("depth").cast("long"))


_RULES = {"": "# comment\n\n*7*\n!*77*\n", "thhaed.example.com": "fr/\n"}


@query("""SELECT DISTINCT rel_path, (regexp_matches(rel_path, '7') AND NOT regexp_matches(rel_path, '77')) AS ignored
FROM (SELECT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS rel_path FROM pages) WHERE NOT starts_with(rel_path, 'thhaed.example.com/fr/')""")
def gitignore_filter(spark, sf_dir):
    rules = spark.createDataFrame(P.ignore_rules(_RULES), P.RULES_DDL)
    return P.ignored(page_files(spark, sf_dir), rules)


#: Hosts that the tables hold: of sf0.001, sf0.01, sf0.1 and larger ones.
_NESTED_RULES = {"": "*7*\n!*77*\n", "thther.example.com": "en/\n", "blog.tionsh.example.net": "en/\n", "blog.tionsh.example.com": "fr/\n", "tionsh.example.net": "fr/\n"}


@query("""SELECT DISTINCT rel_path, (regexp_matches(rel_path, '7') AND NOT regexp_matches(rel_path, '77'))
  OR regexp_matches(rel_path, '^(blog\\.tionsh\\.example\\.com|tionsh\\.example\\.net)/(.*/)?fr/')
  OR regexp_matches(rel_path, '^(thther\\.example\\.com|blog\\.tionsh\\.example\\.net)/(.*/)?en/') AS ignored
FROM (SELECT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS rel_path FROM pages)""")
def gitignore_nested(spark, sf_dir):
    rules = spark.createDataFrame(P.ignore_rules(_NESTED_RULES), P.RULES_DDL)
    return P.ignored(page_files(spark, sf_dir), rules)


_DIRS = ["build", "node_modules", "src", "debug.log", "a/temp", "a/b/temp", "temp", "src/build"]


@query("SELECT rel_path, pruned FROM (VALUES ('build', true), ('node_modules', true), ('src', false), ('debug.log', false), ('a/temp', true), ('a/b/temp', true), ('temp', true), ('src/build', true)) t(rel_path, pruned)")
def gitignore_prune(spark, sf_dir):
    rules = spark.createDataFrame(P.ignore_rules({"": "build/\nnode_modules/\n*.log\n**/temp/\n"}), P.RULES_DDL)
    return P.pruned_directories(literals(spark, "rel_path string", [(d,) for d in _DIRS]), rules)


_ENTRIES = [("foo.txt", "/data/extract/foo.txt"), ("sub/foo.txt", "/data/extract/sub/foo.txt"), ("../foo.txt", None), ("../../etc/passwd", None), ("sub/../../foo.txt", None), ("/etc/passwd", "/data/extract/etc/passwd"), ("../extract-evil/foo.txt", None), ("../extract/back.txt", "/data/extract/back.txt"), ("./a//b", "/data/extract/a/b")]


@query("SELECT entry, target FROM (VALUES " + ", ".join(f"('{e}', {'NULL' if t is None else repr(t)})" for e, t in _ENTRIES) + ") t(entry, target)")
def safe_paths(spark, sf_dir):
    return literals(spark, "entry string", [(e,) for e, _ in _ENTRIES]).withColumn("target", P.safe_join("/data/extract", F.col("entry")))


@query(with_files("SELECT (SELECT count(*) FROM files WHERE orig_size > 3000) AS errors, string_agg(rel_path, ', ' ORDER BY rel_path) AS first_ten, greatest((SELECT count(*) FROM files WHERE orig_size > 3000) - 10, 0) AS more FROM (SELECT rel_path FROM files WHERE orig_size > 3000 ORDER BY rel_path LIMIT 10)"))
def error_digest(spark, sf_dir):
    from .operators.verify import error_digest as digest

    return digest(document_files(spark, sf_dir).where("orig_size > 3000").select(F.col("rel_path").alias("error")))


_MODES = [(x, z, level, chunk, d) for x in (False, True) for z in (False, True) for level in (0, 9, 10, 23) for chunk in (0, 1024, 65536, 1 << 27) for d in (False, True)]


@query("""SELECT xz, zip, level::BIGINT AS level, chunk::BIGINT AS chunk, dictionary, CASE
  WHEN xz AND zip THEN 'XZ_NO_ZIP' WHEN xz AND l NOT BETWEEN 1 AND 9 THEN 'INVALID_LEVEL_XZ' WHEN xz AND chunk > 0 THEN 'XZ_NO_CHUNKING' WHEN xz AND dictionary THEN 'XZ_NO_DICTIONARY'
  WHEN zip AND l NOT BETWEEN 1 AND 9 THEN 'INVALID_LEVEL_ZIP' WHEN zip AND chunk > 0 THEN 'ZIP_NO_CHUNKING' WHEN zip AND dictionary THEN 'ZIP_NO_DICTIONARY'
  WHEN NOT xz AND NOT zip AND l NOT BETWEEN 1 AND 22 THEN 'INVALID_LEVEL_ZSTD' WHEN dictionary AND chunk > 0 THEN 'DICTIONARY_NO_CHUNKING'
  WHEN chunk > 0 AND chunk < 4096 THEN 'CHUNK_TOO_SMALL' WHEN chunk > 67108864 THEN 'CHUNK_TOO_LARGE' END AS error
FROM (SELECT *, CASE WHEN level = 0 THEN 5 ELSE level END AS l FROM (VALUES (false), (true)) a(xz), (VALUES (false), (true)) b(zip), (VALUES (0), (9), (10), (23)) c(level), (VALUES (0), (1024), (65536), (134217728)) d(chunk), (VALUES (false), (true)) e(dictionary))""")
def option_validation_matrix(spark, sf_dir):
    from .plans.options import mode_error_column

    rows = literals(spark, "xz boolean, zip boolean, level long, chunk long, dictionary boolean", _MODES)
    return rows.withColumn("error", mode_error_column(*[F.col(c) for c in ("xz", "zip", "level", "chunk", "dictionary")]))


# ------------------------------------------------------- codecs and archives


def _codec_roundtrip(codec: str):
    def run(spark, sf_dir):
        from .functions.codecs import compress_column, decompress_column

        packed = compress_column(document_files(spark, sf_dir).select("rel_path", "content"), "content", "packed", codec).select("rel_path", "packed")
        return decompress_column(packed, "packed", "content", codec).select("rel_path", F.sha2("content", 256).alias("digest"), "error")

    return run


for _codec in ("zlib", "lzma", "zstd"):
    query(with_files("SELECT rel_path, sha256(content) AS digest, NULL::VARCHAR AS error FROM files"), f"codec_roundtrip_{_codec}")(_codec_roundtrip(_codec))


@query(None)
def dict_vs_plain_sizes(spark, sf_dir):
    """Packed bytes with a dictionary of planned size and without one, by language."""
    from .functions.codecs import compress_column
    from .plans.engine import Engine

    files = document_files(spark, sf_dir)
    dictionary = Engine(spark).dictionary(files)
    both = compress_column(compress_column(files.select("folder", "content"), "content", "plain", "zstd"), "content", "packed", "zstd", 5, dictionary)
    return both.groupBy(F.substring_index("folder", "/", 1).alias("lang")).agg(F.count("*").alias("files"), F.sum(F.octet_length("plain")).alias("plain_bytes"), F.sum(F.octet_length("packed")).alias("dict_bytes"))


def _archived(files: DataFrame, archive: str, parts: int = 8, **options: str) -> DataFrame:
    """(path, content) of archives that hold ``files``, a part for each of so many groups of folders."""
    import pyarrow as pa

    from .sources.archives import WRITERS

    def write(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        pairs = sorted(zip(rows["rel_path"].to_pylist(), rows["content"].to_pylist(), strict=True))
        return pa.table({"path": [f"part_{key[0].as_py():02d}"], "content": pa.array([WRITERS[archive](pairs, {"average": "4096"} | options)], pa.binary())})

    keyed = files.select((F.pmod(F.xxhash64("rel_path"), F.lit(parts)) + 1).alias("part"), "rel_path", "content")
    return keyed.groupBy("part").applyInArrow(write, "path string, content binary")


def _archive_roundtrip(archive: str):
    def run(spark, sf_dir):
        from .plans.engine import Engine
        from .sources.archives import read_entries

        files = document_files(spark, sf_dir)
        options = {"dictionary": Engine(spark).dictionary(files).hex()} if archive == "3" else {}
        return read_entries(_archived(files, archive, **options)).select(F.col("path").alias("rel_path"), "original_size", F.sha2("content", 256).alias("digest"), "data_valid", "error")

    return run


for _archive, _name in (("1", "v1"), ("2", "v2"), ("3", "v3"), ("zip", "zip"), ("xz", "xz")):
    query(with_files("SELECT rel_path, orig_size AS original_size, sha256(content) AS digest, true AS data_valid, NULL::VARCHAR AS error FROM files"), f"archive_roundtrip_{_name}")(_archive_roundtrip(_archive))


@query(with_files("SELECT count(*) AS files, sum(orig_size)::BIGINT AS orig_bytes, count(*) FILTER (orig_size = 0) AS empty_files, 0::BIGINT AS duplicate_paths, count(*) AS verified, 0::BIGINT AS corrupt, true AS is_valid FROM files"))
def verify_archives(spark, sf_dir):
    from .operators.verify import verify_entries
    from .sources.archives import read_entries

    out = verify_entries(read_entries(_archived(document_files(spark, sf_dir), "2")))
    return out.select("files", "orig_bytes", "empty_files", "duplicate_paths", "verified", "corrupt", "is_valid")


@query(with_chunks("SELECT hash, any_value(chunk_len)::BIGINT AS chunk_len FROM chunks GROUP BY hash"))
def streaming_dedup(spark, sf_dir):
    import uuid

    from .sources.files import as_files, document_path, scratch_dir
    from .streaming.dedup import dedup_folder

    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    to_files = lambda d: as_files(d, document_path(), F.encode("text", "UTF-8"))
    return dedup_folder(spark, f"{sf_dir}/documents.parquet*", table(spark, sf_dir, "documents").schema, to_files, f"{base}/out", f"{base}/state", ChunkOptions(AVG))


@query(with_files("SELECT rel_path, orig_size, true AS in_index, true AS sizes_add_up FROM files"))
def archive_relations(spark, sf_dir):
    """Index and manifest of chunked archives as read from their bytes, joined: every reference is there and lengths add up."""
    from .sources.archives import archive_index, archive_manifest

    made = _archived(document_files(spark, sf_dir), "2")
    refs = archive_manifest(made).select("archive", "rel_path", "orig_size", F.posexplode_outer("chunk_hashes").alias("i", "hash"))
    joined = refs.join(archive_index(made), ["archive", "hash"], "left")
    out = joined.groupBy("rel_path", "orig_size").agg(F.bool_and(F.col("hash").isNull() | F.col("original_size").isNotNull()).alias("in_index"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("n"))
    return out.select("rel_path", "orig_size", "in_index", (F.col("n") == F.col("orig_size")).alias("sizes_add_up"))


@query(with_files("SELECT rel_path, ('0x' || substr(hex(content), 1, 2))::BIGINT + 256 * ('0x' || substr(hex(content), 3, 2))::BIGINT AS head, substr(sha256(content), 1, 16) AS prefix FROM files WHERE orig_size >= 2"))
def binary_heads(spark, sf_dir):
    files = document_files(spark, sf_dir).where("orig_size >= 2")
    return files.select("rel_path", S.little_endian(F.col("content"), 0, 2).alias("head"), S.hash_prefix(F.sha2("content", 256)).alias("prefix"))


@query("SELECT count(*) AS files, sum(octet_length(encode(string_agg)))::BIGINT AS bytes, max(turns) AS most_turns FROM (SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS string_agg FROM conversations GROUP BY conv_id)")
def conversation_listing(spark, sf_dir):
    from .sources.files import conversation_files

    files = conversation_files(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").count().agg(F.max("count").alias("most_turns"))
    return files.agg(F.count("*").alias("files"), F.sum("orig_size").alias("bytes")).crossJoin(F.broadcast(turns))  # one row each
