"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines is hashed (128 bits, from two seeds). A window whose
hash also starts earlier - in a smaller doc_id, or earlier in the same document - is a
repeat, and each line that a repeat covers is removed; windows are judged on the input.

Plan: one pass hashes lines and windows; a count and minimum per hash is combined before
the shuffle, so a window that a third of all documents hold costs one row a task; repeats
are written to the scratch folder, and joined back with a join that Spark can split by
skew; positions are gathered per document, whose size bounds them. Texts are not shuffled
but for the last join on doc_id.

Cases: null or empty text, or fewer than three lines: no window, nothing removed (null stays
null). Windows of three blank lines don't count. Rows that share doc_id and text are one
document that is repeated, and all of them fare alike; rows that share only the doc_id are
ordered by the text's digest. A null doc_id comes first. Extra columns pass through;
working columns have a prefix of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_sha256

WINDOW = 3
_P = "_ld_"


def _windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, key, pos, h1, h2) of every window that has a word."""
    hashes = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("key"),
        F.split(F.col(text_col), "\n", -1).alias("lines"),
    ).where(F.size("lines") >= window)
    hashes = hashes.select(
        "id",
        "key",
        F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")).alias("w"))).alias("lines"),
    )
    at = lambda i, j: F.get("lines", i + j)
    runs = F.transform(
        F.sequence(F.lit(0), F.size("lines") - window),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*[at(i, j)["a"] for j in range(window)]).alias("h1"),
            F.xxhash64(F.lit(2), *[at(i, j)["b"] for j in range(window)]).alias("h2"),
            F.greatest(*[at(i, j)["w"] for j in range(window)]).alias("w"),
        ),
    )
    out = hashes.select("id", "key", F.explode(F.filter(runs, lambda r: r["w"])).alias("r"))
    return out.select("id", "key", "r.pos", "r.h1", "r.h2")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, out_cols: tuple[str, str] = ("n_lines", "n_lines_removed")) -> DataFrame:
    """``docs`` with repeated lines removed from the text, plus n_lines and n_lines_removed, named as in ``out_cols``; columns of these names are replaced."""
    windows = stored(_windows(docs, id_col, text_col, window), "line-windows")
    order = F.struct("id", "key", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last")
    first = stored(first.select("h1", "h2", "first"), "line-repeats")
    later = windows.join(first, ["h1", "h2"]).where(F.struct("id", "key", "pos") > F.col("first"))
    covered = later.groupBy("id", "key").agg(F.array_sort(F.collect_set("pos")).alias(f"{_P}starts")).withColumnsRenamed({"id": f"{_P}id", "key": f"{_P}key"})
    keyed = docs.withColumn(f"{_P}textkey", F.xxhash64(F.col(text_col)))
    out = keyed.join(covered, F.col(id_col).eqNullSafe(F.col(f"{_P}id")) & (F.col(f"{_P}textkey") == F.col(f"{_P}key")), "left")
    starts, lines = F.col(f"{_P}starts"), F.split(F.col(text_col), "\n", -1)
    n = F.size(starts)
    # Runs of covered lines: a start opens one if the start before is over a window away, and closes one likewise.
    at = F.sequence(F.lit(0), n - 1)
    opens = F.filter(at, lambda i: (i == 0) | (F.get(starts, i) - F.get(starts, i - 1) > window))
    closes = F.filter(at, lambda i: (i == n - 1) | (F.get(starts, i + 1) - F.get(starts, i) > window))
    out = out.withColumns({f"{_P}opens": F.transform(opens, lambda i: F.get(starts, i)), f"{_P}ends": F.transform(closes, lambda i: F.get(starts, i) + window), f"{_P}lines": lines})
    opens, ends, lines = F.col(f"{_P}opens"), F.col(f"{_P}ends"), F.col(f"{_P}lines")
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
    until = lambda i: F.coalesce(F.get(opens, i), F.size(lines))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(opens)), lambda i: F.slice(lines, before(i) + 1, until(i) - before(i))))
    removed = F.aggregate(F.zip_with(ends, opens, lambda e, o: e - o), F.lit(0), lambda a, x: a + x)
    out = out.withColumns(
        {
            f"{_P}text": F.when(starts.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
            out_cols[0]: F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"),
            out_cols[1]: F.coalesce(removed, F.lit(0)).cast("long"),
        }
    )
    keep = [F.col(f"{_P}text").alias(text_col) if c == text_col else F.col(c) for c in docs.columns if c not in out_cols]
    return out.select(*keep, *out_cols)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_lines_removed", text_sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, unnest(range(1, len(lines) - 1)) AS pos, lines FROM d WHERE len(lines) >= 3
), h AS (
  SELECT doc_id, pos, lines[pos:pos+2] AS win FROM w
), r AS (
  SELECT doc_id, pos, win, min((doc_id, pos)) OVER (PARTITION BY win) AS first FROM h
  WHERE regexp_matches(array_to_string(win, ' '), '[^\x20\x09-\x0D]')
), c AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM r, (VALUES (0), (1), (2)) t(k) WHERE (doc_id, pos) > first
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d
), k AS (
  SELECT l.doc_id, count(*) - count(c.pos) AS n, string_agg(line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS kept, count(c.pos) AS gone
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_lines_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
