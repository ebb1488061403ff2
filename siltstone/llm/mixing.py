"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share all
words; a target stops at ``max_repeat`` times its source's words, the excess is reshared by
weight until none is above. That is water filling: with sources in the order of cap over
weight, the level is found from running sums.

Sampling: each document of a source expects target / source_size copies. Documents are put
in the order of (source, size, doc_id, text digest); expected copies are summed along it; one
offset per source, from a hash of seed and source, is added; a document is emitted once
for each integer that its share crosses. In order of size, words taken differ from the
target by less than about twice the largest document's.

Plan: a range partitioning by that order (a hot source spreads over many tasks), positions
within partitions, and a table of one row for each partition and source that turns them
into positions within sources; only that table meets in a window. Texts are not moved.
The ordered table is written before it is numbered, so that retries can't renumber.

Cases: null text or no word: size 0, and copies as for any document of the source (they
take 0 words). An empty table: no rows. Rows that are alike are numbered one after the
other and count each on its own. A source whose words are all 0 has target 0 and takes 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_width, stored, table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"


def n_words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source."""
    rank = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank + 1).cast("int")).cast("long")).withColumn("cap", max_repeat * F.col("source_size"))
    full = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    past = full.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    by = by.withColumns({
        "full_cap": F.coalesce(F.sum("cap").over(past), F.lit(0)),
        "full_weight": F.coalesce(F.sum("weight").over(past), F.lit(0)),
        "words": F.sum("source_size").over(every),
        "weights": F.sum("weight").over(every),
    })
    # The level if all sources before this one are full and this one isn't.
    level = (F.col("words") - F.col("full_cap")).cast("double") / (F.col("weights") - F.col("full_weight")).cast("double")
    by = by.withColumn("level", F.when(F.col("cap") >= level * F.col("weight"), level))
    by = by.withColumn("level", F.min(F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level")).over(W.partitionBy(F.col("level").isNull()))["level"]).withColumn("level", F.max("level").over(every))
    return by.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(id, key, size, source, source_size, target, copies), a row for each of ``docs``; key is the text's digest.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(source_col).alias("source"), n_words(text_col).alias("size"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"))
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("id").asc(), F.col("key").asc()]
    dealt = sized.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("at", 33)
    runs = dealt.groupBy("source", part.alias("part")).agg(F.min("at").alias("start"), F.count("*").alias("n"), F.sum("size").alias("words"))
    runs = stored(runs.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "mix-runs")
    goal = targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeat)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))), 1, 4), 16, 10).cast("double") / 65536
    goal = goal.withColumns({"rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)), "offset": offset})
    goal = runs.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select(F.col("r.source").alias("run_source"), F.col("part").alias("run_part"), "start", "before", "source_size", "target", "rate", "offset")
    placed = dealt.join(goal, F.col("source").eqNullSafe(F.col("run_source")) & (part == F.col("run_part")))
    nth = (F.col("at") - F.col("start") + F.col("before")).cast("double")
    crossed = F.floor((nth + 1) * F.col("rate") + F.col("offset")) - F.floor(nth * F.col("rate") + F.col("offset"))
    return placed.select("id", "key", "size", "source", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: columns as they were."""
    taken = copies(docs, id_col, text_col, source_col, **options)
    # Rows that share doc_id, text and source share what their places take, dealt out evenly.
    taken = taken.groupBy("id", "key", "source").agg(F.sum("copies").alias("_mx_all"), F.count("*").alias("_mx_rows")).withColumnsRenamed({"id": "_mx_id", "key": "_mx_key", "source": "_mx_source"})
    keyed = docs.withColumn("_mx_text", F.xxhash64(text_col))
    out = keyed.join(taken, F.col(id_col).eqNullSafe(F.col("_mx_id")) & (F.col("_mx_text") == F.col("_mx_key")) & F.col(source_col).eqNullSafe(F.col("_mx_source")))
    nth = F.row_number().over(W.partitionBy("_mx_id", "_mx_key", "_mx_source").orderBy(F.lit(1)))
    share = lambda n: F.floor(F.col("_mx_all") * n / F.col("_mx_rows"))
    single = out.where("_mx_rows = 1").withColumn("_mx_n", F.col("_mx_all"))
    several = out.where("_mx_rows > 1").withColumn("_mx_nth", nth).withColumn("_mx_n", share(F.col("_mx_nth")) - share(F.col("_mx_nth") - 1)).drop("_mx_nth")
    both = single.unionByName(several).where("_mx_n > 0")
    return both.withColumn("_mx_each", F.explode(F.array_repeat(F.lit(0), F.col("_mx_n").cast("int")))).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, cap / weight AS ratio,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_cap,
         coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_weight,
         (sum(source_size) OVER ())::BIGINT AS words, (sum(weight) OVER ())::BIGINT AS weights
  FROM s
), v AS (SELECT *, (words - full_cap)::DOUBLE / (weights - full_weight)::DOUBLE AS level FROM f),
lv AS (SELECT level FROM v WHERE cap >= level * weight ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, least(lv.level * weight, cap::DOUBLE) AS target,
         ('0x' || substr(md5('mix-1|' || coalesce('s' || source, 'n')), 1, 4))::BIGINT::DOUBLE / 65536 AS o
  FROM v, lv
), n AS (
  SELECT d.*, source_size, target, o, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         (row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id))::DOUBLE AS nth
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, source,
       (floor(nth * rate + o) - floor((nth - 1) * rate + o))::BIGINT AS copies,
       (floor(nth * rate + o) - floor((nth - 1) * rate + o))::BIGINT * size AS taken
FROM n
"""
