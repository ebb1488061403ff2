"""Quality classifier with hierarchical empirical Bayes over sites.

Two logistic models over hashed words, word shapes and vocabulary richness, one of quality and one of toxicity, give each
document its evidence: the log odds that it is good, of quality and not toxic. Good documents are counted over every path of every
host and over hosts: a labelled document counts by its label, any other as the chance that its evidence gives it;
a path's posterior mean is shrunk toward its host's, a host's toward the global mean, each
with a strength that the method of moments finds from the spread of group means (empirical Bayes).
A document's score is its evidence plus the log odds of its path less those of the training
rows: sparse sites lean on their host, sparse hosts on the corpus.

Fitted on about ``SAMPLE`` labelled rows (by hash of the id), and of a text on at most ``FIT_FEATURES`` features (those of least hash); all labels count in their sites, and everything else - scores, sites,
strengths - covers all documents. Group sums are combined before the shuffle, site tables join by path,
where Spark can split a hot site, and texts are not shuffled.

Cases: null or empty text has no features: its evidence is the intercept. Null host or path is a site of
its own. Null labels are left out; of several labels for an id the least quality and the greatest toxicity
count. Labels of one kind only: no feature counts, all have the intercept's evidence. Empty table: no rows. Repeated rows are scored
alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, extended, span_hash, stored, table, text_blocks, word_spans

SAMPLE = 20_000
FIT_FEATURES = 4096
FEATURE_BITS = 20
MIN_DOCS = 4
STANDS_OUT = 4.0
KEEP = 0.5
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
#: Bytes by kind: letters of either case, digits, and each mark as itself.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[0x61:0x7B], _KIND[0x80:], _KIND[0x41:0x5B], _KIND[0x30:0x3A] = ord("a"), ord("a"), ord("A"), ord("0")
_RICH = 16


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each feature that a text of the block has, once each, sorted."""
    n = len(offsets) - 1
    bare = data.copy()
    bare[_PUNCT[data]] = 0x20
    starts, ends, doc = word_spans(bare, offsets)
    words = span_hash(bare, starts, ends, fold=True)
    kind = _KIND[data]
    change = np.ones(len(data), bool)
    change[1:] = (kind[1:] != kind[:-1]) | SPACE[data[1:]]
    change[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.concatenate([[0], np.cumsum(change)])[offsets]
    starts, ends, shape_doc = word_spans(kind[change], at)
    shapes = span_hash(kind[change], starts, ends) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
    order = np.lexsort((words, doc))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    total, distinct = np.bincount(doc, minlength=n), np.bincount(doc[order][new], minlength=n)
    long_enough = np.flatnonzero(total >= 8)
    # Distinct words against what texts of that length usually have: about the 0.9th power.
    rich = np.minimum(distinct[long_enough] / total[long_enough] ** 0.9 * (_RICH - 1), _RICH - 1).astype(np.int64)
    space = (1 << FEATURE_BITS) - _RICH
    feature = np.concatenate([(words[order][new] % np.uint64(space)).astype(np.int64), (shapes % np.uint64(space)).astype(np.int64), space + rich])
    pair = np.unique(np.concatenate([doc[order][new], shape_doc, long_enough]).astype(np.int64) << FEATURE_BITS | feature)
    return pair >> FEATURE_BITS, pair & ((1 << FEATURE_BITS) - 1)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, data, offsets in text_blocks(batch.column(1)):
            doc, feature = features(data, offsets)
            nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
            doc, feature = doc[nth < FIT_FEATURES], feature[nth < FIT_FEATURES]
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=end - start))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(at, pa.array(feature.astype(np.int32)))], ["y", "features"])


def fit(y: np.ndarray, at: np.ndarray, feature: np.ndarray, rounds: int = 200, l2: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights by feature and the intercept: logistic regression on rows of unit length by accelerated gradient steps.

    Only features that stand out take part: in ``MIN_DOCS`` rows or more, and with a share of
    positive rows ``STANDS_OUT`` standard errors or more from the mean.
    """
    weights = np.zeros(1 << FEATURE_BITS)
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    b = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        return weights, b
    row = np.repeat(np.arange(len(y)), np.diff(at))
    df, positive = np.bincount(feature, minlength=1 << FEATURE_BITS), np.bincount(feature, y[row], 1 << FEATURE_BITS)
    known = (df >= MIN_DOCS) & (np.abs(positive - df * mean) >= STANDS_OUT * np.sqrt(df * mean * (1 - mean)))
    row, feature = row[known[feature]], feature[known[feature]]
    used, column = np.unique(feature, return_inverse=True)
    if not len(used):
        return weights, b
    value = (1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1)))[row]
    dot = lambda w: np.bincount(row, value * w[column], len(y))
    back = lambda e: np.bincount(column, value * e[row], len(used))
    w, curve = np.ones(len(used)), 1.0
    for _ in range(15):
        w = back(dot(w))
        curve = np.linalg.norm(w)
        w /= curve
    step = 1 / (0.25 * curve + l2)
    w, look, t = np.zeros(len(used)), np.zeros(len(used)), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(dot(look) + b)))
        new = look - step * (back(p - y) + l2 * look)
        b -= float((p - y).mean())
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, look = new, new + (old - 1) / t * (new - w)
    weights[used] = w
    return weights, b


def evidence(docs: DataFrame, models: list[tuple[np.ndarray, float]], text_col: str = "text") -> DataFrame:
    """``docs`` less the text, with evidence: log odds that it is of quality (first model) and not toxic (second)."""
    packed = [(np.flatnonzero(w).astype(np.int32), w[np.flatnonzero(w)].astype(np.float32), b) for w, b in models]
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    keep = [c for c in docs.columns if c not in (text_col, "evidence")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = []
        for at, w, b in shared.value:
            full = np.zeros(1 << FEATURE_BITS)
            full[at] = w
            dense.append((full, b))
        for batch in batches:
            parts = [np.zeros(0)]
            for start, end, data, offsets in text_blocks(batch.column(len(keep))):
                doc, feature = features(data, offsets)
                odds = []
                for full, b in dense:
                    own = full[feature]
                    n = np.bincount(doc, weights=own != 0, minlength=end - start)
                    odds.append(b + np.bincount(doc, own, end - start) / np.sqrt(np.maximum(n, 1)))
                good, bad = odds
                p = 1 / (1 + np.exp(-np.clip(good, -30, 30))) / (1 + np.exp(np.clip(bad, -30, 30)))
                parts.append(np.log(p / (1 - p)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(parts))], [*keep, "evidence"])

    return docs.select(*keep, text_col).mapInArrow(score, extended(docs.select(*keep).schema, "evidence double"))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: float) -> float:
    """Prior counts that the spread of group means around ``mean`` implies."""
    k, n, n2, scatter = groups.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * (F.col("good") / F.col("n") - mean) ** 2)).first()
    within = mean * (1 - mean)
    if not k or k < 2 or not within or n2 >= n * n:
        return 100.0
    between = (scatter - (k - 1) * within) / (n - n2 / n)
    return float(min(1e5, max(1.0, within / max(between, 1e-9) - 1)))


def site_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source", path: str | Column | None = None, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """(id, evidence, host_mean, path_mean, score, kept), a row for each of ``docs``."""
    host = F.col(host) if isinstance(host, str) else host
    path = F.concat_ws("/", host, F.col("lang")) if path is None else path
    labelled = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labelled = stored(labelled.select(F.col(id_col).alias("_sq_id"), (F.col("quality").cast("int") + 2 * F.col("toxic").cast("int")).alias("y")), "site-labels")
    share = min(1 << 30, -(-(sample << 30) // max(1, labelled.count())))
    chosen = labelled.where(F.pmod(F.xxhash64("_sq_id"), F.lit(1 << 30)) < share)
    rows = docs.select(id_col, F.col(text_col).alias("_sq_text")).join(F.broadcast(chosen), F.col(id_col) == F.col("_sq_id")).select("y", "_sq_text").mapInArrow(_listed, "y int, features array<int>").toArrow()
    lists = rows.column("features").combine_chunks()
    y, at = rows.column("y").to_numpy(), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    models = [fit((y & bit != 0).astype(float), at, lists.flatten().to_numpy().astype(np.int64)) for bit in (1, 2)]
    train_mean = float((y == 1).mean()) if len(y) else 0.5
    scored = evidence(docs.select(F.col(id_col), host.alias("host"), path.alias("path"), F.col(text_col).alias("_sq_text")), models, "_sq_text")
    scored = stored(scored, "site-evidence")
    known = scored.join(labelled, F.col(id_col) == F.col("_sq_id"), "left")
    p = F.when(F.col("y").isNotNull(), (F.col("y") == 1).cast("double")).otherwise(1 / (1 + F.exp(-F.col("evidence"))))
    paths = stored(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("good")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("good") / F.sum("n")).first()[0]
    mean = float(total) if total is not None else 0.5
    k_host, k_path = _strength(hosts, mean), _strength(paths, mean)
    hosts = stored(hosts.select(F.col("host").alias("h"), ((F.col("good") + k_host * mean) / (F.col("n") + k_host)).alias("host_mean")), "site-hosts")
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias("h"), F.col("path").alias("p"), "host_mean", ((F.col("good") + k_path * F.col("host_mean")) / (F.col("n") + k_path)).alias("path_mean"))
    sites = stored(sites, "site-means")
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_mean")) - _logit(F.lit(min(max(train_mean, 1e-6), 1 - 1e-6))))))
    return out.select(id_col, "host", "path", "evidence", "host_mean", "path_mean", score.alias("score")).withColumn("kept", F.col("score") >= keep)


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
