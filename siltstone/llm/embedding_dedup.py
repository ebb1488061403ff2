"""Embedding near-dedup by product quantisation: inverted lists, residual codes, exact rerank.

Unit vectors go to the list of their nearest centroid, and their residual is coded per subspace. A
vector is looked up in its nearest lists, as many as suffice: for vectors of the sample a partner is made up at exactly the
threshold, in a random direction, and the least number of probes is taken at which ``FOUND`` of these pairs
meet, one vector of a pair probing the list of the other. Nearer partners, and so all links, are found more often. In a list, table lookups
give the exact distance to each coded vector; that less the coding error, which is stored, bounds the true
distance from below. What the bound cannot refute is reranked by cosine in double precision, so no pair below the threshold is reported.

The number of lists grows with the vectors, about one for ``LIST`` of them, so a vector is compared with as many others
whatever the table's size: up to ``TOP`` centroids, and then, for each of these, centroids of the residuals, which all share.

Fitted on a bounded sample: about ``SAMPLE`` distinct vectors, by hash of the id, train centroids and codebooks and set
the number of probes; every vector is indexed and looked up.

Equal vectors are one class with a multiplicity, so a vector that a third of all rows repeat is
one row. A list is compared in blocks of at most about ``BLOCK`` vectors by ``QUERIES`` lookups,
each a group of its own, so neither dense lists nor popular ones meet in one task. A
block returns a count for each vector, and the edges of a spanning forest, not its pairs. A vector of the list
counts a lookup's vector only if its own probes miss that one's list; else it finds it there itself.

Cases: vectors that are null, zero, empty, or hold null or non-finite components, and rows with a null id, link with
nothing (0 links, their own component, kept). Vectors of different lengths don't link. Equal distances to centroids: the first
one; reruns agree, as the sample goes by id and the seed is fixed. Rows that share an id count as rows of one vector. Empty table: no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, dropped, extended, stored, table

THRESHOLD = 0.95
SAMPLE = 20_000
LIST = 200
TOP = 1024
#: Share of made-up pairs at the threshold that have to meet, and how many of them are tried.
FOUND = 0.998
TRIED = 4000
SUBSPACES = 16
CODES = 64
BLOCK = 4096
QUERIES = 8192


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """At most k centroids of the rows of x, each the mean of its rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest(x, c)
        total, n = np.zeros_like(c), np.bincount(at, minlength=len(c))
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to each of c."""
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


class Quantiser:
    """Lists (a centroid and a centroid of what is left) and, per subspace, codebooks of residuals."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float):
        self.dim = sample.shape[1]
        self.top = kmeans(sample, min(lists, TOP, len(sample)), 12)
        rest = sample - self.top[nearest(sample, self.top)]
        more = -(-lists // len(self.top))
        self.sub = kmeans(rest, more, 12) if more > 1 else np.zeros((1, self.dim))
        self.cuts = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        rest = sample - self.centre(self.home(sample))
        self.books = [kmeans(rest[:, a:b], CODES, 8) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.probes = self._sufficient(sample, threshold)

    def home(self, x: np.ndarray) -> np.ndarray:
        top = nearest(x, self.top)
        return top * len(self.sub) + (nearest(x - self.top[top], self.sub) if len(self.sub) > 1 else 0)

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.top[cell // len(self.sub)] + self.sub[cell % len(self.sub)]

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        """The home of each row, and the n - 1 lists nearest to it besides, by distance."""
        n = min(n, len(self.top) * len(self.sub))
        out = []
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024]
            far, home = _far(part, self.top), self.home(part)
            if len(self.sub) > 1:
                # Sub-lists of the n nearest centroids: each of n such lists at the least.
                tops = np.argpartition(far, min(n, len(self.top)) - 1, axis=1)[:, :n]
                inner = (self.sub * self.sub).sum(1) - 2 * part @ self.sub.T
                cross = 2 * self.top @ self.sub.T
                cells = (tops[:, :, None] * len(self.sub) + np.arange(len(self.sub))).reshape(len(part), -1)
                far = (np.take_along_axis(far, tops, 1)[:, :, None] + inner[:, None, :] + cross[tops]).reshape(len(part), -1)
            else:
                cells = np.broadcast_to(np.arange(len(self.top)), far.shape)
            far = np.where(cells == home[:, None], -np.inf, far)
            some = np.argpartition(far, n - 1, axis=1)[:, :n]
            order = np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable")
            out.append(np.take_along_axis(np.take_along_axis(cells, some, 1), order, 1))
        return np.concatenate(out).astype(np.int32) if out else np.zeros((0, n), np.int32)

    def _sufficient(self, sample: np.ndarray, threshold: float) -> int:
        rng = np.random.default_rng(3)
        x = sample[rng.permutation(len(sample))[:TRIED]]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        size = np.sqrt((away * away).sum(1, keepdims=True))
        y = threshold * x + np.sqrt(1 - threshold**2) * np.divide(away, size, out=np.zeros_like(away), where=size > 1e-9)
        most = min(len(self.top) * len(self.sub), 256)
        rank = []
        for a, b in ((x, y), (y, x)):
            hit = self.near(a, most) == self.home(b)[:, None]
            rank.append(np.where(hit.any(axis=1), hit.argmax(axis=1), most - 1))
        return int(np.quantile(np.minimum(*rank), FOUND, method="higher")) + 1

    def code(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and coding error of each row."""
        rest = x - self.centre(cell)
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], axis=1).astype(np.uint8)
        back = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((rest - back) ** 2).sum(1))

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distance of each row of q to each coded vector of a list, by table lookups."""
        rest = q - self.centre(cell)
        out = np.zeros((len(q), len(codes)), np.float32)
        for m, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            lookup = ((rest[:, a:b, None] - book.T[None]) ** 2).sum(1).astype(np.float32)
            out += lookup[:, codes[:, m]]
        return np.sqrt(out)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to dim, in double precision."""
    out = np.zeros((len(column), dim))
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and (size == dim).all():
        return values.reshape(-1, dim).astype(np.float64)
    out[np.repeat(np.arange(len(column)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        big = np.abs(x).max(axis=1, keepdims=True)
        x = x / big
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _spans(hits: list[np.ndarray], queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Edges (query, base) of a spanning forest of the block's links."""
    label, edges = np.arange(len(base)), []
    for q, own in zip(queries, hits, strict=True):
        if len(own):
            found, first = np.unique(label[own], return_index=True)
            edges += [(q, base[own[i]]) for i in first]
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
    return np.array(edges, np.int64).reshape(-1, 2)


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each of ``vectors``."""
    spark = vectors.sparkSession
    r = float(np.sqrt(2 - 2 * threshold))
    element = vectors.schema[vec_col].dataType.elementType
    kind = element if isinstance(element, T.FloatType) else T.DoubleType()
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(T.ArrayType(kind)).alias("vec"))
    usable = F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & F.exists("vec", lambda v: v != 0)
    named = named.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # A class is known by its least id and its vector: rows that share an id may differ.
    classes = named.where("usable").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"))
    classes = stored(classes.select(F.xxhash64("rep", "vec").alias("cls"), "rep", "times", F.size("vec").alias("dim"), "vec"), "pq-classes")
    bare = named.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    n, dim = classes.agg(F.count("*"), F.max("dim")).first()
    if not n:
        return bare
    share = min(1 << 30, -(-(SAMPLE << 30) // n))
    sample = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < share).select("cls", "vec").toArrow().sort_by("cls").column("vec").combine_chunks()
    # A hash can pass over a handful of rows altogether.
    sample = sample if len(sample) else classes.select("vec").limit(1).toArrow().column("vec").combine_chunks()
    shared = spark.sparkContext.broadcast(Quantiser(_unit(_matrix(sample, dim)), -(-n // LIST), threshold))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            x = _unit(_matrix(batch.column("vec"), dim))
            cells = q.near(x, q.probes)
            codes, error = q.code(x, cells[:, 0])
            at = pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells[:, 0]), pa.ListArray.from_arrays(at, pa.array(cells.ravel())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float32))], [*batch.schema.names, "home", "cells", "codes", "error"])

    coded = stored(classes.mapInArrow(assign, extended(classes.schema, "home int, cells array<int>, codes binary, error float")), "pq-coded")
    # Lists with more vectors, or lookups, than a block holds; at most one for so many rows.
    probes = coded.select(F.explode("cells").alias("cell"), (F.col("home") == F.col("cell")).cast("int").alias("own"))
    dense = probes.groupBy("cell").agg(F.ceil(F.sum("own") / BLOCK).alias("bs"), F.ceil(F.count("*") / QUERIES).alias("qs")).where("bs > 1 OR qs > 1")
    dense = stored(dense.select("cell", F.greatest("bs", F.lit(1)).cast("long").alias("bs"), F.col("qs").cast("long").alias("qs")), "pq-dense")
    one = F.lit(1).cast("long")
    upto = lambda k: F.sequence(F.lit(0).cast("long"), F.coalesce(k, one) - 1)
    cols = ["cell", "b", "q", "side", "rep", "cls", "times", "dim", "vec", "home", "cells", "codes", "error"]
    home = coded.withColumn("cell", F.col("home")).join(dense, "cell", "left").withColumn("b", F.pmod(F.xxhash64("cls"), F.coalesce("bs", one))).withColumn("q", F.explode(upto(F.col("qs"))))
    home = home.withColumn("side", F.lit(0)).select(*cols)
    away = coded.withColumn("cell", F.explode("cells")).join(dense, "cell", "left").withColumn("q", F.pmod(F.xxhash64("cls", F.lit(1)), F.coalesce("qs", one))).withColumn("b", F.explode(upto(F.col("bs"))))
    away = away.withColumns({"side": F.lit(1), "cells": F.lit(None).cast("array<int>"), "codes": F.lit(None).cast("binary"), "error": F.lit(None).cast("float")}).select(*cols)

    def compare(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        q, cell = shared.value, key[0].as_py()
        side = got["side"].to_numpy()
        base, query = (got.filter(pa.array(side == s)).combine_chunks() for s in (0, 1))
        raw_b, raw_q = (_matrix(t["vec"].combine_chunks(), dim) if len(t) else np.zeros((0, dim)) for t in (base, query))
        cls_b, cls_q, rep_b, rep_q = base["cls"].to_numpy(), query["cls"].to_numpy(), base["rep"].to_numpy(), query["rep"].to_numpy()
        times, dim_b, dim_q, error = base["times"].to_numpy(), base["dim"].to_numpy(), query["dim"].to_numpy(), base["error"].to_numpy()
        times_q, home_q = query["times"].to_numpy(), query["home"].to_numpy()
        hits, counts, back = [], np.zeros(len(query), np.int64), np.zeros(len(base), np.int64)
        if len(base) and len(query):
            codes = np.stack([np.frombuffer(c.as_buffer(), np.uint8) for c in base["codes"]])
            probed = base["cells"].combine_chunks().flatten().to_numpy().reshape(len(base), -1)
            unit_q, norm_b, norm_q = _unit(raw_q), np.sqrt((raw_b**2).sum(1)), np.sqrt((raw_q**2).sum(1))
            for i in range(0, len(query), 512):
                rows = slice(i, min(i + 512, len(query)))
                may = q.distances(unit_q[rows], cell, codes) <= r + error + np.float32(1e-4)
                may &= (dim_q[rows][:, None] == dim_b) & (cls_q[rows][:, None] != cls_b)
                x, y = np.nonzero(may)
                if len(x) > 0.05 * may.size:
                    cos = ((raw_q[rows] @ raw_b.T) / (norm_q[rows][:, None] * norm_b))[x, y]
                else:
                    cos = np.einsum("ij,ij->i", raw_q[rows][x], raw_b[y]) / (norm_q[rows][x] * norm_b[y])
                x, y = x[cos >= threshold], y[cos >= threshold]
                counts[rows] = np.bincount(x, times[y], may.shape[0]).astype(np.int64)
                unseen = ~(probed[y] == home_q[rows][x][:, None]).any(axis=1)
                back += np.bincount(y[unseen], times_q[rows][x[unseen]], len(base)).astype(np.int64)
                hits += np.split(y, np.searchsorted(x, np.arange(1, may.shape[0])))
        edges = _spans(hits, rep_q[: len(hits)], rep_b)
        cls, counts = np.concatenate([cls_q, cls_b]), np.concatenate([counts, back])
        some = np.flatnonzero(counts)
        none = pa.nulls(len(edges), pa.int64())
        return pa.table({
            "cls": pa.concat_arrays([pa.array(cls[some]), none]),
            "n": pa.concat_arrays([pa.array(counts[some]), none]),
            "a": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(edges[:, 0])]),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(edges[:, 1])]),
        })

    found = stored(home.unionByName(away).groupBy("cell", "b", "q").applyInArrow(compare, "cls long, n long, a long, b long"), "pq-found")
    counts = found.where("cls IS NOT NULL").groupBy("cls").agg(F.sum("n").alias("linked"))
    comp = stored(components(found.where("a IS NOT NULL").select("a", "b"), "pq"), "pq-components")
    facts = classes.select("rep", "times", "cls", "vec").join(counts, "cls", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    facts = facts.select("vec", (F.col("times") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    facts = stored(facts, "pq-facts")
    dropped(classes, coded, dense, found, comp)
    out = named.where("usable").join(facts, "vec").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(bare)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM (SELECT * FROM e WHERE ok) a, (SELECT * FROM e WHERE ok) b
  WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), r AS (
  SELECT vec_id AS u, vec_id AS w FROM e UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, e.vec_id = c AS kept
FROM e LEFT JOIN (SELECT u, count(*) AS n FROM l GROUP BY u) k ON e.vec_id = k.u
JOIN (SELECT u, min(w) AS c FROM r GROUP BY u) m ON e.vec_id = m.u
"""
