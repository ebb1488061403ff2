"""Language identification by rank-order profiles.

A text's letters are lower-cased, other characters become one blank, and its n-grams of one to
three characters are ranked by frequency (ties by code). A language's profile is the same over
all of its learning texts. A text is compared with each profile by the out-of-place distance: for each of its
``top`` most frequent n-grams the difference of ranks, or ``top`` where the profile lacks it.

Plan: one pass counts n-grams per language in each block of text (numpy), Spark adds the
counts up, ``top`` rows for each language reach the driver and go to the executors; a
second pass scores whole texts. Neither pass moves texts. Profiles hold ``top`` entries for
each language value, so the broadcast is bounded by the label set, not by the data.

Cases: null text or none of letters: ``und`` with score 0. No learning text at all: ``und``
for all. Ties between languages go to the one whose name comes first. A null id is never held out nor
learned from. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, extended, table, text_blocks

TOP = 400
MAX_N = 3
#: N-grams are counted and scored by blocks of so many bytes, or of one longer text: about 100 bytes of memory for each.
BLOCK = 1 << 19
_LOW: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 32 if it is none."""
    if not _LOW:
        low = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low[c] = ord(x.lower()[0])
        _LOW.append(low)
    return _LOW[0]


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with blanks of length one between words and texts, and each one's text."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = (data & 0xC0) != 0x80
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.concatenate([[0], np.cumsum(first)])[offsets]))
    low = _letters()[points]
    # A blank before each text, so that no n-gram crosses texts; runs of blanks shrink to one.
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    low, doc = np.insert(low, starts, 32), np.insert(doc, starts, doc[starts]) if len(doc) else doc
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | (doc[1:] != doc[:-1])
    return low[keep].astype(np.int64), doc[keep]


def _grams(low: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of length 1 to MAX_N but for the blank, and their texts."""
    codes, docs, code = [], [], low
    for n in range(1, MAX_N + 1):
        if n > 1:
            code = (code[:-1] << 21) | low[n - 1 :]
        if len(code) <= 0:
            break
        ok = doc[: len(code)] == doc[n - 1 :]
        # No n-gram has a blank inside: one at the end marks the end of a word, at the start its start.
        if n == 1:
            ok = low != 32
        elif n == 3:
            ok = ok & (low[1:-1] != 32)
        codes.append(code[ok])
        docs.append(doc[: len(code)][ok])
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(docs)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), added up within each block."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for lang in dict.fromkeys(langs):
            texts = batch.column(1).filter(pa.array(langs == lang))
            for _, _, data, offsets in text_blocks(texts, BLOCK):
                if len(data):
                    gram, n = np.unique(_grams(*_code_points(data, offsets))[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def learn(texts: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> dict[str, np.ndarray]:
    """The ``top`` n-gram codes of each language, most frequent first, over all rows of ``texts``."""
    rows = texts.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    bounded_batches(texts.sparkSession)
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))).where(F.col("rank") <= top)
    out: dict[str, list] = {}
    for r in ranked.select("lang", "rank", "gram").collect():
        out.setdefault(r.lang, []).append((r.rank, r.gram))
    return {k: np.array([g for _, g in sorted(v)], np.int64) for k, v in sorted(out.items())}


class Scorer:
    """Out-of-place distances of texts to profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int):
        self.names, self.top = list(profiles), top
        self.known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.names), len(self.known) + 1), -1, np.int32)
        for i, grams in enumerate(profiles.values()):
            self.ranks[i, np.searchsorted(self.known, grams)] = np.arange(len(grams))

    def best(self, gram: np.ndarray, n: np.ndarray) -> tuple[str, float]:
        order = np.lexsort((gram, -n))[: self.top] if len(gram) <= 4 * self.top else self._most(gram, n)
        gram = gram[order]
        at = np.searchsorted(self.known, gram)
        at[at == len(self.known)] = 0
        at = np.where(self.known[at] == gram, at, len(self.known))
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, self.top, np.minimum(np.abs(ranks - np.arange(len(gram))), self.top)).sum(axis=1)
        i = int(np.argmin(away))
        return self.names[i], 1.0 - float(away[i]) / (self.top * len(gram))

    def _most(self, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
        least = np.partition(n, len(n) - self.top)[len(n) - self.top]
        some = np.flatnonzero(n >= least)
        return some[np.lexsort((gram[some], -n[some]))][: self.top]

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.names:
            return names, scores
        for start, _, data, offsets in text_blocks(texts, BLOCK):
            if not len(data):
                continue
            gram, doc = _grams(*_code_points(data, offsets))
            order = np.argsort(doc, kind="stable")
            gram, ends = gram[order], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))
            for i in np.flatnonzero(np.diff(ends, prepend=0)):
                own = np.sort(gram[ends[i - 1] if i else 0 : ends[i]])
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                names[start + i], scores[start + i] = self.best(own[first], np.diff(np.append(first, len(own))))
        return names, scores


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", top: int = TOP, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score, named as in ``out``; columns of these names are replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(profiles)
    keep = [c for c in docs.columns if c not in out]
    schema = extended(docs.select(*keep).schema, f"{out[0]} string, {out[1]} double")
    at = keep.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, top)
        for batch in batches:
            names, scores = scorer(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, *out])

    return docs.select(*keep).mapInArrow(score, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Profiles from the rows that aren't held out."""
    return learn(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()), lang_col, text_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with held_out, lang_pred and score; learned from the rows that aren't held out."""
    return predict(docs.withColumn("held_out", held_out(id_col)), learned(docs, id_col, text_col, lang_col), text_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


#: CRC-32 bit by bit; letters by their Unicode class. Distances are sums over the 400 most frequent n-grams of each text.
SQL = r"""
WITH d AS (
  SELECT doc_id, lang, string_split(' ' || ltrim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')), '') AS c,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384::BIGINT * (r & 1)) END)) % 3 = 1 AS held_out
  FROM documents
), i AS (SELECT doc_id, lang, held_out, c, unnest(range(1, len(c) + 1)) AS i FROM d),
g AS (
  SELECT doc_id, lang, held_out, unnest([
    CASE WHEN c[i] <> ' ' THEN unicode(c[i])::BIGINT END,
    CASE WHEN i + 1 <= len(c) THEN unicode(c[i])::BIGINT * 2097152 + unicode(c[i+1]) END,
    CASE WHEN i + 2 <= len(c) AND c[i+1] <> ' ' THEN (unicode(c[i])::BIGINT * 2097152 + unicode(c[i+1])) * 2097152 + unicode(c[i+2]) END]) AS x
  FROM i
), n AS MATERIALIZED (SELECT doc_id, lang, held_out, x, count(*) AS n FROM g WHERE x IS NOT NULL GROUP BY ALL),
profile AS MATERIALIZED (
  SELECT lang, x, r FROM (SELECT lang, x, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, x) - 1 AS r FROM n WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, x) WHERE r < 400
), own AS (SELECT * FROM (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, x) - 1 AS r FROM n) WHERE r < 400),
a AS (
  SELECT o.doc_id, l.lang, count(*) AS k, sum(CASE WHEN p.r IS NULL THEN 400 ELSE least(abs(p.r - o.r), 400) END) AS away
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.x = o.x GROUP BY o.doc_id, l.lang
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY away, lang) AS nth FROM a) WHERE nth = 1)
SELECT d.doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1.0::DOUBLE - away::DOUBLE / (400 * k)::DOUBLE, 0.0::DOUBLE) AS score
FROM d LEFT JOIN best b ON d.doc_id = b.doc_id
"""
