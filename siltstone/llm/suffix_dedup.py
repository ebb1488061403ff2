"""Suffix-array dedup: each byte that a 50-byte string of an earlier document covers is removed.

Windows that can matter are ranked at 16, 32 and 50 bytes inside ranges of seeds. This is not distributed prefix doubling, in which Spark
would sort (position, rank, rank at the offset): that needs a row for each window, more than the disk allows; README has the figures.

-   Rank at 16 bytes. Every window of 50 bytes has an anchor, its leftmost least 16-byte seed. Seeds are
    sorted by ranges of their hash, a range to a group; those that one document alone has are unique
    and drop out (kept as a 16 MB bit table, whose collisions only keep more).
-   Positions of the windows that are left go, with the bytes that they reach, to the range of their anchor's
    seed, where all windows equal to them are too. There pairs of (rank, bytes at the
    offset) are sorted by NumPy for 16, 32 and 50 bytes, and reranked; what has become unique drops
    out at each step.
-   A class of equal windows gives the least doc_id, and every window of a later document is a span.

Runs of windows with one anchor travel as one stretch of bytes. Equal stretches of a block of text go as one
with a list of their places, so a passage that a third of all documents share costs its bytes once a block; where the
list is long only its least place goes with the bytes, and the list joins the verdict by the stretch's name.
Spans join the texts by doc_id once, at the end.

Cases: null or empty text: 0 bytes, nothing removed, the digest of nothing. Texts under 50 bytes stay. Rows
that share a doc_id never remove from each other, being no smaller; a null doc_id comes
before all. Very long texts are worked on in pieces that overlap. Runs of one character or period are two places each.
Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from .anchors import HOT, NO_ID, SENT, SPREAD, Stretches, all_spans, distinct, is_marked, keyed, leftmost_minima, merged, received, repeated_marks, runs, spread, with_spans
from .common import arrow_bytes, mix, shuffle_width, span_hash, stored, table

LENGTH = 50
SEED = 16
PIECE = 1 << 20


def _names(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the content data[a:b]."""
    return span_hash(data, a, b, long=4 * LENGTH), span_hash(data, a, b, long=4 * LENGTH, seed=1)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()


def pieces(offsets: np.ndarray, length: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, start, end) of pieces of at most ``piece`` bytes and an overlap, by lots of about as many."""
    docs, starts, ends, size = [], [], [], 0
    for i in np.flatnonzero(np.diff(offsets) >= length):
        for a in range(offsets[i], offsets[i + 1] - length + 1, piece):
            b = min(a + piece + length - 1, int(offsets[i + 1]))
            docs.append(i)
            starts.append(a)
            ends.append(b)
            size += b - a
            if size >= piece:
                yield np.array(docs), np.array(starts), np.array(ends)
                docs, starts, ends, size = [], [], [], 0
    if docs:
        yield np.array(docs), np.array(starts), np.array(ends)


def _lot(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a lot's pieces together, and n + 1 offsets."""
    return np.concatenate([data[a:b] for a, b in zip(starts, ends, strict=True)]), np.concatenate([[0], np.cumsum(ends - starts)])


def anchored(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds at each byte; start and anchor of each window inside one piece."""
    w = _words(data)
    seeds = mix(w[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ mix(w[8:])) if len(w) > 8 else np.zeros(0, np.uint64)
    minima = leftmost_minima(seeds, length - SEED + 1)
    inside = np.ones(len(minima), bool)
    for end in at[1:-1]:
        inside[max(0, end - length + 1) : end] = False
    start = np.flatnonzero(inside)
    return seeds, start, minima[start]


def equal_classes(lines: np.ndarray) -> np.ndarray:
    """A class number for each row of (n, 7) words of a window, or -1 if it is unique: rank pairs sorted at offsets 16, 32 and past the end."""
    out = np.full(len(lines), -1, np.int64)
    active = np.arange(len(lines))
    rank = np.zeros(len(lines), np.int64)
    for columns in ((0, 1), (2, 3), (4, 5, 6)):
        if not len(active):
            return out
        second = [lines[active, c] for c in columns]
        order = np.lexsort((*second[::-1], rank[active]))
        active = active[order]
        new = np.ones(len(active), bool)
        new[1:] = rank[active][1:] != rank[active][:-1]
        for x in second:
            new[1:] |= x[order][1:] != x[order][:-1]
        rank[active] = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))
        active = active[~(new & np.append(new[1:], True))]
    out[active] = rank[active]
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, key, spans) of the bytes that an earlier document has, from (id, key, text)."""
    if not SEED < length <= 7 * 8:
        raise ValueError(f"strings of {SEED + 1} to 56 bytes, as seven words hold them")
    spark, piece, most, in_row = docs.sparkSession, PIECE, anchors.POPULAR, anchors.APART
    power = max(6, min(20, (8 * shuffle_width(spark) - 1).bit_length()))

    def seeds(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, offsets = arrow_bytes(batch.column(2))
        ids = batch.column(0).to_numpy()
        for doc, starts, ends in pieces(offsets, length, piece):
            block, at = _lot(data, starts, ends)
            seed, _, anchor = anchored(block, at, length)
            anchor = np.unique(anchor)
            owner = ids[doc[np.searchsorted(at, anchor, side="right") - 1]]
            found = np.unique(np.stack([owner.view(np.uint64), seed[anchor]]), axis=1)  # once for each document
            yield found[1]

    marks = spark.sparkContext.broadcast(repeated_marks(docs, seeds, power))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretches]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(2))
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for doc, starts, ends in pieces(offsets, length, piece):
                block, at = _lot(data, starts, ends)
                seed, start, anchor = anchored(block, at, length)
                keep = is_marked(marks.value, seed[anchor])
                start, anchor = start[keep], anchor[keep]
                first = runs(anchor, start)
                if len(first):
                    a, b = start[first], start[np.append(first[1:], len(start)) - 1] + length
                    owner = np.searchsorted(at, a, side="right") - 1
                    place = starts[owner] - offsets[doc[owner]] + a - at[owner]
                    yield Stretches(block, a, b, *_names(block, a, b), seed[anchor[first]], ids[doc[owner]], keys[doc[owner]], place, length, most)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in stretches(batches):
            yield x.sent(power)

    def popular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in stretches(batches):
            yield x.apart(in_row)

    def rank(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        data, size, place, own = received(got, np.uint8)
        at = np.concatenate([[0], np.cumsum(size)])
        # Equal stretches of all blocks become one; the least id that has it stands for it.
        h1, h2 = _names(data, at[:-1], at[1:])
        pick, which = distinct(h1, h2)
        own = which[own]
        order = np.lexsort((place["at"], place["key"], place["id"], own))
        holder = place[order[np.searchsorted(own[order], np.arange(len(pick)))]]
        least = holder["id"]
        windows = size[pick] - length + 1
        start = np.repeat(at[pick] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
        stretch = np.repeat(np.arange(len(pick)), windows)
        w = _words(data)
        lines = np.stack([w[start + o] for o in (0, 8, 16, 24, 32, 40, length - 8)], axis=1)
        group = equal_classes(lines)
        del lines, w
        first = least[stretch]
        some = np.flatnonzero(group >= 0)
        by_group = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(by_group, group[some], first[some])
        earlier = np.zeros(len(group), bool)
        earlier[some] = by_group[group[some]] < first[some]
        # Later places of a stretch are covered in full, those of its least id where a class has an earlier one.
        hit = np.flatnonzero(earlier)
        head = np.flatnonzero(np.concatenate([np.ones(min(1, len(hit)), bool), (hit[1:] != hit[:-1] + 1) | (stretch[hit[1:]] != stretch[hit[:-1]])]))
        of, a, b = stretch[hit[head]], start[hit[head]], start[hit[np.append(head[1:], len(hit)) - 1]] + length if len(hit) else hit
        sub = np.stack([of, a - at[pick][of], b - at[pick][of]], axis=1)
        return spread(place, own, holder, size[pick], sub, h1[pick], h2[pick], True)

    long = docs.where(F.octet_length("text") >= length)
    found = stored(long.mapInArrow(emit, SENT).groupBy("range").applyInArrow(rank, SPREAD), "suffix-spans")
    return all_spans(found, long.mapInArrow(popular, HOT), True)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256), a row for each of ``docs``; kept is binary, as a cut may part a character."""
    rows = keyed(docs, id_col, text_col)
    spans = stored(repeated_spans(rows, length), "suffix-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, count, kept = [], [], [], []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                data, gone = text.as_buffer().to_pybytes(), merged(spans.as_py())
                edges = [0, *gone.ravel().tolist(), len(data)]
                n.append(len(data))
                count.append(len(gone))
                removed.append(int((gone[:, 1] - gone[:, 0]).sum()))
                kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([None if i == NO_ID else i for i in ids], pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()),
                pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            ], [id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return with_spans(rows, spans).select("id", "key", "text", "spans").mapInArrow(cut, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, t[p+1:p+50] AS x FROM (SELECT doc_id, unnest(range(n - 49)) AS p, t FROM b WHERE n >= 50)),
m AS (SELECT x, min(doc_id) AS first FROM w GROUP BY x HAVING min(doc_id) < max(doc_id)),
e AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true) AS opens FROM w JOIN m ON w.x = m.x WHERE first < doc_id),
r AS (SELECT doc_id, p, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM e),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM r GROUP BY doc_id, k),
g AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, list_append(list(a ORDER BY a), NULL) AS a, list_prepend(0, list(z ORDER BY a)) AS z FROM s GROUP BY doc_id)
SELECT b.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN spans IS NULL THEN t ELSE unhex(array_to_string(list_transform(range(1, spans + 2), lambda j: hex(t[z[j]+1:coalesce(a[j], n)])), '')) END) AS kept_sha256
FROM b LEFT JOIN g ON b.doc_id = g.doc_id
"""
