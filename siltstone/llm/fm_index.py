"""Substring dedup by a compressed FM-index for each shard.

A window is 20 consecutive words of one document; each word that a window covers whose words also start
earlier is removed. Every window has an anchor, its leftmost least seed of eight words. Seeds
that occur once rule windows out (a 16 MB bit table, whose collisions only keep more);
the stretches of the others go to the shard of their seed, so a window meets all windows equal to
it in one shard, and each stretch is streamed through one index, not through all of them.

A shard is a range of seed hashes. It holds the Burrows-Wheeler transform of its distinct stretches as
a wavelet matrix: a bit a level with counts of ones every 64 bits, n log2(sigma) bits in all, and every fourth place of the
suffix array. Stretches are streamed through it: from each of their windows' ends, backward search narrows the interval of what ends
there, word by word, while it holds two occurrences or more; the length reached is the matching statistic of that end, counted to 20
words. Intervals of 20 words are reported, and the least place in an interval, found by steps to the left from its
suffixes, decides which of its windows is first.

Equal stretches of a block of text travel once with a list of their places. Spans join the texts by doc_id
once, at the end.

Cases: null or empty text, or under 20 words: nothing removed. Null doc_id comes first. Rows that share doc_id
and text are one document, and fare alike; rows that share only the doc_id are ordered by the text's digest. Empty
table: no rows. Extra columns are ignored, whatever their names. Very long texts are blocks of their own, about 60 bytes of memory for each
byte; one of 2^28 words or more is an error.
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
from .common import run_hash, shuffle_width, stored, table, text_blocks, word_hashes

WORDS = 20
SEED = 8
#: One place of so many is kept of a suffix array.
KEPT = 4


def _names(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the content words[a:b]."""
    return run_hash(words, a, b - a), run_hash(words, a, b - a, seed=1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in their order, where each symbol 0 is one of its own, less than the next: no comparison goes past it."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (text[order][1:] == 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    active, span = order[~(new & np.append(new[1:], True))], 1
    while len(active):
        second = np.where(active + span < n, rank[np.minimum(active + span, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        head = np.ones(len(active), bool)
        head[1:] = rank[active][1:] != rank[active][:-1]
        new = head.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(active))
        rank[active] += np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        active, span = active[~(new & np.append(new[1:], True))], span * 2
    return np.argsort(rank, kind="stable")


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector a level, most significant bit first."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n, self.levels = len(values), []
        for level in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bit = (values >> level & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((level, words, ones, self.n - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place ``at`` is among the symbols at the bottom level, going down by the bits of ``symbol``."""
        for level, words, ones, zeros in self.levels:
            block = at >> 6
            one = ones[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> level & 1 == 1, zeros + one, at - one)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and where it is at the bottom level."""
        symbol = np.zeros(len(at), np.int64)
        for level, words, ones, zeros in self.levels:
            block, bit = at >> 6, (at & 63).astype(np.uint64)
            one = ones[block] + np.bitwise_count(words[block] & ((np.uint64(1) << bit) - np.uint64(1)))
            own = words[block] >> bit & np.uint64(1) == 1
            symbol |= own.astype(np.int64) << level
            at = np.where(own, zeros + one, at - one)
        return symbol, at


class FMIndex:
    """Backward search over a text of symbols 0 (a separator) to sigma - 1; of the suffix array only every ``KEPT``-th place of the text is kept."""

    def __init__(self, text: np.ndarray, sigma: int):
        sa = suffix_array(text)
        self.matrix = WaveletMatrix(text[sa - 1], sigma)  # the symbol before place 0 is the last separator
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.base = self.matrix.walk(np.arange(sigma), np.zeros(sigma, np.int64))
        # Steps to the left don't cross a separator: first places are kept too.
        self.kept = (sa % KEPT == 0) | (text[sa - 1] == 0)
        self.places = sa[self.kept].astype(np.int32 if len(text) < 1 << 31 else np.int64)
        self.nth = np.cumsum(self.kept, dtype=np.int32 if len(text) < 1 << 31 else np.int64) - 1

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of symbol + match from that of match."""
        shift = self.less[symbol] - self.base[symbol]
        return self.matrix.walk(symbol, lo) + shift, self.matrix.walk(symbol, hi) + shift

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each suffix, by steps to the left until one that is kept."""
        out, at, row = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows
        steps = 0
        while len(at):
            there = self.kept[row]
            out[at[there]] = self.places[self.nth[row[there]]] + steps
            at, row = at[~there], row[~there]
            symbol, down = self.matrix.access(row)
            row, steps = down + self.less[symbol] - self.base[symbol], steps + 1
        return out

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end the length, ``most`` at most, of the longest match that ends there and occurs twice or more, and that match's interval.

        The text is read from each end to the left, so the interval narrows word by word; a match stops at a separator.
        """
        symbol = text[ends - 1]
        lo, hi = self.less[symbol].copy(), self.less[symbol + 1].copy()
        length = ((hi - lo > 1) & (symbol > 0)).astype(np.int64)
        which = np.flatnonzero(length)
        for k in range(1, most):
            which = which[ends[which] > k]
            symbol = text[ends[which] - 1 - k]
            which, symbol = which[symbol > 0], symbol[symbol > 0]
            if not len(which):
                break
            a, b = self.extend(symbol, lo[which], hi[which])
            more = b - a > 1
            which = which[more]
            lo[which], hi[which], length[which] = a[more], b[more], k + 1
        return length, lo, hi


def repeated_spans(docs: DataFrame, length: int = WORDS) -> DataFrame:
    """(id, key, spans) of the words that an earlier window has, from (id, key, text)."""
    spark, most, in_row = docs.sparkSession, anchors.POPULAR, anchors.APART
    power = max(6, min(20, (8 * shuffle_width(spark) - 1).bit_length()))

    def windows(data: np.ndarray, offsets: np.ndarray) -> tuple:
        """Words and their text; seeds; start and anchor of each window."""
        words, doc = word_hashes(data, offsets)
        n = len(words) - SEED + 1
        seeds = run_hash(words, np.arange(n), SEED) if n > 0 else np.zeros(0, np.uint64)
        minima = leftmost_minima(seeds, length - SEED + 1)
        start = np.flatnonzero(doc[: len(minima)] == doc[length - 1 : length - 1 + len(minima)])
        return words, doc, seeds, start, minima[start]

    def seeds_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in text_blocks(batch.column(2)):
            _, _, seeds, _, anchor = windows(data, offsets)
            yield seeds[np.unique(anchor)]

    marks = spark.sparkContext.broadcast(repeated_marks(docs, seeds_of, power))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretches]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, _, data, offsets in text_blocks(batch.column(2)):
                words, doc, seed, start, anchor = windows(data, offsets)
                keep = is_marked(marks.value, seed[anchor])
                start, anchor = start[keep], anchor[keep]
                first = runs(anchor, start)
                if len(first):
                    a, b = start[first], start[np.append(first[1:], len(start)) - 1] + length
                    yield Stretches(words, a, b, *_names(words, a, b), seed[anchor[first]], ids[row + doc[a]], keys[row + doc[a]], a - np.searchsorted(doc, doc[a]), length, most)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in stretches(batches):
            yield x.sent(power)

    def popular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in stretches(batches):
            yield x.apart(in_row)

    def search(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        words, size, place, own = received(got, np.uint64)
        at = np.concatenate([[0], np.cumsum(size)])
        # Equal stretches of all blocks become one, whose least place stands for it.
        h1, h2 = _names(words, at[:-1], at[1:])
        pick, which = distinct(h1, h2)
        own = which[own]
        by = np.lexsort((place["at"], place["key"], place["id"], own))
        place, own = place[by], own[by]
        least = place[np.searchsorted(own, np.arange(len(pick)))]
        size, begin = size[pick], at[pick]
        # The shard's text: distinct stretches, a separator after each.
        to = np.concatenate([[0], np.cumsum(size + 1)])
        _, symbols = np.unique(words, return_inverse=True)
        text = np.zeros(to[-1], np.int64)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(to[:-1], size) + inner] = symbols[np.repeat(begin, size) + inner] + 1
        count = size - length + 1
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        stretch = np.repeat(np.arange(len(pick)), count)
        index = FMIndex(text, int(symbols.max()) + 2)
        matched, lo, hi = index.matching_statistics(text, to[:-1][stretch] + step + length, length)
        which = np.flatnonzero(matched >= length)
        lo, hi = lo[which], hi[which]
        # Order of all occurrences in the reported intervals, and the least of each interval.
        los, back = np.unique(lo, return_inverse=True)
        his = np.zeros(len(los), np.int64)
        his[back] = hi
        row = np.arange((his - los).sum()) - np.repeat(np.cumsum(his - los) - (his - los), his - los) + np.repeat(los, his - los)
        found = index.locate(row)
        of = np.searchsorted(to, found, side="right") - 1
        off = found - to[of]
        order = np.lexsort((least["at"][of] + off, least["key"][of], least["id"][of]))
        moved = np.ones(len(order), bool)
        x = np.stack([least["id"][of], least["key"][of], least["at"][of] + off], axis=1)[order]
        moved[1:] = (x[1:] != x[:-1]).any(axis=1)
        nth = np.empty(len(order), np.int64)
        nth[order] = np.cumsum(moved)
        first = np.minimum.reduceat(nth, np.cumsum(his - los) - (his - los)) if len(los) else nth
        mine = np.zeros(len(text) + 1, np.int64)
        mine[found] = nth
        again = mine[(to[:-1][stretch] + step)[which]] > first[back] if len(which) else np.zeros(0, bool)
        hit = which[again]
        head = np.flatnonzero(np.concatenate([np.ones(min(1, len(hit)), bool), (hit[1:] != hit[:-1] + 1) | (stretch[hit[1:]] != stretch[hit[:-1]])]))
        sub = np.stack([stretch[hit[head]], step[hit[head]], step[hit[np.append(head[1:], len(hit)) - 1]] + length if len(hit) else hit], axis=1)
        return spread(place, own, least, size, sub, h1[pick], h2[pick], False)

    found = stored(docs.mapInArrow(emit, SENT).groupBy("range").applyInArrow(search, SPREAD), "fm-spans")
    return all_spans(found, docs.mapInArrow(popular, HOT), False)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WORDS) -> DataFrame:
    """(id, n_words, n_removed, kept, kept_sha256), a row for each of ``docs``; kept words are joined by one blank."""
    rows = keyed(docs, id_col, text_col)
    spans = stored(repeated_spans(rows, length), "fm-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                words, gone = text.as_buffer().to_pybytes().split(), merged(spans.as_py())
                edges = [0, *gone.ravel().tolist(), len(words)]
                n.append(len(words))
                removed.append(int((gone[:, 1] - gone[:, 0]).sum()))
                kept.append(b" ".join([w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]))
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([None if i == NO_ID else i for i in ids], pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            ], [id_col, "n_words", "n_removed", "kept", "kept_sha256"])

    return with_spans(rows, spans).select("id", "key", "text", "spans").mapInArrow(cut, f"{id_col} long, n_words long, n_removed long, kept string, kept_sha256 string")


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, p, array_to_string(w[p:p+19], ' ') AS x FROM s),
r AS (SELECT doc_id, p, min((doc_id, p)) OVER (PARTITION BY x) AS first FROM h),
c AS (SELECT DISTINCT doc_id, p + unnest(range(0, 20)) AS p FROM r WHERE (doc_id, p) > first),
l AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (
  SELECT l.doc_id, count(c.p) AS gone, string_agg(x, ' ' ORDER BY l.p) FILTER (c.p IS NULL) AS kept
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.p = c.p GROUP BY l.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
