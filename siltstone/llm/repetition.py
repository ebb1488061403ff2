"""Quality rules with suffix-array repetition.

Base rules count words, code points, symbols, repeated lines and repeated three-word
windows. The method's rule builds a suffix array over the words of each text by prefix
doubling, and reads its longest-common-prefix values: the greater of a place's two is the longest run from there that
also starts elsewhere, the deepest LCP interval that the place is in. Runs of ``min_words`` or more are maximal repeated
substrings or suffixes of such, so the union of their spans is that of the maximal ones, and it is what is covered. A text is kept if the base rules pass, at most ``max_covered`` of its words are
covered, and the longest repeat has at most ``max_longest`` words.

The kernel works on blocks of whole texts, whose suffixes are sorted together: the first rank of a suffix
holds its text, so texts never tie. Suffixes that have become unique leave the
sort, so its cost follows what is repeated. No text is shuffled.

Cases: null or empty text: counts 0, base_failed. Empty table: no rows. Repeated rows get a
row each. Very long texts form blocks of their own: about 60 bytes of memory for each byte, and 4 more for each word and doubling where
words repeat in long runs. Columns named like the results are ignored as all others are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import extended, span_hash, table, text_blocks, word_spans

MIN_WORDS = 10
MAX_COVERED = 0.3
#: Texts that pass the base rules repeat 13 words at most in a run on the tables at hand; over twice that is a copied passage.
MAX_LONGEST = 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word the longest run from it that also starts elsewhere in its text (the greatest adjacent LCP)."""
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    end = np.append(np.flatnonzero(doc[1:] != doc[:-1]), n - 1)[np.searchsorted(np.append(np.flatnonzero(doc[1:] != doc[:-1]), n - 1), np.arange(n))] + 1
    order = np.lexsort((words, doc))
    new = np.concatenate([[True], (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the place of the first of its class
    levels, span = [rank.astype(np.int32)], 1
    single = np.append(new[1:], True) & new
    active = order[~single]
    # Groups of equal first `span` words are refined by the rank `span` words on, within the text.
    while len(active):
        nxt = active + span
        second = np.where(nxt < end[active], rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[active]))
        active, second = active[order], second[order]
        head = np.concatenate([[True], rank[active][1:] != rank[active][:-1]])
        new = head | np.concatenate([[True], second[1:] != second[:-1]])
        start = np.maximum.accumulate(np.where(head, np.arange(len(active)), 0))
        place = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0)) - start
        rank[active] = rank[active] + place
        levels.append(rank.astype(np.int32))
        single = np.append(new[1:], True) & new
        active, span = active[~single], span * 2
    suffixes = np.argsort(rank, kind="stable")
    a, b = suffixes[:-1], suffixes[1:]
    same = doc[a] == doc[b]
    at = np.flatnonzero(same & (levels[0][a] == levels[0][b]))
    a, b = a[at], b[at]
    lcp = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = (x < end[a]) & (y < end[b])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        # Equal ranks at level k stand for equal runs of 2^k words, or for equal ends of the same text, which are one suffix.
        hit = inside & (levels[k][x] == levels[k][y]) & (x + (1 << k) <= end[a]) & (y + (1 << k) <= end[b])
        lcp[hit] += 1 << k
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in [start, start + length) of any span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


_INTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]


def measure(data: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    n = len(offsets) - 1
    starts, ends, doc = word_spans(data, offsets)
    words = span_hash(data, starts, ends)
    per_doc = lambda where: np.bincount(where, minlength=n).astype(np.int64)
    upto = lambda flag: np.concatenate([[0], np.cumsum(flag)])
    out = {"n_words": per_doc(doc)}
    points = upto((data & 0xC0) != 0x80)
    out["word_chars"] = np.bincount(doc, points[ends] - points[starts], n).astype(np.int64)
    out["n_symbols"] = np.diff(upto(_SYMBOL[data])[offsets]) if len(data) else np.zeros(n, np.int64)
    # Lines: from each start of a text or \n to the next.
    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1])) if n else breaks
    line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1]))
    line_ends = np.where(np.append(line_doc[1:] == line_doc[:-1], False), np.append(line_starts[1:] - 1, 0), offsets[line_doc + 1])
    with_word = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_hash, line_doc = span_hash(data, line_starts[with_word], line_ends[with_word]), line_doc[with_word]
    order = np.lexsort((line_hash, line_doc))
    again = (line_hash[order][1:] == line_hash[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    out["n_dup_lines"] = per_doc(line_doc[order][1:][again])
    longest = repeats(words, doc)
    three, many = np.flatnonzero(longest >= 3), np.flatnonzero(longest >= min_words)
    out["n_repeat_words"] = per_doc(doc[covered(three, np.full(len(three), 3), len(words))])
    out["n_covered_words"] = per_doc(doc[covered(many, longest[many], len(words))])
    out["longest_repeat"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_repeat"], doc, longest)
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """(id, the seven counts, base_failed, kept), a row for each of ``docs``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(data, offsets, min_words) for _, _, data, offsets in text_blocks(batch.column(1))]
            if not parts:
                continue
            x = {k: np.concatenate([p[k] for p in parts]) for k in _INTS}
            failed = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
            kept = ~failed & (x["n_covered_words"] <= max_covered * x["n_words"]) & (x["longest_repeat"] <= max_longest)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[k]) for k in _INTS], pa.array(failed), pa.array(kept)], [id_col, *_INTS, "base_failed", "kept"])

    schema = extended(docs.select(id_col).schema, ", ".join(f"{k} long" for k in _INTS) + ", base_failed boolean, kept boolean")
    return docs.select(id_col, text_col).mapInArrow(judge, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


#: Words that repeated runs of ten or more cover are those that repeated windows of ten cover; a longest run is the longest diagonal of equal places.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS x
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (1), (2), (3), (10)) v(k))
), m AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, x) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, k, count(DISTINCT i + j) AS n FROM m, range(10) r(j) WHERE k IN (3, 10) AND j < k GROUP BY doc_id, k),
p AS (SELECT a.doc_id, b.i - a.i AS away, a.i FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i WHERE a.k = 3 AND b.k = 3),
q AS (SELECT doc_id, away, i - row_number() OVER (PARTITION BY doc_id, away ORDER BY i) AS run FROM p),
l AS (
  SELECT doc_id, max(n) AS longest FROM (
    SELECT doc_id, count(*) + 2 AS n FROM q GROUP BY doc_id, away, run UNION ALL SELECT doc_id, k FROM m WHERE k < 3
  ) GROUP BY doc_id
), o AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(e.n, 0)::BIGINT AS n_covered_words, coalesce(longest, 0)::BIGINT AS longest_repeat
  FROM d LEFT JOIN (SELECT * FROM c WHERE k = 3) c ON d.doc_id = c.doc_id LEFT JOIN (SELECT * FROM c WHERE k = 10) e ON d.doc_id = e.doc_id LEFT JOIN l ON d.doc_id = l.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * n_covered_words <= 3 * n_words AND longest_repeat <= 30 AS kept
FROM o
"""
