"""What the two substring operators share: anchors, a repeat filter, and removing spans.

An anchor of a window is its leftmost least seed, a short run whose hash is least; equal windows
have their anchor at the same place with the same seed. So seeds that occur once rule
out windows, and equal windows meet where their seed is sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, mix

#: Bits of the filter: 16 MB whatever the input. Where it fills up, it passes more; nothing is lost.
MARK_BITS = 27
NO_ID = -(1 << 63)


def leftmost_minima(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` seeds the place of its leftmost least, by 36 bits of the hash."""
    n = len(seeds) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(seeds) >> 28:
        raise ValueError("a text of 2^28 words or more")
    low = np.uint64((1 << 28) - 1)
    packed = (mix(seeds) & ~low) | np.arange(len(seeds), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        packed = np.minimum(packed[:-step], packed[step:])
        step *= 2
    if step < width:
        packed = np.minimum(packed[:n], packed[width - step :])
    return (packed[:n] & low).astype(np.int64)


def runs(anchor: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where in the list of windows a run of neighbours with one anchor begins."""
    if not len(anchor):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))


def range_cuts(hashes: np.ndarray, power: int) -> np.ndarray:
    """Bounds in sorted hashes of the 2^power ranges of equal width."""
    return np.searchsorted(hashes >> np.uint64(64 - power), np.arange((1 << power) + 1, dtype=np.float64).astype(np.uint64))


def repeated_marks(docs: DataFrame, seeds: Callable[[pa.RecordBatch], Iterator[np.ndarray]], power: int) -> np.ndarray:
    """A bit table over the first MARK_BITS bits of seeds: set where two or more occur.

    ``seeds`` gives arrays of seeds, each as often as it counts. They are combined in each block,
    then by ranges of hashes; 2^power ranges go with the number of shuffle partitions.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in seeds(batch):
                found = np.sort(found)
                if not len(found):
                    continue
                new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                many = (np.diff(np.append(new, len(found))) > 1).astype(np.uint8)
                found = found[new]
                at = range_cuts(found, power)
                low = ((found << np.uint64(power)) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]  # 40 bits, exact enough for a filter
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([low[at[i] : at[i + 1]].tobytes() for i in full], pa.binary()), pa.array([np.packbits(many[at[i] : at[i + 1]]).tobytes() for i in full], pa.binary())], ["range", "low", "many"])

    def add(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        lows, many = got["low"].to_pylist(), got["many"].to_pylist()
        raw = np.frombuffer(b"".join(lows), np.uint8).reshape(-1, 5)
        low = np.zeros((len(raw), 8), np.uint8)
        low[:, :5] = raw
        low = low.view(np.uint64)[:, 0]
        twice = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(x) // 5) for x, m in zip(lows, many, strict=True)])
        order = np.argsort(low)
        low, twice = low[order], twice[order].astype(bool)
        same = low[1:] == low[:-1]
        marks = np.unique(low[twice | np.append(same, False)] >> np.uint64(40 - (MARK_BITS - power)))
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "marks": pa.array([marks.astype(np.uint32).tobytes()], pa.binary())})

    got = docs.mapInArrow(count, "range int, low binary, many binary").groupBy("range").applyInArrow(add, "range int, marks binary")
    bits = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    for r in got.where(F.octet_length("marks") > 0).toLocalIterator():  # a range at a time; at most the table's places in all
        place = (r["range"] << (MARK_BITS - power)) + np.frombuffer(r["marks"], np.uint32).astype(np.int64)
        np.bitwise_or.at(bits, place >> 3, (128 >> (place & 7)).astype(np.uint8))
    return bits


def is_marked(marks: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    place = seeds >> np.uint64(64 - MARK_BITS)
    return (marks[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1


#: A place of a stretch: which one of the block, whether more of its places travel apart, whose it is, and where its first and last of a run begin.
PLACE = np.dtype([("stretch", "<u4"), ("hot", "u1"), ("id", "<i8"), ("key", "<i8"), ("at", "<i8"), ("to", "<i8")])
#: A stretch with more places in a block than this is popular: the block sends the least of them with it.
POPULAR = 8
SENT = "range int, data binary, sizes binary, places binary"
#: A row of places that travel apart has at most so many of one content in one block, 32 bytes each; more are more rows.
APART = 1 << 12
HOT = "h1 long, h2 long, size long, places binary"
SPREAD = "id long, key long, spans binary, h1 long, h2 long, at long, size long"


def distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index of each distinct pair, and for each pair which of these it equals."""
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


class Stretches:
    """The stretches values[a:b] of a block: distinct contents in the order of their seed, and runs of places of each.

    Places of one content in one document that are at most ``gap`` apart are a run, so a text of one repeated
    character or word has two runs, not a place for each; the first place of a run stands by itself.
    """

    def __init__(self, values, a, b, h1, h2, lead, id_, key, at, gap, popular):
        pick, which = distinct(h1, h2)
        lead = lead[pick]
        order = np.argsort(lead, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.values, self.a, self.b, self.lead = values, a[pick][order], b[pick][order], lead[order]
        self.h1, self.h2 = h1[pick][order], h2[pick][order]
        stretch = rank[which]
        by = np.argsort(stretch, kind="stable")
        stretch, id_, key, at = stretch[by], id_[by], key[by], at[by]
        near = np.zeros(len(at), bool)
        near[1:] = (stretch[1:] == stretch[:-1]) & (id_[1:] == id_[:-1]) & (key[1:] == key[:-1]) & (at[1:] > at[:-1]) & (at[1:] - at[:-1] <= gap)
        head = ~near  # the first of a run, and the second, begin an entry
        head[1:] |= near[1:] & ~near[:-1]
        first = np.flatnonzero(head)
        self.place = np.empty(len(first), PLACE)
        for name, column in (("id", id_), ("key", key), ("at", at)):
            self.place[name] = column[first]
        self.place["to"] = at[np.append(first[1:], len(at)) - 1] if len(first) else 0
        self.stretch = stretch[first]
        self.popular = np.bincount(self.stretch, minlength=len(order)) > popular

    def sent(self, power: int) -> pa.RecordBatch:
        """Contents by range of seeds, each with its places, or its least one if it is popular."""
        hot = self.popular[self.stretch]
        keep = ~hot
        some = np.flatnonzero(hot)
        some = some[np.lexsort((self.place["at"][some], self.place["key"][some], self.place["id"][some], self.stretch[some]))]
        keep[some[np.diff(self.stretch[some], prepend=-1) != 0]] = True
        place, stretch = self.place[keep], self.stretch[keep]
        place["hot"] = hot[keep]
        cuts = range_cuts(self.lead, power)
        place_cuts = np.searchsorted(stretch, cuts)
        place["stretch"] = stretch - np.repeat(cuts[:-1], np.diff(place_cuts))
        out = {"range": [], "data": [], "sizes": [], "places": []}
        for i in np.flatnonzero(np.diff(cuts)):
            rows = slice(cuts[i], cuts[i + 1])
            out["range"].append(i)
            out["data"].append(b"".join([self.values[x:y].tobytes() for x, y in zip(self.a[rows], self.b[rows], strict=True)]))
            out["sizes"].append((self.b[rows] - self.a[rows]).astype(np.uint16).tobytes())
            out["places"].append(place[place_cuts[i] : place_cuts[i + 1]].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out["range"], pa.int32()), *[pa.array(out[k], pa.binary()) for k in ("data", "sizes", "places")]], ["range", "data", "sizes", "places"])

    def apart(self, most: int) -> pa.RecordBatch:
        """All places of popular contents: a row for a content, or for each ``most`` places of it."""
        some = np.flatnonzero(self.popular[self.stretch])
        of = self.stretch[some]
        places = np.stack([self.place[k][some] for k in ("id", "key", "at", "to")], axis=1).astype(np.int64)
        nth = np.arange(len(of)) - np.searchsorted(of, of)
        head = np.flatnonzero(nth % most == 0)
        data = [places[x:y].tobytes() for x, y in pairwise([*head, len(of)])]
        of = of[head]
        return pa.RecordBatch.from_arrays([*map(pa.array, (self.h1[of].view(np.int64), self.h2[of].view(np.int64), self.b[of] - self.a[of])), pa.array(data, pa.binary())], ["h1", "h2", "size", "places"])


def received(got: pa.Table, dtype: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All contents of a range, their sizes, all places, and the content of each."""
    data = np.frombuffer(b"".join(got["data"].to_pylist()), dtype)
    sizes = [np.frombuffer(x, np.uint16).astype(np.int64) for x in got["sizes"].to_pylist()]
    places = [np.frombuffer(x, PLACE) for x in got["places"].to_pylist()]
    base = np.cumsum([0, *map(len, sizes)])
    place = np.concatenate(places)
    return data, np.concatenate(sizes), place, place["stretch"].astype(np.int64) + np.repeat(base[:-1], list(map(len, places)))


def later(place, least, by_id: bool):
    """Which places are covered in full: those of later documents, or else all but the least place itself."""
    if by_id:
        return place["id"] > least["id"]
    return (place["id"] != least["id"]) | (place["key"] != least["key"]) | (place["at"] != least["at"])


def by_text(place, own: np.ndarray, whole: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(id, key, spans), a row for each text of ``place``: whole contents, or their covered parts sub[lo:hi] of (start, end)."""
    ids, keys = [place["id"][whole]], [place["key"][whole]]
    spans = [np.stack([place["at"][whole], place["to"][whole] + size[own[whole]]], axis=1)]
    rest = np.flatnonzero(~whole)
    n = (hi - lo)[own[rest]]
    row, j = np.repeat(rest, n), np.repeat(lo[own[rest]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ids.append(place["id"][row])
    keys.append(place["key"][row])
    spans.append(np.stack([place["at"][row] + sub[j, 0], place["to"][row] + sub[j, 1]], axis=1))
    ids, keys, spans = np.concatenate(ids), np.concatenate(keys), np.concatenate(spans).astype(np.int64)
    order = np.lexsort((spans[:, 0], keys, ids))
    ids, keys, spans = ids[order], keys[order], np.ascontiguousarray(spans[order])
    head = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])) if len(spans) else np.zeros(0, np.int64)
    cut = np.append(head, len(spans)).astype(np.int32) * 16
    return ids[head], keys[head], pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(cut), pa.py_buffer(spans)])


def spread(place: np.ndarray, own: np.ndarray, least: np.ndarray, size: np.ndarray, sub: np.ndarray, h1: np.ndarray, h2: np.ndarray, by_id: bool) -> pa.Table:
    """(id, key, spans) of all places, and what the places of popular contents need to know: their content's least place and covered parts.

    ``sub`` has (content, start, end) of the covered parts, in the order of contents.
    """
    lo, hi = np.searchsorted(sub[:, 0], np.arange(len(size))), np.searchsorted(sub[:, 0], np.arange(len(size)), side="right")
    ids, keys, spans = by_text(place, own, later(place, least[own], by_id), size, lo, hi, sub[:, 1:])
    some = np.unique(own[place["hot"] == 1])
    parts = [np.ascontiguousarray(sub[lo[i] : hi[i], 1:]).astype(np.int64).tobytes() for i in some]
    none = pa.nulls(len(ids), pa.int64())
    both = lambda x, y: pa.concat_arrays([x, pa.array(np.ascontiguousarray(y), pa.int64())])
    return pa.table({
        "id": both(pa.array(ids), least["id"][some]), "key": both(pa.array(keys), least["key"][some]),
        "spans": pa.concat_arrays([spans, pa.array(parts, pa.binary())]),
        "h1": both(none, h1[some].view(np.int64)), "h2": both(none, h2[some].view(np.int64)), "at": both(none, least["at"][some]), "size": both(none, size[some]),
    })


def all_spans(found: DataFrame, hot: DataFrame, by_id: bool) -> DataFrame:
    """(id, key, spans) from the rows of ``spread``, and of the places that travel apart.

    ``spread`` gives each content once, so the join makes as many rows as ``hot`` has. It is one that Spark can split by skew.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, cut = arrow_bytes(batch.column("places"))
            x = dict(zip(("id", "key", "at", "to"), data.view(np.int64).reshape(-1, 4).T, strict=True))
            own = np.repeat(np.arange(len(batch)), np.diff(cut) // 32)
            least = {k: batch.column(f"least_{k}").to_numpy()[own] for k in ("id", "key", "at")}
            parts, at = arrow_bytes(batch.column("parts"))
            got = by_text(x, own, later(x, least, by_id), batch.column("size").to_numpy(), at[:-1] // 16, at[1:] // 16, parts.view(np.int64).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1]), got[2]], ["id", "key", "spans"])

    least = found.where("h1 IS NOT NULL").select("h1", "h2", F.col("id").alias("least_id"), F.col("key").alias("least_key"), F.col("at").alias("least_at"), F.col("spans").alias("parts"))
    placed = hot.join(least, ["h1", "h2"]).drop("h1", "h2").mapInArrow(place, "id long, key long, spans binary")
    return found.where("h1 IS NULL").select("id", "key", "spans").unionByName(placed)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (id, key, text) with spans: a list of binaries of (start, end) pairs, or null. Spans of a text are bounded by it."""
    gathered = spans.groupBy("id", "key").agg(F.collect_list("spans").alias("spans"))
    gathered = gathered.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "spans")
    return docs.join(gathered, (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left").drop("_id", "_key")


def merged(spans: list[bytes] | None) -> np.ndarray:
    """Sorted (start, end) rows with no overlap or touch."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    x = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    reach = np.maximum.accumulate(x[:, 1])
    new = np.flatnonzero(np.concatenate([[True], x[1:, 0] > reach[:-1]]))
    return np.stack([x[new, 0], np.append(reach[new[1:] - 1], reach[-1])], axis=1)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): a null id comes first, the key tells apart rows that share an id."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
