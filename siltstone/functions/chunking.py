"""Content-defined chunking: one Arrow kernel that cuts binary values at content-chosen places.

A rolling hash takes one gear value per byte, ``fp = (fp << 1) + gear[byte]``; a chunk ends after the
byte at which the masked hash is 0. Hashing starts at ``min_size``; up to ``avg_size`` the strict mask
holds, from there to ``max_size`` the loose one. Masks test low bits only, so a place depends on
the last few bytes: hashes of all places of a block are computed at once, and only the first places of
each chunk, where the hash has restarted, are corrected. Blocks overlap by what the hash remembers, so their size changes no cut.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BYTES, MAX_BYTES = 64, 1 << 30
#: A hash forgets a byte after so many.
WINDOW = 64
#: Places that are hashed at once: 20 bytes of memory for each, two blocks at most, however long the value is.
BLOCK = 1 << 20


def gear_table() -> np.ndarray:
    """A 64-bit value for each byte: the first 8 bytes of the byte's SHA-256."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "big") for b in range(256)], np.uint64)


@dataclass(frozen=True)
class ChunkOptions:
    """Sizes in bytes; 0 takes the default: a quarter and four times the average."""

    avg_size: int
    min_size: int = 0
    max_size: int = 0
    normalization: int = 2

    def __post_init__(self):
        object.__setattr__(self, "min_size", self.min_size or self.avg_size // 4)
        object.__setattr__(self, "max_size", self.max_size or self.avg_size * 4)
        for name in ("avg_size", "min_size", "max_size"):
            if not MIN_BYTES <= getattr(self, name) <= MAX_BYTES:
                raise ValueError(f"{name} must be between {MIN_BYTES} bytes and 1 GiB")
        if self.min_size >= self.max_size:
            raise ValueError("min_size must be less than max_size")
        if not self.min_size <= self.avg_size <= self.max_size:
            raise ValueError("avg_size must be between min_size and max_size")
        if not 0 <= self.normalization <= 4:
            raise ValueError("normalization must be between 0 and 4")

    @property
    def bits(self) -> int:
        return math.floor(math.log2(self.avg_size) + 0.5)

    @property
    def strict(self) -> int:
        return (1 << (self.bits + self.normalization)) - 1

    @property
    def loose(self) -> int:
        return (1 << (self.bits - self.normalization)) - 1


def window_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """At each place the hash of the last ``WINDOW`` bytes."""
    out = gear[data]
    for step in (1, 2, 4, 8, 16, 32):
        if len(out) > step:
            out[step:] = out[step:] + (out[:-step] << np.uint64(step))
    return out


def cut(data: np.ndarray, options: ChunkOptions, gear: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and fingerprints of the chunks of one value; they tile it. An empty value has none."""
    n, o = len(data), options
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    strict, loose = np.uint64(o.strict), np.uint64(o.loose)
    warm = o.bits + o.normalization
    lengths, prints, p = [], [], 0
    held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def block(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of a block of places, and the places where the strict and the loose mask hold; the last two blocks are kept."""
        if i not in held:
            low = i * BLOCK
            lead = max(0, low - WINDOW + 1)
            hashes = window_hashes(data[lead : low + BLOCK], gear)[low - lead :]
            while len(held) > 1:
                del held[min(held)]
            held[i] = hashes, low + np.flatnonzero(hashes & strict == 0), low + np.flatnonzero(hashes & loose == 0)
        return held[i]

    def hashes_of(low: int, high: int) -> np.ndarray:
        i = low // BLOCK
        if high <= (i + 1) * BLOCK:
            return block(i)[0][low - i * BLOCK : high - i * BLOCK]
        lead = max(0, low - WINDOW + 1)
        return window_hashes(data[lead:high], gear)[low - lead :]

    def fingerprint(start: int, place: int) -> np.uint64:
        """The hash at ``place`` of what follows ``start``."""
        gone = place - start + 1
        before = int(hashes_of(start - 1, start)[0]) << gone if gone < WINDOW else 0
        return np.uint64((int(hashes_of(place, place + 1)[0]) - before) & 0xFFFFFFFFFFFFFFFF)

    def first(mask: int, low: int, high: int) -> int:
        """The first place from ``low`` on, and before ``high``, where the mask (1: strict, 2: loose) holds."""
        i = low // BLOCK
        while i * BLOCK < high:
            places = block(i)[mask]
            k = np.searchsorted(places, low)
            if k < len(places):
                return int(places[k]) if places[k] < high else -1
            i += 1
        return -1

    while p < n:
        rest = n - p
        if rest <= o.min_size:
            lengths.append(rest)
            prints.append(np.uint64(0))
            break
        limit, start, found = min(rest, o.max_size), p + o.min_size, -1
        end = min(start + warm, p + limit)
        steps = np.arange(1, end - start + 1, dtype=np.uint64)
        early = hashes_of(start, end) - (hashes_of(start - 1, start)[0] << steps)
        masks = np.where(np.arange(start, end) < p + o.avg_size, strict, loose)
        hit = np.flatnonzero(early & masks == 0)
        if len(hit):
            found = start + int(hit[0])
        if found < 0:
            found = first(1, end, p + min(limit, o.avg_size))
        if found < 0:
            found = first(2, max(end, p + o.avg_size), p + limit)
        if found < 0:
            found = p + limit - 1
        lengths.append(found - p + 1)
        prints.append(fingerprint(start, found))
        p = found + 1
    return np.array(lengths, np.int64), np.array(prints, np.uint64)


def chunk_files(files: DataFrame, options: ChunkOptions, gear: np.ndarray | None = None, data: bool = True) -> DataFrame:
    """(rel_path, chunk_idx, chunk_offset, chunk_len, fingerprint, hash, data) of (rel_path, content).

    Chunks stream out value by value, so a task holds one value and one batch of chunks. ``data=False``
    hashes in the kernel and leaves the bytes behind; the plan then carries no payload.
    """
    table = gear_table() if gear is None else gear
    limit = 16 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], [], []]
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, held
            out = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *[pa.array(rows[i], pa.int64()) for i in (1, 2, 3, 4)], pa.array(rows[5], pa.binary() if data else pa.string())], ["rel_path", "chunk_idx", "chunk_offset", "chunk_len", "fingerprint", "data" if data else "hash"])
            rows, held = [[], [], [], [], [], []], 0
            return out

        for batch in batches:
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not value.is_valid:
                    continue
                raw = memoryview(value.as_buffer())
                lengths, prints = cut(np.frombuffer(raw, np.uint8), options, table)
                at = 0
                for i, (n, fp) in enumerate(zip(lengths.tolist(), prints.view(np.int64).tolist(), strict=True)):
                    piece = raw[at : at + n]
                    for column, x in zip(rows, (path, i, at, n, fp, bytes(piece) if data else hashlib.sha256(piece).hexdigest()), strict=True):
                        column.append(x)
                    at += n
                    held += n if data else 200
                    if held >= limit:
                        yield flush()
        if rows[0]:
            yield flush()

    schema = "rel_path string, chunk_idx long, chunk_offset long, chunk_len long, fingerprint long, " + ("data binary" if data else "hash string")
    out = files.select("rel_path", "content").mapInArrow(run, schema)
    return out.withColumn("hash", F.sha2("data", 256)) if data else out


def cut_sql(options: ChunkOptions, files: str) -> str:
    """CTEs in DuckDB SQL that end in chunks(rel_path, chunk_idx, chunk_offset, chunk_len, hash) of ``files``."""
    o, k = options, options.bits + options.normalization
    mask_s, mask_l = o.strict, o.loose
    terms = " + ".join(f"(lag(g, {j}, 0) OVER w << {j})" for j in range(k))

    def length(p: str) -> str:
        lim = f"least(n - {p}, {o.max_size})"
        short = f"list_sum(list_transform(range(t + 1), lambda j: (gears[{p} + {o.min_size} + t - j + 1] << j)))::BIGINT"
        warm = f"list_filter(range(least({k}, {lim} - {o.min_size})), lambda t: ({short} & (CASE WHEN {o.min_size} + t < {o.avg_size} THEN {mask_s} ELSE {mask_l} END)) = 0)[1] + {o.min_size + 1}"
        pick = lambda c, lo, hi: f"list_filter({c}, lambda x: x >= {p} + {lo} AND x < {p} + {hi})[1] - {p} + 1"
        return (
            f"CASE WHEN n - {p} <= {o.min_size} THEN n - {p} ELSE coalesce({warm}, "
            f"{pick('strict', o.min_size + k, f'least({lim}, {o.avg_size})')}, "
            f"{pick('loose', max(o.min_size + k, o.avg_size), lim)}, {lim}) END"
        )

    return f"""
gear AS MATERIALIZED (
  SELECT i AS b, (('0x' || substr(sha256(unhex(printf('%02x', i))), 1, 16))::UBIGINT & {mask_s}::UBIGINT)::BIGINT AS g FROM range(256) t(i)
), files AS MATERIALIZED ({files}),
bytes AS MATERIALIZED (
  SELECT rel_path, pos, g FROM (
    SELECT rel_path, unnest(range(n)) AS pos, ('0x' || unnest(regexp_extract_all(hx, '..')))::BIGINT AS b
    FROM (SELECT rel_path, orig_size AS n, hex(content) AS hx FROM files WHERE orig_size > 0)
  ) JOIN gear USING (b)
), hashed AS MATERIALIZED (
  SELECT rel_path, pos, g, ({terms}) & {mask_s} AS h FROM bytes WINDOW w AS (PARTITION BY rel_path ORDER BY pos)
), per_file AS MATERIALIZED (
  SELECT rel_path, count(*) AS n, list(g ORDER BY pos) AS gears,
         coalesce(list(pos ORDER BY pos) FILTER (h = 0), []) AS strict, coalesce(list(pos ORDER BY pos) FILTER (h & {mask_l} = 0), []) AS loose
  FROM hashed GROUP BY rel_path
), tiles AS (
  SELECT rel_path, 0::BIGINT AS chunk_idx, 0::BIGINT AS p, ({length('0')})::BIGINT AS len FROM per_file
  UNION ALL
  SELECT rel_path, chunk_idx + 1, p + len, ({length('(p + len)')})::BIGINT FROM tiles JOIN per_file USING (rel_path) WHERE p + len < n
), chunks AS MATERIALIZED (
  SELECT rel_path, chunk_idx, p AS chunk_offset, len AS chunk_len, sha256(unhex(substr(hex(content), (2 * p + 1)::INT, (2 * len)::INT))) AS hash
  FROM tiles JOIN files USING (rel_path)
)"""
