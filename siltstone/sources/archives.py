"""Five archive formats: parsers over binary files, and a sink that writes a part for each task.

Three of the formats are little-endian layouts of this kind (fixed values in functions.scalars):

1.  magic, u32 files, {u16 path length, path, u64 size, u64 packed, u64 data offset, data}, footer
2.  magic, u64 average, u32 files, u32 chunks, {hash32, u64 offset, u64 packed, u64 size} by hash,
    {u16 path length, path, u64 size, u32 n, hash32 * n}, data, footer; offsets count from the data's start
3.  magic, u8 version, u32 dictionary size, u32 files, u32 0, dictionary, {u16 path length, path, u64 size, u64 packed, data}, footer

The others are ZIP and tar.xz. Archives are read with Spark's binaryFile reader, from any store it reads, so a
file of two GB or more must be split into parts, which is what the sink is for.
"""

from __future__ import annotations

import hashlib
import io
import lzma
import struct
import tarfile
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import scalars as S
from ..functions.chunking import ChunkOptions, cut, gear_table
from ..functions.codecs import CODECS

MAX_PATH = 65535


class Truncated(ValueError):
    pass


class _Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Truncated(f"truncated at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))

    def path(self) -> str:
        return self.take(self.read("H")[0]).decode("utf-8", "replace")


def _path(path: str) -> bytes:
    raw = path.encode()
    if len(raw) > MAX_PATH:
        raise ValueError(f"path of {len(raw)} bytes")
    return struct.pack("<H", len(raw)) + raw


def detect(data: bytes) -> str:
    for magic, name in ((S.MAGIC_1, "ARCHIVE1"), (S.MAGIC_2, "ARCHIVE2"), (S.MAGIC_3, "ARCHIVE3"), (S.MAGIC_ZIP, "ZIP"), (S.MAGIC_XZ, "XZ")):
        if len(data) >= 8 and data.startswith(magic):
            return name
    return "UNKNOWN"


# ------------------------------------------------------------------ writing


def write_1(files: Iterable[tuple[str, bytes]], level: int = 5, codec: str = "zstd") -> bytes:
    files, code = list(files), CODECS[codec][0](level, b"")
    out = io.BytesIO()
    out.write(S.MAGIC_1 + struct.pack("<I", len(files)))
    for path, content in files:
        packed, name = code(content), _path(path)
        out.write(name + struct.pack("<QQQ", len(content), len(packed), out.tell() + len(name) + 24) + packed)
    out.write(S.FOOTER_1)
    return out.getvalue()


def write_2(files: Iterable[tuple[str, bytes]], average: int, level: int = 5, codec: str = "zstd") -> bytes:
    import numpy as np

    options, gear, code = ChunkOptions(average), gear_table(), CODECS[codec][0](level, b"")
    index: dict[bytes, tuple[int, int, int]] = {}
    data, manifest, count = io.BytesIO(), io.BytesIO(), 0
    for path, content in files:
        refs, at = [], 0
        for n in cut(np.frombuffer(content, np.uint8), options, gear)[0].tolist():
            piece = content[at : at + n]
            at += n
            key = hashlib.sha256(piece).digest()
            refs.append(key)
            if key not in index:
                packed = code(piece)
                index[key] = (data.tell(), len(packed), n)
                data.write(packed)
        manifest.write(_path(path) + struct.pack("<QI", len(content), len(refs)) + b"".join(refs))
        count += 1
    head = S.MAGIC_2 + struct.pack("<QII", average, count, len(index))
    return head + b"".join(k + struct.pack("<QQQ", *index[k]) for k in sorted(index)) + manifest.getvalue() + data.getvalue() + S.FOOTER_2


def write_3(files: Iterable[tuple[str, bytes]], dictionary: bytes = b"", level: int = 5) -> bytes:
    files, code = list(files), CODECS["zstd"][0](level, dictionary)
    out = [S.MAGIC_3, struct.pack("<BIII", 1, len(dictionary), len(files), 0), dictionary]
    for path, content in files:
        packed = code(content)
        out += [_path(path), struct.pack("<QQ", len(content), len(packed)), packed]
    return b"".join([*out, S.FOOTER_3])


def write_zip(files: Iterable[tuple[str, bytes]], level: int = 5) -> bytes:
    out = io.BytesIO()
    kind = zipfile.ZIP_STORED if level <= 1 else zipfile.ZIP_DEFLATED
    with zipfile.ZipFile(out, "w", kind, compresslevel=None if level <= 1 else min(level - 1, 9)) as z:
        for path, content in files:
            z.writestr(path, content)
    return out.getvalue()


def write_xz(files: Iterable[tuple[str, bytes]], level: int = 5) -> bytes:
    out = io.BytesIO()
    size = 1 << 26 if level >= 7 else 1 << (20 + level)
    filters = [{"id": lzma.FILTER_LZMA2, "preset": min(level, 9), "dict_size": size}]
    with lzma.open(out, "wb", filters=filters) as packed, tarfile.open(fileobj=packed, mode="w|") as t:
        for path, content in files:
            info = tarfile.TarInfo(path)
            info.size, info.mode = len(content), 0o644
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


# ------------------------------------------------------------------ reading


@dataclass
class Entry:
    path: str | None
    original_size: int | None = None
    compressed_size: int | None = None
    chunk_count: int | None = None
    data_offset: int | None = None
    content: bytes | None = None
    error: str | None = None


def _checked(entry: Entry, decode, raw: bytes, data: bool) -> Entry:
    if data:
        try:
            content = decode(raw)
            if len(content) == entry.original_size:
                entry.content = content
            else:
                entry.error = f"{len(content)} bytes where {entry.original_size} are due"
        except Exception as e:
            entry.error = f"{type(e).__name__}: {e}"
    return entry


def read_1(data: bytes, payload: bool) -> Iterator[Entry]:
    c, decode = _Cursor(data, 8), CODECS["zstd"][1](b"")
    for _ in range(c.read("I")[0]):
        path = c.path()
        size, packed, offset = c.read("QQQ")
        entry = Entry(path, size, packed, None, offset)
        if offset != c.at:
            entry.error = f"data at {offset}, not at {c.at}"
        yield _checked(entry, decode, c.take(packed), payload) if not entry.error else entry
    if c.data[c.at :] != S.FOOTER_1:
        yield Entry(None, error="footer")


def read_2_relations(data: bytes) -> tuple[int, dict[bytes, tuple[int, int, int]], list[tuple[str, int, list[bytes]]], int]:
    """Average, index by hash, manifests, and where the data starts."""
    c = _Cursor(data, 8)
    average, files, chunks = c.read("QII")
    index = {}
    for _ in range(chunks):
        key = c.take(32)
        index[key] = c.read("QQQ")
    manifests = []
    for _ in range(files):
        path = c.path()
        size, n = c.read("QI")
        raw = c.take(32 * n)
        manifests.append((path, size, [raw[i : i + 32] for i in range(0, 32 * n, 32)]))
    return average, index, manifests, c.at


def read_2(data: bytes, payload: bool) -> Iterator[Entry]:
    _, index, manifests, start = read_2_relations(data)
    decode = CODECS["zstd"][1](b"")
    for path, size, refs in manifests:
        missing = [k for k in refs if k not in index]
        entry = Entry(path, size, sum(index[k][1] for k in refs if k in index), len(refs))
        if missing:
            entry.error = f"{len(missing)} missing chunks, first {missing[0].hex()[:16]}"
        elif payload:
            parts = []
            try:
                for k in refs:
                    offset, packed, n = index[k]
                    piece = decode(data[start + offset : start + offset + packed])
                    if len(piece) != n or hashlib.sha256(piece).digest() != k:
                        raise ValueError(f"chunk {k.hex()[:16]} is corrupt")
                    parts.append(piece)
                content = b"".join(parts)
                if len(content) != size:
                    raise ValueError(f"{len(content)} bytes where {size} are due")
                entry.content = content
            except Exception as e:
                entry.error = f"{type(e).__name__}: {e}"
        yield entry
    if not data.endswith(S.FOOTER_2) or len(data) - len(S.FOOTER_2) != start + max([o + p for o, p, _ in index.values()], default=0):
        yield Entry(None, error="footer")


def read_3(data: bytes, payload: bool) -> Iterator[Entry]:
    c = _Cursor(data, 8)
    version, size, files, _ = c.read("BIII")
    if version != 1:
        raise ValueError(f"version {version}")
    decode = CODECS["zstd"][1](c.take(size))
    for _ in range(files):
        path = c.path()
        size, packed = c.read("QQ")
        entry = Entry(path, size, packed, None, c.at)
        yield _checked(entry, decode, c.take(packed), payload)
    if c.data[c.at :] != S.FOOTER_3:
        yield Entry(None, error="footer")


def read_zip(data: bytes, payload: bool) -> Iterator[Entry]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if not info.is_dir():
                yield _checked(Entry(info.filename, info.file_size, info.compress_size, None, info.header_offset), lambda _, i=info: z.read(i), b"", payload)


def read_xz(data: bytes, payload: bool) -> Iterator[Entry]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r|xz") as t:
        for info in t:
            if info.isfile():
                content = t.extractfile(info).read()
                yield _checked(Entry(info.name, info.size), lambda _, x=content: x, b"", payload)


READERS = {"ARCHIVE1": read_1, "ARCHIVE2": read_2, "ARCHIVE3": read_3, "ZIP": read_zip, "XZ": read_xz}
ENTRY_DDL = "archive string, format string, archive_bytes long, path string, original_size long, compressed_size long, chunk_count long, data_offset long, content binary, data_valid boolean, error string"


def read_entries(binary_files: DataFrame, payload: bool = True) -> DataFrame:
    """ENTRY_DDL rows of all archives in (path, content); without ``payload`` only the structure is read.

    An archive that breaks off gives the entries before and one row with a null path and the error. data_valid is
    null where payloads aren't checked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_py() or b""
                form, rows, held = detect(data), [], 0
                entries = READERS[form](data, payload) if form in READERS else iter([Entry(None, error="truncated" if len(data) < 8 else "unknown format")])
                while True:
                    try:
                        e = next(entries)
                    except StopIteration:
                        break
                    except Exception as x:
                        e = Entry(None, error=f"{type(x).__name__}: {x}")
                        entries = iter(())
                    valid = (e.error is None) if payload and e.path is not None else None
                    rows.append((name, form, len(data), e.path, e.original_size, e.compressed_size, e.chunk_count, e.data_offset, e.content, valid, e.error))
                    held += len(e.content or b"")
                    if held > 16 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return binary_files.select("path", "content").mapInArrow(run, ENTRY_DDL)


_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.string()]
_NAMES = [x.split()[0] for x in ENTRY_DDL.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def load_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Entries of the archives at a path, a folder or a pattern."""
    return read_entries(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content"), payload)


# --------------------------------------------------------------------- sink

WRITERS = {
    "1": lambda rows, o: write_1(rows, int(o.get("level", 5))),
    "2": lambda rows, o: write_2(rows, int(o["average"]), int(o.get("level", 5))),
    "3": lambda rows, o: write_3(rows, bytes.fromhex(o.get("dictionary", "")), int(o.get("level", 5))),
    "zip": lambda rows, o: write_zip(rows, int(o.get("level", 5))),
    "xz": lambda rows, o: write_xz(rows, int(o.get("level", 5))),
}
ENDINGS = {"1": ".gdelta", "2": ".gdelta", "3": ".gdelta", "zip": ".zip", "xz": ".tar.xz"}


@dataclass
class _Written(WriterCommitMessage):
    part: int
    temporary: str
    size: int
    files: int


class ArchiveSink(DataSource):
    """``df.write.format("siltstone_archive")``: a part for each task that has files, named base_NN on commit."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_archive"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options

    def _fs(self):
        from pyarrow import fs

        path = self.options["path"]
        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def write(self, rows) -> _Written:
        import uuid

        from pyspark import TaskContext

        files = [(r["rel_path"], bytes(r["content"])) for r in rows]
        part = TaskContext.get().partitionId()
        if not files:
            return _Written(part, "", 0, 0)
        data = WRITERS[self.options["archive"]](files, self.options)
        system, path = self._fs()
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(temporary) as out:
            out.write(data)
        return _Written(part, temporary, len(data), len(files))

    def commit(self, messages) -> None:
        system, path = self._fs()
        done = sorted((m for m in messages if m is not None and m.temporary), key=lambda m: m.part)
        ending = ENDINGS[self.options["archive"]]
        one = len(done) == 1 and self.options.get("single") == "true"
        for i, m in enumerate(done, 1):
            system.move(m.temporary, path + ending if one else f"{path}_{i:02d}{ending}")

    def abort(self, messages) -> None:
        system, _ = self._fs()
        for m in messages:
            if m is not None and m.temporary:
                system.delete_file(m.temporary)


def write_archive(files: DataFrame, path: str, archive: str, parts: int = 1, **options) -> None:
    """Write (rel_path, content) as an archive of ``parts`` parts at most; more parts are needed for data beyond a task's memory."""
    files.sparkSession.dataSource.register(ArchiveSink)
    rows = files.select("rel_path", "content")
    rows = rows.coalesce(1).sortWithinPartitions("rel_path") if parts == 1 else rows.repartition(parts, "rel_path").sortWithinPartitions("rel_path")
    writer = rows.write.format("siltstone_archive").mode("append").option("archive", archive).option("single", "true" if parts == 1 and archive not in ("zip", "xz") else "false")
    for k, v in options.items():
        writer = writer.option(k, v.hex() if isinstance(v, bytes) else str(v))
    writer.save(path)


# ------------------------------------------------- relations of chunked archives


def archive_index(binary_files: DataFrame) -> DataFrame:
    """(archive, hash, chunk_offset, compressed_size, original_size) of chunked archives; offsets count from the data's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_py() or b""
                if detect(data) == "ARCHIVE2":
                    _, index, _, _ = read_2_relations(data)
                    rows = [(name, k.hex(), *v) for k, v in index.items()]
                    yield pa.RecordBatch.from_pylist([dict(zip(("archive", "hash", "chunk_offset", "compressed_size", "original_size"), r, strict=True)) for r in rows], schema=pa.schema([("archive", pa.string()), ("hash", pa.string()), *[(k, pa.int64()) for k in ("chunk_offset", "compressed_size", "original_size")]]))

    return binary_files.select("path", "content").mapInArrow(run, "archive string, hash string, chunk_offset long, compressed_size long, original_size long")


def archive_manifest(binary_files: DataFrame) -> DataFrame:
    """(archive, rel_path, orig_size, chunk_hashes) of chunked archives, hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_py() or b""
                if detect(data) == "ARCHIVE2":
                    _, _, manifests, _ = read_2_relations(data)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(manifests), pa.string()), pa.array([m[0] for m in manifests], pa.string()), pa.array([m[1] for m in manifests], pa.int64()), pa.array([[k.hex() for k in m[2]] for m in manifests], pa.list_(pa.string()))], ["archive", "rel_path", "orig_size", "chunk_hashes"])

    return binary_files.select("path", "content").mapInArrow(run, "archive string, rel_path string, orig_size long, chunk_hashes array<string>")
