"""Codecs over binary columns: a registry, and kernels that make a codec once for each task."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Coder = Callable[[bytes], bytes]
#: name -> (make an encoder for a level and a dictionary, make a decoder for a dictionary)
CODECS: dict[str, tuple[Callable[[int, bytes], Coder], Callable[[bytes], Coder]]] = {}


def register(name: str, encoder: Callable[[int, bytes], Coder], decoder: Callable[[bytes], Coder]) -> None:
    CODECS[name] = (encoder, decoder)


def _zstd():
    import zstandard

    return zstandard


def _zstd_encoder(level: int, dictionary: bytes) -> Coder:
    z = _zstd()
    return z.ZstdCompressor(level=min(level, 22), dict_data=z.ZstdCompressionDict(dictionary) if dictionary else None).compress


def _zstd_decoder(dictionary: bytes) -> Coder:
    z = _zstd()
    d = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(dictionary) if dictionary else None)
    return lambda data: d.decompressobj().decompress(data)


register("store", lambda level, _: bytes, lambda _: bytes)
register("zlib", lambda level, _: lambda data: zlib.compress(data, min(level, 9)), lambda _: zlib.decompress)
register("lzma", lambda level, _: lambda data: lzma.compress(data, preset=min(level, 9)), lambda _: lzma.decompress)
register("zstd", _zstd_encoder, _zstd_decoder)


def _mapped(df: DataFrame, column: str, into: str, make: Callable[[], Coder], error: str | None = None) -> DataFrame:
    keep = [c for c in df.columns if c not in (into, error)]
    at = keep.index(column)
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(into, T.BinaryType()), *([T.StructField(error, T.StringType())] if error else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = make()
        for batch in batches:
            out, errors = [], []
            for value in batch.column(at):
                try:
                    out.append(code(value.as_py()) if value.is_valid else None)
                    errors.append(None)
                except Exception as e:
                    if not error:
                        raise
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()), *([pa.array(errors, pa.string())] if error else [])], schema.names)

    return df.select(*keep).mapInArrow(run, schema)


def compress_column(df: DataFrame, column: str, into: str, codec: str = "zlib", level: int = 5, dictionary: bytes = b"") -> DataFrame:
    encoder = CODECS[codec][0]
    return _mapped(df, column, into, lambda: encoder(level, dictionary))


def decompress_column(df: DataFrame, column: str, into: str, codec: str = "zlib", dictionary: bytes = b"", error: str = "error") -> DataFrame:
    """Decoded values, null with a reason in ``error`` where a value can't be decoded."""
    decoder = CODECS[codec][1]
    return _mapped(df, column, into, lambda: decoder(dictionary), error)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes, or none where there is too little to learn from."""
    if size <= 0 or len(samples) < 3 or sum(map(len, samples)) < 2048:
        return b""
    try:
        return _zstd().train_dictionary(size, samples).as_bytes()
    except Exception:  # the trainer refuses some inputs; an archive without a dictionary is valid
        return b""
