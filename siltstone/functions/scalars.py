"""Scalar helpers as column expressions: sizes, names, levels, thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB, TB = 1 << 10, 1 << 20, 1 << 30, 1 << 40


def parse_size(text: Column) -> Column:
    """Whole KB of a size like 64KB or 1.5G, cut down; null where it can't be read. "512B" is 0, and a blank before the unit an error."""
    s = F.upper(F.trim(text))
    number, unit = F.regexp_extract(s, r"^([0-9.]*)(.*)$", 1), F.regexp_extract(s, r"^([0-9.]*)(.*)$", 2)
    scale = (
        F.when(unit.isin("B", ""), 1.0 / 1024).when(unit.isin("KB", "K"), 1.0).when(unit.isin("MB", "M"), float(KB)).when(unit.isin("GB", "G"), float(MB)).when(unit.isin("TB", "T"), float(GB))
    )
    value = number.try_cast("double")
    return F.when(text.isin("", "0"), F.lit(0).cast("long")).when(number != "", F.floor(value * scale).cast("long"))


def format_size(size: Column) -> Column:
    """Two decimals in 1024-based units, rounded half to even on the exact value, in whole numbers."""

    def scaled(unit: int, name: str) -> Column:
        part = (size % unit) * 100
        down, rest = F.floor(part / unit), part % unit
        up = (2 * rest > unit) | ((2 * rest == unit) & (down % 2 == 1))
        hundredths = F.floor(size / unit) * 100 + down + up.cast("long")
        return F.format_string(f"%d.%02d {name}", F.floor(hundredths / 100), hundredths % 100)

    return F.when(size >= TB, scaled(TB, "TB")).when(size >= GB, scaled(GB, "GB")).when(size >= MB, scaled(MB, "MB")).when(size >= KB, scaled(KB, "KB")).otherwise(F.format_string("%d B", size))


def truncate_left(path: Column, limit: int) -> Column:
    """The tail of a path behind "...", in bytes; a long file name keeps its own tail."""
    name = F.element_at(F.split(path, "/"), -1)
    tail = lambda c: F.concat(F.lit("..."), F.decode(F.substring(F.encode(c, "UTF-8"), F.octet_length(c) - (limit - 3) + 1, F.lit(limit - 3)), "UTF-8"))
    return F.when(F.octet_length(path) <= limit, path).when(F.octet_length(name) >= limit - 3, tail(name)).otherwise(tail(path))


def auto_memory_kb(total_kb: Column) -> Column:
    """A quarter of memory, from 256 MB to 4 GB; 0 if the memory is unknown."""
    return F.when(total_kb == 0, F.lit(0)).otherwise(F.greatest(F.least(F.floor(total_kb * 25 / 100), F.lit(4 * MB)), F.lit(256 * KB))).cast("long")


def max_chunks(store_mb: Column, chunk_size: Column) -> Column:
    """Entries of a lookup of so many MB with 120 bytes of overhead each; 0 is without bound."""
    return F.when(store_mb == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(store_mb * MB / (chunk_size + 120)))).cast("long")


def deflate_level(level: Column) -> Column:
    """-1 for stored, else the deflate level: one less."""
    return F.when(level <= 1, F.lit(-1)).otherwise(level - 1)


def lzma_dictionary(level: Column) -> Column:
    return F.when(level >= 7, F.lit(1 << 26)).otherwise(F.pow(F.lit(2), level + 20)).cast("long")


def output_name(name: Column, form: str) -> Column:
    """The archive's name: known endings give way to the one of ``form`` (zip and xz keep a bare base)."""
    base = F.regexp_replace(name, r"(\.tar\.xz|\.zip|\.xz|\.gdelta)$", "")
    return base if form in ("zip", "xz") else F.concat(base, F.lit(".gdelta"))


def zip_estimate(size: Column) -> Column:
    return F.floor(size / 2).cast("long")


def xz_estimate(size: Column) -> Column:
    return F.floor(size * 30 / 100).cast("long")


#: The first and last bytes of the archive formats.
MAGIC_1, MAGIC_2, MAGIC_3 = b"GDELTA01", b"GDELTA02", b"GDELTA03"
FOOTER_1, FOOTER_2, FOOTER_3 = b"GDELTAEND", b"ENDGDLT2", b"ENDGDLT3"
MAGIC_ZIP, MAGIC_XZ = b"PK", b"\xfd7zXZ\x00"


def archive_format(content: Column) -> Column:
    """ARCHIVE1, ARCHIVE2, ARCHIVE3, ZIP, XZ or UNKNOWN by the first bytes; under 8 bytes it is UNKNOWN."""
    head = F.substring(content, 1, 8)
    out = F.when(F.octet_length(content) < 8, F.lit("UNKNOWN"))
    for magic, name in ((MAGIC_1, "ARCHIVE1"), (MAGIC_2, "ARCHIVE2"), (MAGIC_3, "ARCHIVE3")):
        out = out.when(head == F.lit(magic), F.lit(name))
    out = out.when(F.substring(content, 1, 2) == F.lit(MAGIC_ZIP), F.lit("ZIP")).when(F.substring(content, 1, 6) == F.lit(MAGIC_XZ), F.lit("XZ"))
    return out.otherwise(F.lit("UNKNOWN"))


def little_endian(data: Column, offset: int, width: int) -> Column:
    """The unsigned number of up to 7 bytes at an offset of a binary column; null past its end."""
    part = F.substring(data, offset + 1, width)
    digits = F.hex(part)
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.when(F.octet_length(part) == width, F.conv(swapped, 16, 10).cast("long"))


def hash_prefix(hexadecimal: Column) -> Column:
    """The first 8 bytes of a hash, as messages show it."""
    return F.lower(F.substring(hexadecimal, 1, 16))
