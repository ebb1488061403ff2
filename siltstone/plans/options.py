"""Options of the three entry points, their checks, and one code for each error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of the options.
MIN_CHUNK, MAX_CHUNK = 4 << 10, 64 << 20


#: Bytes of files that a part of an archive holds if nothing else is said: what a task can hold.
PART_BYTES = 256 << 20


class OptionError(ValueError):
    """An option or a combination that is not allowed; ``code`` names it."""

    MESSAGES = {
        "INPUT_REQUIRED": "an input path or a list of files is required",
        "INVALID_PARALLELISM": "parallelism is auto, folder or file",
        "XZ_NO_ZIP": "xz and zip exclude each other",
        "INVALID_LEVEL_XZ": "xz levels go from 1 to 9",
        "XZ_NO_CHUNKING": "xz can't be chunked",
        "XZ_NO_DICTIONARY": "xz has no dictionary",
        "INVALID_LEVEL_ZIP": "zip levels go from 1 to 9",
        "ZIP_NO_CHUNKING": "zip can't be chunked",
        "ZIP_NO_DICTIONARY": "zip has no dictionary",
        "INVALID_LEVEL_ZSTD": "levels go from 1 to 22",
        "DICTIONARY_NO_CHUNKING": "a dictionary and chunks exclude each other",
        "CHUNK_TOO_SMALL": "chunks average 4 KB at least",
        "CHUNK_TOO_LARGE": "chunks average 64 MB at most",
        "NO_FILES": "there are no files",
        "DUPLICATE_PATH": "a path comes twice",
        "UNSAFE_PATH": "an entry would leave the output folder",
        "TARGET_EXISTS": "the target exists",
        "UNKNOWN_FORMAT": "the archive's format is unknown",
    }

    def __init__(self, code: str, detail: str = ""):
        super().__init__(self.MESSAGES[code] + (f": {detail}" if detail else ""))
        self.code = code


@dataclass
class CompressOptions:
    input_path: str = ""
    files: tuple[str, ...] = ()
    output_path: str = "archive"
    threads: int = 0
    parallelism: str = "auto"
    level: int = 5
    chunk_size: int = 0
    chunk_store_mb: int = 0
    use_dictionary: bool = False
    use_zip: bool = False
    use_xz: bool = False
    use_gitignore: bool = False
    dry_run: bool = False
    parts: int = 0  # 0: one for each PART_BYTES
    quiet: bool = False
    verbose: bool = False

    def error(self) -> str | None:
        """The code of the first rule that is broken."""
        if not self.input_path and not self.files:
            return "INPUT_REQUIRED"
        if self.parallelism not in ("", "auto", "folder", "file"):
            return "INVALID_PARALLELISM"
        return self.mode_error(self.use_xz, self.use_zip, self.level or 5, self.chunk_size, self.use_dictionary)

    @staticmethod
    def mode_error(xz: bool, zip_: bool, level: int, chunk: int, dictionary: bool) -> str | None:
        rules = [
            ("XZ_NO_ZIP", xz and zip_),
            ("INVALID_LEVEL_XZ", xz and not 1 <= level <= 9),
            ("XZ_NO_CHUNKING", xz and chunk > 0),
            ("XZ_NO_DICTIONARY", xz and dictionary),
            ("INVALID_LEVEL_ZIP", zip_ and not 1 <= level <= 9),
            ("ZIP_NO_CHUNKING", zip_ and chunk > 0),
            ("ZIP_NO_DICTIONARY", zip_ and dictionary),
            ("INVALID_LEVEL_ZSTD", not xz and not zip_ and not 1 <= level <= 22),
            ("DICTIONARY_NO_CHUNKING", dictionary and chunk > 0),
            ("CHUNK_TOO_SMALL", 0 < chunk < MIN_CHUNK),
            ("CHUNK_TOO_LARGE", chunk > MAX_CHUNK),
        ]
        return next((code for code, broken in rules if broken), None)

    def checked(self) -> CompressOptions:
        if code := self.error():
            raise OptionError(code)
        self.level = self.level or 5
        self.parallelism = self.parallelism or "auto"
        self.verbose = self.verbose and not self.quiet
        return self

    @property
    def archive(self) -> str:
        """Which format is written: xz, zip, dictionary, chunks, plain, in this order."""
        return "xz" if self.use_xz else "zip" if self.use_zip else "3" if self.use_dictionary else "2" if self.chunk_size else "1"


@dataclass
class RestoreOptions:
    input_path: str = ""
    output_path: str = "."
    overwrite: bool = False

    def checked(self) -> RestoreOptions:
        if not self.input_path:
            raise OptionError("INPUT_REQUIRED")
        self.output_path = self.output_path or "."
        return self


@dataclass
class VerifyOptions:
    input_path: str = ""
    verify_data: bool = False
    verbose: bool = False

    def checked(self) -> VerifyOptions:
        if not self.input_path:
            raise OptionError("INPUT_REQUIRED")
        return self


def mode_error_column(xz: Column, zip_: Column, level: Column, chunk: Column, dictionary: Column) -> Column:
    """``CompressOptions.mode_error`` over a table of options; null where they are allowed."""
    level = F.when(level == 0, 5).otherwise(level)
    nine = ~level.between(1, 9)
    out = F.when(xz & zip_, "XZ_NO_ZIP").when(xz & nine, "INVALID_LEVEL_XZ").when(xz & (chunk > 0), "XZ_NO_CHUNKING").when(xz & dictionary, "XZ_NO_DICTIONARY")
    out = out.when(zip_ & nine, "INVALID_LEVEL_ZIP").when(zip_ & (chunk > 0), "ZIP_NO_CHUNKING").when(zip_ & dictionary, "ZIP_NO_DICTIONARY")
    out = out.when(~xz & ~zip_ & ~level.between(1, 22), "INVALID_LEVEL_ZSTD").when(dictionary & (chunk > 0), "DICTIONARY_NO_CHUNKING")
    return out.when((chunk > 0) & (chunk < MIN_CHUNK), "CHUNK_TOO_SMALL").when(chunk > MAX_CHUNK, "CHUNK_TOO_LARGE")
