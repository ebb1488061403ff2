"""``python -m siltstone.cli compress|restore|verify|version``."""

from __future__ import annotations

import argparse
import sys

from . import __version__
from .operators.verify import summary_text
from .plans.engine import Engine, resolve_input
from .plans.options import CompressOptions, RestoreOptions, VerifyOptions
from .session import session


def kilobytes(text: str) -> int:
    from pyspark.sql import functions as F

    from .functions.scalars import parse_size

    value = session().range(1).select(parse_size(F.lit(text))).first()[0]
    if value is None:
        raise SystemExit(f"not a size: {text}")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("siltstone")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress")
    c.add_argument("-i", "--input", default="")
    c.add_argument("--files", nargs="*", default=[])
    c.add_argument("-o", "--output", default="archive")
    c.add_argument("-t", "--threads", type=int, default=0)
    c.add_argument("--parallelism", default="auto")
    c.add_argument("-l", "--level", type=int, default=5)
    c.add_argument("--chunk-size", default="0")
    c.add_argument("--chunk-store-size", default="0")
    c.add_argument("--parts", type=int, default=0)
    for flag in ("dictionary", "zip", "xz", "gitignore", "dry-run", "quiet", "verbose"):
        c.add_argument(f"--{flag}", action="store_true")
    r = sub.add_parser("restore", aliases=["decompress"])
    r.add_argument("-i", "--input", required=True)
    r.add_argument("-o", "--output", default=".")
    r.add_argument("--overwrite", action="store_true")
    v = sub.add_parser("verify")
    v.add_argument("-i", "--input", required=True)
    v.add_argument("--data", action="store_true")
    v.add_argument("--verbose", action="store_true")
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    engine = Engine(session())
    if a.command == "compress":
        options = CompressOptions(a.input, tuple(a.files), a.output, a.threads, a.parallelism, a.level, kilobytes(a.chunk_size) * 1024, kilobytes(a.chunk_store_size) // 1024, a.dictionary, a.zip, a.xz, a.gitignore, a.dry_run, a.parts, a.quiet, a.verbose)
        out = engine.compress(options)
    elif a.command == "verify":
        out = engine.verify(VerifyOptions(resolve_input(a.input), a.data, a.verbose))
    else:
        done = engine.restore(RestoreOptions(resolve_input(a.input), a.output, a.overwrite)).groupBy("status").count().collect()
        print("\n".join(f"{r['status']}: {r['count']}" for r in done))
        return int(any(r["status"] != "OK" for r in done))
    if not getattr(a, "quiet", False):
        print(summary_text(out, a.command).first()[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
