import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunks as C
from siltstone.operators import paths as P

TABLES = [
    ({"": "*.log\nbuild/\n*.tmp"}, {"keep.txt": False, "debug.log": True, "cache.tmp": True, "build/output.bin": True, "src/main.go": False}),
    ({"": "*.log", "src": "*.tmp"}, {"debug.log": True, "src/cache.tmp": True, "src/main.go": False, "src/lib/data.txt": False}),
    ({"": "*.log\n!important.log"}, {"debug.log": True, "important.log": False, "keep.txt": False}),
    ({"": "# note\n\n*.log\n\nbuild/\n"}, {"debug.log": True, "keep.txt": False}),
    ({"": "**/temp/\n**/*.bak"}, {"file.bak": True, "a/file.bak": True, "a/b/file.bak": True, "keep.txt": False, "a/temp/x": True}),
    ({"": "*.log", "src": "!keep.log"}, {"src/keep.log": True}),
    ({"": "/top.txt\ndoc/*.txt\nfoo[ab].c\nq?.x"}, {"top.txt": True, "a/top.txt": False, "doc/a.txt": True, "doc/b/a.txt": False, "fooa.c": True, "fooc.c": False, "q1.x": True}),
    ({}, {"a.log": False}),
]


@pytest.mark.parametrize("rules, expected", TABLES)
def test_ignore_rules(spark, rules, expected):
    table = spark.createDataFrame(P.ignore_rules(rules), P.RULES_DDL)
    paths = spark.createDataFrame([(p,) for p in expected], "rel_path string")
    assert {r["rel_path"]: r["ignored"] for r in P.ignored(paths, table).collect()} == expected


def test_pruned_directories(spark):
    table = spark.createDataFrame(P.ignore_rules({"": "build/\nnode_modules/\n*.log"}), P.RULES_DDL)
    dirs = spark.createDataFrame([(d,) for d in ("build", "node_modules", "src", "debug.log")], "rel_path string")
    assert {r[0] for r in P.pruned_directories(dirs, table).where("pruned").collect()} == {"build", "node_modules"}


def test_dedup_store_table(spark):
    chunks = spark.createDataFrame([("a", 0, 0, 100, "h1"), ("a", 1, 100, 100, "h2"), ("b", 0, 0, 100, "h1")], "rel_path string, chunk_idx long, chunk_offset long, chunk_len long, hash string")
    row = C.dedup_stats(chunks, capacity=1).first()
    assert (row["total_chunks"], row["unique_chunks"], row["deduped_chunks"], row["bytes_saved"], row["evictions"]) == (3, 2, 1, 50, 1)
    none = C.dedup_stats(chunks.where("false")).first()
    assert (none["total_chunks"], none["dedup_ratio"]) == (0, 0.0)
    assert C.new_chunks(chunks, spark.createDataFrame([("h1",)], "hash string")).count() == 1


def test_ratios(spark):
    table = spark.createDataFrame([(10, 0), (10, 5), (10, 10), (0, 0)], "total long, part long")
    assert [r[0] for r in table.orderBy("total", "part").select(C.guarded_percent(F.col("part"), F.col("total"))).collect()] == [0.0, 0.0, 50.0, 100.0]


def test_duplicate_path_is_an_error(spark):
    with pytest.raises(ValueError):
        C.reject_duplicate_paths(spark.createDataFrame([("a",), ("a",)], "rel_path string"))


def test_incremental_stream(spark, tmp_path):
    from siltstone.functions.chunking import ChunkOptions
    from siltstone.sources.files import FILE_DDL, as_files
    from siltstone.streaming.dedup import dedup_folder

    def add(name, content):
        as_files(spark.createDataFrame([(name, bytearray(content))], "p string, c binary"), F.col("p"), F.col("c")).write.mode("append").parquet(str(tmp_path / "in"))
        return dedup_folder(spark, str(tmp_path / "in"), FILE_DDL, lambda d: d, str(tmp_path / "out"), str(tmp_path / "state"), ChunkOptions(256)).count()

    first = add("a", b"0123456789abcdef" * 500)
    assert first > 0 and add("b", b"0123456789abcdef" * 500) == first and add("c", b"another text. " * 99) > first


def test_nested_rule_file_decides_rows_of_the_query(spark, tmp_path):
    from siltstone.catalogue import QUERIES

    want = {"thhaed.example.com/fr/1.html": True, "thhaed.example.com/fr/77": True, "thhaed.example.com/a/fr/2": True, "thhaed.example.com/en/1": False, "thhaed.example.com/en/7": True, "other.example.com/fr/1": False, "thhaed.example.com/fr": False}
    pages = [(i, f"http://{p}?q=1", "") for i, p in enumerate(want)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r["rel_path"]: r["ignored"] for r in QUERIES["gitignore_filter"](spark, str(tmp_path)).collect()} == want


def test_patterns_that_are_none_are_skipped():
    assert [r[2] for r in P.ignore_rules({"": "*[z-a]*\n*.log\n[\n"})] == ["*.log", "["]
