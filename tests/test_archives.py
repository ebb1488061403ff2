import os

import pytest

from siltstone.functions import scalars as S
from siltstone.operators.verify import verify_entries
from siltstone.plans.engine import Engine, resolve_input
from siltstone.plans.options import CompressOptions, OptionError, RestoreOptions, VerifyOptions
from siltstone.sources import archives as A
from siltstone.sources.files import scan_directory, scan_list

FILES = {"a.txt": b"Hello", "d/b.bin": bytes(i % 256 for i in range(20_000)), "d/e/empty.txt": b"", "d/e/text.txt": b"The quick brown fox. " * 500, "copy.txt": b"The quick brown fox. " * 500}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    for name, data in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root


def test_scan_keeps_empty_files_and_relative_paths(spark, tree):
    got = {r["rel_path"]: (r["folder"], bytes(r["content"])) for r in scan_directory(spark, str(tree)).collect()}
    assert got == {k: (k.rpartition("/")[0], v) for k, v in FILES.items()}


def test_scan_of_a_list_names_folders_and_files(spark, tree):
    got = {r["rel_path"] for r in scan_list(spark, [str(tree / "d"), str(tree / "a.txt")]).collect()}
    assert got == {"a.txt", "d/b.bin", "d/e/empty.txt", "d/e/text.txt"}


@pytest.mark.parametrize(
    "options",
    [dict(), dict(chunk_size=4096), dict(use_dictionary=True), dict(use_zip=True, parts=3), dict(use_xz=True, parts=2), dict(use_zip=True, level=1), dict(level=22)],
)
def test_round_trip(spark, tree, tmp_path, options):
    engine = Engine(spark)
    row = engine.compress(CompressOptions(str(tree), output_path=str(tmp_path / "out"), **options)).first()
    assert row["files_total"] == len(FILES) and row["archive_bytes"] > 0
    made = sorted(p for p in os.listdir(tmp_path) if p.startswith("out"))
    assert made and not [p for p in made if p.endswith(".tmp")]
    if "parts" in options:
        assert [p.split(".")[0] for p in made] == [f"out_{i:02d}" for i in range(1, len(made) + 1)]
    done = engine.restore(RestoreOptions(str(tmp_path / "out*"), str(tmp_path / "back"))).collect()
    assert {r["status"] for r in done} == {"OK"}
    assert {k: (tmp_path / "back" / k).read_bytes() for k in FILES} == FILES
    again = engine.restore(RestoreOptions(str(tmp_path / "out*"), str(tmp_path / "back"))).collect()
    assert {r["status"] for r in again} == {"TARGET_EXISTS"}
    check = engine.verify(VerifyOptions(str(tmp_path / "out*"), True)).first()
    assert check["is_valid"] and check["verified"] == len(FILES) and check["empty_files"] == 1


def test_dry_run_writes_nothing(spark, tree, tmp_path):
    row = Engine(spark).compress(CompressOptions(str(tree), output_path=str(tmp_path / "none"), chunk_size=4096, dry_run=True)).first()
    assert row["archive_bytes"] > 0 and row["deduped_chunks"] > 0 and not [p for p in os.listdir(tmp_path) if p.startswith("none")]


def _verified(spark, data):
    return verify_entries(A.read_entries(spark.createDataFrame([("x", bytearray(data))], "path string, content binary"))).first()


@pytest.mark.parametrize("write", [lambda f: A.write_1(f), lambda f: A.write_2(f, 4096), lambda f: A.write_3(f), lambda f: A.write_zip(f), lambda f: A.write_xz(f)])
def test_damage_is_found(spark, write):
    data = write(list(FILES.items()))
    assert _verified(spark, data)["is_valid"]
    assert not _verified(spark, data[: len(data) * 2 // 3])["is_valid"]
    at = len(data) * 2 // 3
    assert not _verified(spark, data[:at] + bytes(b ^ 0xFF for b in data[at : at + 10]) + data[at + 10 :])["is_valid"]


def test_unknown_and_short(spark):
    for data in (b"INVALIDMAGIC", b"GDELTA", b""):
        assert not _verified(spark, data)["is_valid"]


def test_missing_chunks_and_duplicate_paths(spark):
    assert _verified(spark, A.write_1([("a", b"1"), ("a", b"2")]))["duplicate_paths"] == 1
    data = bytearray(A.write_2([("a", b"x" * 100)], 4096))
    data[24] ^= 1  # another hash in the index
    assert _verified(spark, bytes(data))["corrupt"] == 1


def test_hostile_entries_stay_outside(spark, tmp_path):
    (tmp_path / "evil.zip").write_bytes(A.write_zip([("../escaped.txt", b"x"), ("safe.txt", b"y")]))
    done = {r["path"]: r["status"] for r in Engine(spark).restore(RestoreOptions(str(tmp_path / "evil.zip"), str(tmp_path / "o"))).collect()}
    assert done == {"../escaped.txt": "UNSAFE_PATH", "safe.txt": "OK"} and not (tmp_path / "escaped.txt").exists()


def test_gitignore_in_a_scan(spark, tree, tmp_path):
    (tree / ".gitignore").write_text("*.bin\ne/\n")
    files = Engine(spark).scan(CompressOptions(str(tree), use_gitignore=True))
    assert {r["rel_path"] for r in files.collect()} == {".gitignore", "a.txt", "copy.txt"}


def test_errors_have_codes(spark, tmp_path):
    for options, code in ((dict(), "INPUT_REQUIRED"), (dict(input_path="x", use_xz=True, use_zip=True), "XZ_NO_ZIP"), (dict(input_path="x", chunk_size=100), "CHUNK_TOO_SMALL"), (dict(input_path="x", parallelism="no"), "INVALID_PARALLELISM")):
        with pytest.raises(OptionError) as e:
            CompressOptions(**options).checked()
        assert e.value.code == code
    with pytest.raises(OptionError) as e:
        (tmp_path / "void").mkdir()
        (tmp_path / "void" / "x.bin").write_bytes(b"1")
        (tmp_path / "void" / ".gitignore").write_text("*\n")
        Engine(spark).compress(CompressOptions(str(tmp_path / "void"), use_gitignore=True, output_path=str(tmp_path / "v")))
    assert e.value.code == "NO_FILES"


def test_names(tmp_path):
    assert resolve_input(str(tmp_path / "x")).endswith("x.gdelta")
    (tmp_path / "x.zip").write_bytes(b"")
    assert resolve_input(str(tmp_path / "x")).endswith("x.zip")
    assert A.detect(S.MAGIC_2) == "ARCHIVE2"
