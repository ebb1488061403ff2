from siltstone import __version__, cli
from siltstone.plans.progress import counted
from siltstone.sources.files import scan_directory


def test_compress_verify_restore(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.txt").write_bytes(b"some text " * 3000)
    out = str(tmp_path / "out")
    assert cli.main(["compress", "-i", str(tmp_path / "in"), "-o", out, "--chunk-size", "4KB"]) == 0
    assert "deduped_chunks" in capsys.readouterr().out
    assert cli.main(["verify", "-i", out, "--data"]) == 0
    assert "is_valid: true" in capsys.readouterr().out
    assert cli.main(["restore", "-i", out, "-o", str(tmp_path / "back")]) == 0
    assert (tmp_path / "back" / "3.txt").read_bytes() == b"some text " * 3000
    assert cli.main(["restore", "-i", out, "-o", str(tmp_path / "back")]) == 1
    assert cli.main(["version"]) == 0 and __version__ in capsys.readouterr().out


def test_counts_are_observed(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"12345")
    (tmp_path / "b").write_bytes(b"")
    files, seen = counted(scan_directory(spark, str(tmp_path)))
    files.count()
    assert seen.get == {"files": 2, "bytes": 5}
