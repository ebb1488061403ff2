import pytest

from siltstone.operators import planning as L


def greedy(sizes, workers):
    load, count = [0] * workers, [0] * workers
    for size in sorted(sizes, reverse=True):
        w = min(range(workers), key=lambda i: (load[i], i))
        load[w], count[w] = load[w] + size, count[w] + 1
    return list(zip(range(workers), count, load, strict=True))


SKEWED = [1_000_000] + [100] * 8000
CASES = [(SKEWED, 8), ([5, 4, 3, 3, 3], 2), ([0] * 7 + [9], 3), ([7] * 23, 4), ([100_003] * 3 + [9001] * 50 + [8999] * 77 + [13] * 5000 + [1] * 999, 5), ([10, 2], 4), ([3] * 100, 1)]


@pytest.mark.parametrize("sizes, workers", CASES)
def test_assignment_is_the_plain_greedy(spark, sizes, workers):
    tasks = spark.createDataFrame([(s,) for s in sizes], "orig_size long")
    got = sorted(tuple(r) for r in L.lpt_assignment(tasks, workers).collect())
    assert got == greedy(sizes, workers)


def test_filling_is_one_by_one():
    import random

    rng = random.Random(3)
    for _ in range(2000):
        workers = rng.randrange(1, 7)
        sizes = [s for s in rng.choices(range(rng.choice([4, 60, 10**6])), k=4) for _ in range(rng.choice([1, 2, 9, 150]))]
        load, count = [0] * workers, [0] * workers
        for s in sorted(set(sizes), reverse=True):
            L._fill(load, count, s, sizes.count(s))
        assert list(zip(range(workers), count, load, strict=True)) == greedy(sizes, workers)


def test_assignment_of_nothing_and_of_null(spark):
    tasks = spark.createDataFrame([(None,), (4,)], "orig_size long")
    assert sorted(map(tuple, L.lpt_assignment(tasks, 2).collect())) == [(0, 1, 4), (1, 1, 0)]
    assert sorted(map(tuple, L.lpt_assignment(tasks.where("false"), 2).collect())) == [(0, 0, 0), (1, 0, 0)]


def test_every_file_has_its_place(spark):
    sizes = [None if i % 97 == 0 else i * 7919 % 83 for i in range(1500)]
    rows = [(f"d/{i}", s) for i, s in enumerate(sizes)] + [("d/5", sizes[5])]
    files = spark.createDataFrame(rows, "rel_path string, orig_size long").repartition(5)
    got = sorted((r["place"], r["rel_path"], r["orig_size"]) for r in L.numbered_largest_first(files).collect())
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == [(i + 1, *r) for i, r in enumerate(want)]
    assert L.numbered_largest_first(files.where("false")).count() == 0


def test_largest_first_is_no_top_list(spark, tmp_path):
    from siltstone.catalogue import QUERIES

    rows = [(i, "x" * (i % 50), "en", "web") for i in range(250)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["largest_first_all"](spark, str(tmp_path)).collect()
    assert sorted(r["place"] for r in got) == list(range(1, 251))
