"""Embedding dedup, Jaccard join, suffix-array and FM-index dedup, components, site quality and the pipeline."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from siltstone.llm import anchors, embedding_dedup, fm_index, jaccard, repetition, site_quality, suffix_dedup
from siltstone.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark, rng):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(600, 600 + i) for i in range(50)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert {k: v for k, v in want.items() if v in got} | {k: v for k, v in want.items()} == {k: got.get(k, k) for k in want}
    assert components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


# ------------------------------------------------------------------ op 2


def test_embedding_links_against_brute_force(spark, rng):
    npr = np.random.default_rng(5)
    base = npr.normal(size=(25, 12))
    vectors = [(base[rng.randrange(25)] + npr.normal(scale=rng.choice([0.05, 0.2, 0.5]), size=12)).astype(float).tolist() for _ in range(300)]
    vectors += [vectors[0]] * 40 + [(np.array(vectors[1]) * 3).tolist(), None, [0.0] * 12, [float("nan")] * 12, [1.0, None] * 6, [], vectors[2][:6], [float("inf")] * 12]
    rows = [(i, v) for i, v in enumerate(vectors)]
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows}
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b):
                a_, b_ = np.array(a), np.array(b)
                if a_ @ b_ / (np.sqrt(a_ @ a_) * np.sqrt(b_ @ b_)) >= 0.95:
                    links[i].add(j)
    root = roots(links, [(i, j) for i in links for j in links[i]])
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    for i in links:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links[i]), root[i], root[i] == i), i


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "QUERIES", 16)
    npr = np.random.default_rng(1)
    x = np.concatenate([npr.normal(size=(1, 8)) + npr.normal(scale=0.02, size=(60, 8)), npr.normal(size=(40, 8))])
    got = embedding_dedup.embedding_links(spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, cls string")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(want.tolist()))
    assert embedding_dedup.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize(("n", "top", "lists"), [(20_000, 1024, 200), (2000, 6, 20)])
def test_embedding_recall_on_planted_pairs(spark, monkeypatch, n, top, lists):
    """Partners at 0.95 to 0.999 in random directions; with few centroids, lists have a second level."""
    monkeypatch.setattr(embedding_dedup, "TOP", top)
    monkeypatch.setattr(embedding_dedup, "LIST", lists)
    npr = np.random.default_rng(2)
    x = npr.normal(size=(n * 4 // 5, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    of = npr.integers(0, len(x), n - len(x))
    away = npr.normal(size=(len(of), 32))
    away -= (away * x[of]).sum(1, keepdims=True) * x[of]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = npr.uniform(0.95, 0.999, (len(of), 1))
    x = np.concatenate([x, cos * x[of] + np.sqrt(1 - cos**2) * away])
    want = np.concatenate([(x[i : i + 2000] @ x.T >= 0.95).sum(1) - 1 for i in range(0, len(x), 2000)])
    got = embedding_dedup.embedding_links(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).select("vec_id", "n_links").collect()
    found = np.zeros(len(x), int)
    found[[r["vec_id"] for r in got]] = [r["n_links"] for r in got]
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum() > 0


# ------------------------------------------------------------------ op 3


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize(("marked", "block"), [(1 << 23, 1024), (3, 3)])
def test_jaccard_against_brute_force(spark, rng, monkeypatch, marked, block):
    monkeypatch.setattr(jaccard, "MARKED", marked)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(12)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t + (passage if rng.random() < 0.4 else [])))
    texts += [" ".join(passage)] * 6 + ["A b", "a B", "a b c", None, "", " \n", "One two three four five", "one two three four five"]
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = {i: shingles(t) for i, t in rows}
    edges = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = roots(sets, edges)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "a b", "x")], "doc_id long, text string, n string")
    got = jaccard.jaccard_groups(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {i: (len(sets[i]), root[i]) for i in sets}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None] and len(got) == len(rows) + 1
    kept = {r["doc_id"] for r in jaccard.keep_one(df).collect()}
    assert kept == {i for i in root if root[i] == i} | {None}


def test_jaccard_starts_few_jobs_at_once(spark, rng, monkeypatch):
    """Each job and broadcast of an execution that starts takes memory of the driver, all together."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    words = [f"w{i}" for i in range(200)]
    base = [rng.choice(words) for _ in range(40)]
    rows = [(i, " ".join([*base[: rng.randrange(15, 40)], *(rng.choice(words) for _ in range(rng.randrange(12)))])) for i in range(60)]
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    groups = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList(before, 1000)
    jobs = [ran.apply(i).jobs().size() for i in range(ran.size())]
    assert len(groups) == 60 and len({r["component_id"] for r in groups}) < 60
    assert len(jobs) > 20 and max(jobs) <= 9, jobs


def test_jaccard_empty(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------ ops 7 and 10


def order(i):
    return -(1 << 63) if i is None else i


def bytes_brute(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], 1 << 63), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < order(i):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("piece", "popular"), [(64, 8), (1 << 20, 8), (1 << 20, 1)])
def test_suffix_dedup_against_brute_force(spark, rng, monkeypatch, piece, popular):
    monkeypatch.setattr(anchors, "POPULAR", popular)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    text = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    parts = [text(60), text(80), text(50), text(49), "a" * 120, "ab" * 60]
    rows = [(i, "".join(rng.choice([*parts, text(rng.randrange(20))]) for _ in range(rng.randrange(6)))) for i in range(80)]
    rows += [(300, "a" * 3000 + "b" + "a" * 2000), (301, "ab" * 900 + "c"), (299, "a" * 1500), (302, "ba" * 700)]  # runs of one place each
    rows += [(None, parts[0] + parts[1]), (None, None), (7, parts[1] + "zz" + parts[0]), (7, parts[1] + "zz" + parts[0]), (200, None), (201, "")]
    rng.shuffle(rows)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], key=repr) == bytes_brute(rows)
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def words_brute(rows, length=20):
    first, out = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            first[k] = min(first.get(k, (1 << 63, 0)), (order(i), p))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {p + k for p in range(len(w) - length + 1) if first[tuple(w[p : p + length])] < (order(i), p) for k in range(length)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("popular", [8, 1])
def test_fm_index_dedup_against_brute_force(spark, rng, monkeypatch, popular):
    monkeypatch.setattr(anchors, "POPULAR", popular)
    text = lambda n: " ".join(rng.choice(["a", "b", "é", "cc"]) for _ in range(n))
    parts = [text(25), text(40), text(20), text(19), " ".join(["x"] * 60), " ".join(["x", "y"] * 30)]
    rows = [(i, " ".join(rng.choice([*parts, text(rng.randrange(12))]) for _ in range(rng.randrange(6)))) for i in range(80)]
    rows += [(400, "x " * 500 + "z " + "x " * 300), (401, "x y " * 200 + "q"), (399, "y x " * 90)]
    rows += [(None, parts[0]), (200, None), (201, ""), (7, rows[7][1]), (300, "\t".join(parts[1].split(" ")))]
    rng.shuffle(rows)
    got = fm_index.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([tuple(r) for r in got.drop("kept").collect()], key=repr) == words_brute(rows)
    assert fm_index.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("op", "cut"), [(suffix_dedup, 1 << 12), (suffix_dedup, 7), (fm_index, 1 << 12), (fm_index, 7)])
def test_places_of_a_popular_stretch_share_a_row(spark, rng, monkeypatch, op, cut):
    """The join with verdicts makes a row for each content and block (or ``cut`` places), not for each place: none more for a larger group of copies."""
    monkeypatch.setattr(anchors, "APART", cut)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(30))
    made, real = [], op.all_spans

    def watched(found, hot, by_id):
        least = found.where("h1 IS NOT NULL")
        assert least.count() == least.select("h1", "h2").distinct().count() > 0
        assert hot.join(least, ["h1", "h2"]).count() == hot.count()
        sizes = [len(r[0]) // 32 for r in hot.select("places").collect()]
        made.append((len(sizes), sum(sizes)))
        assert max(sizes) <= cut
        return real(found, hot, by_id)

    monkeypatch.setattr(op, "all_spans", watched)
    for copies in (56, 224):
        rows = [(i, f"{word()} {word()} {passage} {word()}") for i in range(copies)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        if op is suffix_dedup:
            got = op.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
            want = bytes_brute(rows)
        else:
            got, want = op.substring_dedup(docs).drop("kept"), words_brute(rows)
        assert sorted([tuple(r) for r in got.collect()], key=repr) == want
    (few, places), (more, all_places) = made
    assert all_places >= 3.5 * places
    assert more == few if cut > 224 else few < more <= 4 * few + 4


def test_blocks_without_a_popular_stretch(spark, rng):
    passage = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30))
    rows = [(i, passage) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted([tuple(r) for r in got], key=repr) == bytes_brute(rows)
    assert sorted([tuple(r) for r in fm_index.substring_dedup(docs).drop("kept").collect()], key=repr) == words_brute(rows)


def test_backward_search_counts(rng):
    text = np.array([rng.randrange(1, 6) if i % 37 else 0 for i in range(1, 500)] + [0])
    index = fm_index.FMIndex(text, 6)
    for _ in range(200):
        start, n = rng.randrange(490), rng.randrange(1, 8)
        pattern = text[start : start + n]
        if 0 in pattern:
            continue
        lo, hi = index.less[pattern[-1:]], index.less[pattern[-1:] + 1]
        for c in pattern[:-1][::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        places = {i for i in range(len(text) - n + 1) if (text[i : i + n] == pattern).all()}
        assert set(index.locate(np.arange(int(lo[0]), int(hi[0]))).tolist()) == places


# ------------------------------------------------------------------ op 8


def test_site_quality(spark, rng):
    good, bad, toxic = [[f"{k}{i}" for i in range(30)] for k in ("good", "bad", "toxic")]
    rows, labels = [], []
    for i in range(400):
        kind = rng.choice(["good", "good", "bad", "toxic"])
        own = {"good": good, "bad": bad, "toxic": toxic}[kind]
        rows.append((i, " ".join(rng.choice(own + ["the", "of"]) for _ in range(40)), rng.choice(["en", None]), rng.choice(["s0", "s1", None])))
        labels.append((i, int(kind != "bad"), int(kind == "toxic")))
    rows += [(1000, None, "en", "s9"), (1001, "", "en", "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    train = spark.createDataFrame(labels[:300] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in site_quality.site_quality(df, train).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    right = [got[i]["kept"] == (q == 1 and t == 0) for i, q, t in labels[300:]]
    assert sum(right) >= 0.97 * len(right)
    none = site_quality.site_quality(df, train.where("false")).collect()
    assert len(none) == len(rows)
    assert site_quality.site_quality(df.where("false"), train).count() == 0


def test_sparse_sites_lean_on_their_host(spark):
    rows = [(i, "x" if i % 5 else "y", "en", "big") for i in range(200)] + [(900 + i, "y", "fr", "big") for i in range(3)] + [(950 + i, "y", "de", "big") for i in range(40)]
    labels = [(i, int(i % 5 > 0), 0) for i in range(200)]
    got = {r["doc_id"]: r for r in site_quality.site_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    sparse, dense, host = got[900]["path_mean"], got[950]["path_mean"], got[900]["host_mean"]
    assert got[900]["evidence"] == got[950]["evidence"] and dense < sparse < host  # the same evidence, less of it


# -------------------------------------------------------------- pipeline


def test_pipeline_stages_are_the_operators(spark, tmp_path, rng):
    import corpus_pipeline

    words = {"en": ["the", "and", "tion", "that", "ing"], "de": ["der", "und", "ein", "sch", "ung"]}
    rows = []
    for i in range(60):
        lang = rng.choice(list(words))
        text = ("\n" if i >= 5 else " ").join(" ".join("".join(rng.choice(words[lang]) for _ in range(3)) for _ in range(8)) for _ in range(6))
        rows.append((i, text, lang, rng.choice(["a", "b"]), len(text)))
    rows += [(100 + i, rows[i][1] + " end", rows[i][2], "b", 1) for i in range(5)] + [(200, None, "en", "a", 0), (201, "12 34", "en", "a", 5), (202, "solo", None, None, 4)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "mixing", "bpe"]
    now, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = stage(spark, before, str(tmp_path))
        if k < 4:
            assert now.columns == before.columns
        now.write.parquet(str(tmp_path / f"{k}"))
        now = spark.read.parquet(str(tmp_path / f"{k}"))
        counts.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert {200, 201} & counts[0] == set() and 202 in counts[0]
    assert not {100, 101, 102, 103, 104} & counts[2]  # near copies of one line are gone
    assert set(range(60)) <= counts[2]
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, now.select("doc_id", "n_tokens").collect()))


def test_pipeline_language_stage_decides_by_score(spark, rng):
    import corpus_pipeline

    words = {"en": ["the", "and", "tion", "that", "ing"], "de": ["der", "und", "ein", "sch", "ung"]}
    rows = [(i, " ".join("".join(rng.choice(words[lang]) for _ in range(3)) for _ in range(40)), lang, "a") for i in range(60) for lang in [rng.choice(list(words))]]
    odd = [(100, "привет это текст", "en", "a"), (101, "这是一个中文句子", None, "a"), (102, "qzqz xzvq zqjx qxvz", "de", "a"), (103, None, "en", "a"), (104, "12 34", "en", "a")]
    # Ids of odd texts are such that none is learned from.
    ids = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 3 == 1][: len(odd)]
    odd = [(i, *r[1:]) for i, r in zip(ids, odd, strict=True)]
    ddl = "doc_id long, text string, lang string, source string"
    got = corpus_pipeline.languages(spark, spark.createDataFrame(rows + odd, ddl), "")
    assert got.columns == ["doc_id", "text", "lang", "source"]
    assert sorted(map(tuple, got.collect())) == rows
    unlabelled = [(i, t, None, s) for i, t, _, s in rows]
    assert sorted(map(tuple, corpus_pipeline.languages(spark, spark.createDataFrame(unlabelled, ddl), "").collect())) == unlabelled


# ------------------------------------------------------------------ hashes


def thue_morse(bits, a="a", b="b"):
    return "".join(b if i.bit_count() & 1 else a for i in range(1 << bits))


def test_words_that_polynomial_hashes_confuse(spark):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2^64, whatever the base."""
    x, y = thue_morse(10), thue_morse(10, "b", "a")
    two = spark.createDataFrame([(1, x), (2, y), (3, x.upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(two).collect()} == {1: 1, 2: 2, 3: 1}
    long = lambda first: " ".join([first, *[f"w{i}" for i in range(19)]])
    rows = [(1, long(x)), (2, long(y)), (3, long(x))]
    got = fm_index.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()
    assert sorted([tuple(r) for r in got], key=repr) == words_brute(rows)
    lines = spark.createDataFrame([(1, f"{x}\n{y}"), (2, f"{x}\n{x}\n {x}")], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in repetition.quality_rules(lines).collect()} == {1: (0, 0), 2: (1, 0)}


def test_all_links(spark, rng, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    words = [f"w{i}" for i in range(50)]
    base = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(60):  # one group of near copies: a tile of many classes
        t = list(base)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t + [rng.choice(words) for _ in range(rng.randrange(20))]))
    rows = list(enumerate(texts))
    sets = {i: shingles(t) for i, t in rows}
    found, members = jaccard.links(spark.createDataFrame(rows, "doc_id long, text string"))
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    assert all(sets[i] == sets[r] and r <= i for i, r in rep.items()) and len(rep) == len(rows)
    reps = sorted(set(rep.values()))
    want = {(i, j) for i in reps for j in reps if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(want) > 100 and {(r["a"], r["b"]) for r in found.collect()} == want


def test_matching_statistics_against_brute_force(rng):
    for most in (3, 8):
        parts = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))] for _ in range(12)]
        text = np.array([x for p in parts for x in [*p, 0]])
        index = fm_index.FMIndex(text, 5)
        ends = np.flatnonzero(text) + 1
        assert index.locate(np.arange(len(text))).tolist() == fm_index.suffix_array(text).tolist()
        got = index.matching_statistics(text, ends, most)[0]
        for end, n in zip(ends.tolist(), got.tolist(), strict=True):
            best = 0
            for k in range(1, most + 1):
                own = text[max(0, end - k) : end]
                if len(own) < k or 0 in own or sum((text[i : i + k] == own).all() for i in range(len(text) - k + 1)) < 2:
                    break
                best = k
            assert n == best
