"""Language ID, line dedup, repetition rules, mixing and BPE on small cases and against brute force."""

import hashlib
import re
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import bpe, language_id, line_dedup, mixing, repetition
from siltstone.llm.common import text_blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, ddl="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, ddl)


# ------------------------------------------------------------------ op 1


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module", params=[8, 128])
def own(request):
    return bpe.Codec(bpe.default_path(), request.param)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text("abehint", min_size=50, max_size=1500), st.text("aé!#1 ", max_size=400), st.lists(st.sampled_from(["<|endoftext|>", "ΑΣ", "don't", "\x1c", "\xa0", "the", "ing", "é", "中", "İ"]), max_size=60).map("".join)))
def test_bpe_is_the_library(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_on_long_unsplit_text(library, own, rng):
    for n in (127, 128, 129, 4000, 30_000):
        for alphabet in ("a", "ab", "theinganr"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_every_code_point_below_the_fast_limit(library, own):
    for c in range(ord(bpe.AGREED)):
        for text in ("a" + chr(c) + "B" + chr(c), chr(c) * 2 + "a"):
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_bpe_frames(spark):
    df = docs(spark, [(1, "Hello  World", "ids", None), (2, None, None, None), (2, None, None, None), (3, "", "", "")]).withColumnRenamed("lang", "ids")
    got = bpe.decode(bpe.encode(df)).collect()
    digests = {r["doc_id"]: r for r in bpe.digests(df).collect()}
    assert len(got) == 4
    for r in got:
        d = digests[r["doc_id"]]
        assert (len(r["ids"]), r["n_tokens"]) == (d["n_tokens"],) * 2
        assert hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() == d["ids_sha256"]
        assert hashlib.sha256(r["decoded"].encode()).hexdigest() == d["decoded_sha256"]
    assert bpe.digests(df.where("false")).count() == 0


# ------------------------------------------------------------------ op 4


def lines_brute(rows):
    seen, out = {}, {}
    for i, text in sorted({(i, t) for i, t in rows if t is not None}):
        lines = text.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if WORD.search(" ".join(w)):
                seen[w] = min(seen.get(w, (i, p)), (i, p))
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = {p + k for p in range(len(lines) - 2) if seen.get(tuple(lines[p : p + 3]), (i, p)) < (i, p) for k in range(3)}
        out[i] = None if text is None else "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_line_dedup_against_brute_force(spark, rng):
    rows = [(i, None if i == 7 else "\n".join(rng.choice(["a", "b", "", "c d", " "]) for _ in range(rng.randrange(14)))) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows, "doc_id long, text string")).collect()}
    assert got == lines_brute(rows)


def test_line_dedup_edges(spark):
    same = "x\ny\nz\nw"
    rows = [(1, same, "1"), (1, same, "2"), (2, "p\n" + same, "3"), (None, "x\ny\nz", "4"), (3, "x\ny", "5"), (4, "\n\n\n\n\n\n", "6"), (5, "", "7"), (6, None, "8")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").withColumnRenamed("n_lines", "_x")
    got = {r["_x"]: (r["text"], r["n_lines"], r["n_lines_removed"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got["1"] == got["2"] == ("w", 4, 3)  # a null id comes first
    assert got["3"] == ("p", 5, 4) and got["4"] == ("x\ny\nz", 3, 0) and got["5"] == ("x\ny", 2, 0)
    assert got["6"] == ("\n\n\n\n\n\n", 7, 0) and got["7"] == ("", 1, 0) and got["8"] == (None, 0, 0)
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


# ------------------------------------------------------------------ op 5


def repetition_brute(text, least):
    text = text or ""
    w, n_best = WORD.findall(text), None
    n, best = len(w), [0] * len(w)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    cover = lambda m, f: len({i + k for i in range(n) if best[i] >= m for k in range(f(i))})
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n_best = max(best, default=0)
    return [n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, cover(3, lambda i: 3), cover(least, lambda i: best[i]), n_best]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "ab", "é#", " ", "\n", " \t", "\x85"]), max_size=90).map("".join)), max_size=8), st.sampled_from([60, 1 << 20]))
def test_repetition_against_brute_force(texts, limit):
    column = pa.array(texts, pa.string())
    parts = [repetition.measure(d, o, 4) for _, _, d, o in text_blocks(column, limit)]
    got = [[int(v) for p in parts for v in p[k]] for k in repetition._INTS]
    assert [list(x) for x in zip(*got, strict=True)] == [repetition_brute(t, 4) for t in texts]


def test_quality_rules_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    block = " ".join(f"copy{i}" for i in range(40))
    rows = [(1, clean), (2, block + " " + block), (3, None), (4, ""), (5, "a " * 60), (6, clean + " " + " ".join(f"w{i}" for i in range(12)) + " " + clean[:60])]
    got = {r["doc_id"]: r for r in repetition.quality_rules(docs(spark, rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and got[2]["longest_repeat"] == 40 and got[6]["kept"]
    assert got[3]["base_failed"] and got[4]["base_failed"] and got[5]["base_failed"] and got[3]["n_words"] == 0


# ------------------------------------------------------------------ op 6


def test_mixing_meets_targets_and_caps(spark, rng):
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), "en", rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)] + [(1000, None, "en", "z"), (1001, "", "en", "z")]
    df = docs(spark, rows)
    got = mixing.copies(df).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mixing.copies(df.repartition(7)).collect()))
    by = {}
    for r in got:
        assert 0 <= r["copies"] <= 3
        s = by.setdefault(r["source"], [r["target"], 0, r["source_size"]])
        s[1] += r["copies"] * r["size"]
    assert sum(s[0] for s in by.values()) == pytest.approx(sum(s[2] for s in by.values()))
    for target, taken, size in by.values():
        assert abs(taken - target) <= 80 and target <= 3 * size + 1e-6
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)


def test_mixing_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 15 and got["b"] == pytest.approx(1970 * 2 / 3) and got["c"] == pytest.approx(1970 / 3)
    assert mixing.copies(docs(spark, []).where("false")).count() == 0


def test_mixing_repeated_rows(spark):
    rows = [(1, "a b c", "en", "s")] * 5 + [(2, "d", "en", "t")] * 2
    df = docs(spark, rows)
    assert mixing.mix(df).count() == sum(r["copies"] for r in mixing.copies(df).collect())


# ------------------------------------------------------------------ op 9


def test_language_profiles(spark, rng):
    words = {"en": ["the", "and", "ing", "that", "tion"], "de": ["der", "und", "ein", "sch", "ung"], "fr": ["que", "les", "eau", "ment", "été"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, "s") for i in range(120) for lang in [rng.choice(list(words))]]
    odd = [(500, None, "en", "s"), (501, "123 !?", "en", "s"), (502, "", None, "s"), (None, "the and", "en", "s"), (3, rows[3][1], rows[3][2], "s")]
    got = language_id.identify(docs(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] == held and 0 <= r["score"] <= 1
        if r["doc_id"] in (500, 501, 502):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == r["lang"]
    none = language_id.identify(docs(spark, [(1, "abc", None, "s")])).collect()
    assert none[0]["lang_pred"] == "und"
    assert language_id.identify(docs(spark, []).where("false")).count() == 0


def test_language_reads_nothing_but_text(spark, rng):
    rows = [(i, "the and of to in" if i % 2 else "der und von zu im", "en" if i % 2 else "de", "s") for i in range(40)]
    profiles = language_id.learn(docs(spark, rows))
    a = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs(spark, rows), profiles).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs(spark, [(i, t, "xx", None) for i, t, _, _ in rows]), profiles).collect()}
    assert a == b
