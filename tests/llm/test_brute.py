"""Language ID, site posteriors and the whole pipeline against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from siltstone.llm import bpe, language_id, mixing, site_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    """N-grams of one to three letters, words marked by a blank before and after."""
    low = " " + re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in text)).lstrip(" ")
    out = Counter(c for c in low if c != " ")
    out.update(low[i : i + 2] for i in range(len(low) - 1))
    out.update(low[i : i + 3] for i in range(len(low) - 2) if low[i + 1] != " ")
    return out


def ranked(counts, top):
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]


def profiles(rows, top):
    by = defaultdict(Counter)
    for i, text, lang in rows:
        if i is not None and lang is not None and text is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            by[lang] += grams(text)
    return {lang: {g: r for r, g in enumerate(ranked(by[lang], top))} for lang in sorted(by)}


def out_of_place(text, known, top):
    own = ranked(grams(text), top) if text and any(c.isalpha() for c in text) else []
    if not own or not known:
        return "und", 0.0
    away = {lang: sum(min(abs(ranks[g] - r), top) if g in ranks else top for r, g in enumerate(own)) for lang, ranks in known.items()}
    lang = min(away, key=lambda k: (away[k], k))
    return lang, 1 - away[lang] / (top * len(own))


def sentences(rng, lang, n):
    words = {"en": ["the", "and", "tion", "that", "ing"], "de": ["der", "und", "ein", "sch", "ung"], "fr": ["que", "les", "eau", "été", "ment"]}
    return "\n".join(" ".join("".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(8)) for _ in range(n))


def test_language_id_against_brute_force(spark, rng):
    rows = [(i, sentences(rng, lang, rng.randrange(1, 6)), rng.choice([lang, lang, None])) for i in range(90) for lang in [rng.choice(["en", "de", "fr"])]]
    rows += [(200, None, "en"), (201, "12 !", "de"), (None, "the that", "en"), (202, "İstanbul ǅ ß 中文 été", None), (203, "  a  b-c", None), (203, "  a  b-c", None)]
    known = profiles(rows, language_id.TOP)
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = sorted(((r["doc_id"], r["text"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(df).collect()), key=repr)
    want = sorted(((i, t, p, round(s, 9)) for i, t, _ in rows for p, s in [out_of_place(t, known, language_id.TOP)]), key=repr)
    assert got == want


# ------------------------------------------------------------------ op 8


def strength(groups, mean):
    n, n2 = sum(n for n, _ in groups), sum(n * n for n, _ in groups)
    within = mean * (1 - mean)
    if len(groups) < 2 or not within or n2 >= n * n:
        return 100.0
    between = (sum(n * (g / n - mean) ** 2 for n, g in groups) - (len(groups) - 1) * within) / (n - n2 / n)
    return min(1e5, max(1.0, within / max(between, 1e-9) - 1))


def logit(p):
    p = max(min(p, 1 - 1e-6), 1e-6)
    return math.log(p / (1 - p))


def test_labels_of_a_site_turn_verdicts(spark, rng):
    """Texts that tell nothing: the same evidence is kept on a host of good labels and goes on one of bad ones."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), rng.choice(["en", "de", None]), host, 0.5) for i in range(400) for host in [rng.choice(["good", "bad"])]]
    labels = {i: (int(host == "good"), 0) for i, _, _, host, _ in rows if i < 200}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    got = {r["doc_id"]: r for r in site_quality.site_quality(df, spark.createDataFrame([(i, *y) for i, y in labels.items()], "doc_id long, quality int, toxic int")).collect()}
    host = {i: h for i, _, _, h, _ in rows}
    turned = [i for i in host if i >= 200 and got[i]["kept"] != (host[i] == "good")]
    assert not turned
    # The posteriors by hand, from the evidence.
    hosts, paths = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for i, r in got.items():
        p = float(labels[i] == (1, 0)) if i in labels else 1 / (1 + math.exp(-r["evidence"]))
        for at in (hosts[r["host"]], paths[r["host"], r["path"]]):
            at[0] += 1
            at[1] += p
    mean = sum(g for _, g in hosts.values()) / len(got)
    k_host, k_path = strength(list(hosts.values()), mean), strength(list(paths.values()), mean)
    base = logit(sum(y == (1, 0) for y in labels.values()) / len(labels))
    for r in got.values():
        (n, g), (m, f) = hosts[r["host"]], paths[r["host"], r["path"]]
        h = (g + k_host * mean) / (n + k_host)
        q = (f + k_path * h) / (m + k_path)
        assert (r["host_mean"], r["path_mean"]) == (pytest.approx(h), pytest.approx(q))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(r["evidence"] + logit(q) - base))))


# -------------------------------------------------------------- pipeline


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_lines(rows):
    seen = {}
    for r in rows:
        w = (r["text"] or "").split("\n")
        for p in range(len(w) - 2):
            if WORD.search(" ".join(w[p : p + 3])):
                k = tuple(w[p : p + 3])
                seen[k] = min(seen.get(k, (r["doc_id"], p)), (r["doc_id"], p))
    for r in rows:
        w = (r["text"] or "").split("\n")
        gone = {p + k for p in range(len(w) - 2) if seen.get(tuple(w[p : p + 3]), (r["doc_id"], p)) < (r["doc_id"], p) for k in range(3)}
        text = "\n".join(x for p, x in enumerate(w) if p not in gone)
        if not gone:
            yield r
        elif WORD.search(text):
            yield r | {"text": text, "n_chars": len(text)}


def brute_groups(rows):
    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def brute_mix(rows):
    size = lambda r: len(WORD.findall(r["text"]))
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    words = {s: sum(size(r) for r in rows if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, sum(words.values()), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * words[s] < level * weight[s]}
        for s in full or open_:
            target[s] = 3 * words[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    out = []
    for s in sources:
        o = int(hashlib.md5(f"{mixing.SEED}|{'n' if s is None else 's' + s}".encode()).hexdigest()[:4], 16) / 65536
        rate = target[s] / words[s] if words[s] else 0.0
        for k, r in enumerate(sorted((r for r in rows if r["source"] == s), key=lambda r: (size(r), r["doc_id"]))):
            out += [r] * (math.floor((k + 1) * rate + o) - math.floor(k * rate + o))
    return out


def test_pipeline_against_brute_force(spark, tmp_path, rng):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = []
    for i in range(80):
        lang = rng.choice(["en", "de", "fr"])
        text = sentences(rng, lang, rng.randrange(2, 9))
        if rows and rng.random() < 0.35:  # near copies of one line, and passages of lines
            old = rng.choice(rows)["text"]
            text = old.replace("\n", " ") + " end" if rng.random() < 0.5 else text + "\n" + "\n".join(old.split("\n")[:4])
        rows.append({"doc_id": i, "text": text, "lang": rng.choice([lang, None]), "source": rng.choice(["a", "a", "b", None]), "n_chars": len(text), "score": 7.0, "n_lines": 9})
    rows += [{"doc_id": 100 + i, "text": t, "lang": "en", "source": "b", "n_chars": None, "score": None, "n_lines": None} for i, t in enumerate([None, "", "12 34", "привет это", rows[3]["text"]])]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines long"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "documents.parquet"))
    known = profiles([(r["doc_id"], r["text"], r["lang"]) for r in rows], language_id.TOP)
    now = [r | {"lang": r["lang"] or p} for r in rows for p, s in [out_of_place(r["text"], known, language_id.TOP)] if s > corpus_pipeline.LANGUAGE_FLOOR]
    steps = [now]
    for step in (lambda x: list(brute_lines(x)), brute_groups, brute_mix):
        steps.append(step(steps[-1]))
    assert len({len(s) for s in steps}) >= 3  # each decides something
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, (tuple(r.values()) for r in steps[k])))
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
    library = Tokenizer.from_file(bpe.default_path())
    want = []
    for r in steps[-1]:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], r["lang"], r["source"], len(ids), ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()))) == sorted(map(repr, want))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
