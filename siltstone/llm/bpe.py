"""BPE encoding and decoding, with tree concatenation for long unsplit text.

A text is cut at special tokens, normalised, and cut into pieces by the tokenizer's pattern; pieces
are encoded on their own, so a cache of words serves most of them. A piece longer than
``LEAF`` is encoded as a tree: its leaves are encoded in parallel, by threads of the library where there are many, and
then halves are joined bottom-up. At each join the last k tokens of the left half and the
first k of the right are re-encoded as one string, with k growing twofold, until the
window's first token is the one the left half has there and its last token the one the right half has.
Each pair of neighbours in the joined list is then a pair of some valid encoding; a BPE encoding is
the one list whose neighbours are all such pairs, so the result is exact.

No text is shuffled and nothing is gathered; each Python worker holds the vocabulary and a cache of
at most ``CACHE`` words. The tokenizer's path is a parameter; executors read the file there.

Cases: null text is encoded as empty text: no ids. Empty table: no rows. Repeated rows get a
row each. Code points at which Python's Unicode tables may be newer than the library's are normalised and
split by the library's own components.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, extended, table

LEAF = 128
#: With more leaves than this they are encoded by the library's threads.
MANY = 32
CACHE = 100_000
#: Ids that a task holds before it hands them on.
FLUSH = 500_000
END = "</w>"

#: Fixed value: the splitting pattern of the word-BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below it Python and the library agree on letters, digits, white space and lower case.
AGREED = "Ԁ"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def tree_encode(text: str, inner: Callable[[str], list[str]], outer: Callable[[str], list[str]], leaf: int = LEAF, batch: Callable[[list[str]], list[list[str]]] | None = None) -> list[str]:
    """Tokens of one unsplit piece: ``inner`` encodes what does not reach its end, ``outer`` what does, ``batch`` many inner leaves at once."""
    if len(text) <= leaf:
        return outer(text)
    cuts = [*range(0, len(text), leaf), len(text)]
    leaves = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    parts = batch(leaves[:-1]) if batch and len(leaves) > MANY else [inner(x) for x in leaves[:-1]]
    parts.append(outer(leaves[-1]))
    while len(parts) > 1:
        joined = [join(parts[i], parts[i + 1], inner, outer, i + 2 == len(parts)) for i in range(0, len(parts) - 1, 2)]
        parts = joined + parts[len(joined) * 2 :]
    return parts[0]


def join(left: list[str], right: list[str], inner: Callable, outer: Callable, last: bool) -> list[str]:
    """The encoding of the text of both; ``last``: the right one ends the piece."""
    k = 1
    while True:
        a, b = min(k, len(left)), min(k, len(right))
        ends = last and b == len(right)
        text = "".join(left[-a:]) + "".join(right[:b])
        window = outer(text[: -len(END)]) if ends else inner(text)
        if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
            return left[:-a] + window + right[b:]
        k *= 2


class Codec:
    """Encodes and decodes as the tokenizers library does with the file at ``path``."""

    def __init__(self, path: str, leaf: int = LEAF):
        import regex
        from tokenizers import Tokenizer, models

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        outer = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=END)
        inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.outer = lambda s: [t.value for t in outer.tokenize(s)]
        self.inner = lambda s: [t.value for t in inner.tokenize(s)]
        bare = Tokenizer(inner)
        self.batch = lambda leaves: [e.tokens for e in bare.encode_batch(leaves, add_special_tokens=False)]
        self.leaf, self.ids = leaf, dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids.update(self.special)
        self.tokens = {i: t for t, i in self.ids.items()}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.split = regex.compile(PATTERN).findall
        self.whole = Tokenizer.from_file(path)
        self.chars = _byte_chars()
        self.plain = re.compile(f"[\0-\x1b\x20-{chr(ord(AGREED) - 1)}]*").fullmatch  # str.split() parts at \x1c-\x1f, the library doesn't
        self.words: dict[str, tuple[int, str, str]] = {}

    def piece(self, mapped: str) -> list[str]:
        return tree_encode(mapped, self.inner, self.outer, self.leaf, self.batch)

    def _word(self, word: str) -> tuple[int, str, str]:
        """Count, ids and tokens of a word, which may hold several pieces."""
        found: list[str] = []
        for p in self.split(word):
            found += self.piece(p if p.isascii() and p.isprintable() else "".join([self.chars[b] for b in p.encode()]))
        entry = (len(found), " ".join([str(self.ids[t]) for t in found]), " ".join(found))
        if len(word) <= 64:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = entry
        return entry

    def _segment(self, text: str) -> list[tuple[int, str, str]]:
        if not text:
            return []
        if not self.plain(text):
            pieces = [p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text))]
            tokens = [t for p in pieces for t in self.piece(p)]
            return [(len(tokens), " ".join([str(self.ids[t]) for t in tokens]), " ".join(tokens))] if tokens else []
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Lower case goes by characters in the library: a final sigma is no exception.
        words = text.replace("Σ", "σ").lower().split()
        get = self.words.get
        return [x for w in words if (x := get(w) or self._word(w))[0]]

    def parts(self, text: str | None) -> list[tuple[int, str, str]]:
        """(count, ids, tokens), both joined by blanks, of consecutive parts of a text."""
        text, at, out = text or "", 0, []
        for m in self.at_special.finditer(text):
            out += self._segment(text[at : m.start()])
            out.append((1, str(self.special[m[0]]), m[0]))
            at = m.end()
        return out + self._segment(text[at:])

    def encode_array(self, text: str | None) -> np.ndarray:
        return np.fromstring(" ".join([p[1] for p in self.parts(text)]), np.int32, sep=" ")

    def encode(self, text: str | None) -> list[int]:
        return self.encode_array(text).tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as the library does where a file names no decoder; unknown ids are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, check: bool = False) -> DataFrame:
    """``docs`` with ids (array<int>) and n_tokens; ``check``: and decoded_sha256, the digest of what the ids decode to."""
    path = path or default_path()
    bounded_batches(docs.sparkSession)
    added = ["ids", "n_tokens", *(["decoded_sha256"] if check else [])]
    keep = [c for c in docs.columns if c not in added]
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            start, ids, held, digest = 0, [], 0, []
            for i, text in enumerate(batch.column(at)):
                ids.append(c.encode_array(text.as_py()))
                held += len(ids[-1])
                if check:
                    digest.append(hashlib.sha256(c.decode(ids[-1].tolist()).encode()).hexdigest())
                if held >= FLUSH or i + 1 == len(batch):
                    sizes = [len(x) for x in ids]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(ids)))
                    rows = batch.slice(start, len(ids))
                    more = [lists, pa.array(sizes, pa.int64()), *([pa.array(digest, pa.string())] if check else [])]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*keep, *added])
                    start, ids, held, digest = i + 1, [], 0, []

    return docs.select(*keep).mapInArrow(run, extended(docs.select(*keep).schema, "ids array<int>, n_tokens long" + (", decoded_sha256 string" if check else "")))


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``encoded`` with decoded, a string; null ids are decoded as none."""
    path = path or default_path()
    keep = [c for c in encoded.columns if c != "decoded"]
    at = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(ids.as_py() or []) for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, "decoded"])

    return encoded.select(*keep).mapInArrow(run, extended(encoded.select(*keep).schema, "decoded string"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, without keeping the ids."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1):
                parts = c.parts(text.as_py())
                n.append(sum([p[0] for p in parts]))
                ids.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([p[2] for p in parts]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = extended(docs.select(id_col).schema, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
