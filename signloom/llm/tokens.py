"""Encoding of texts with a public byte-level BPE tokenizer.

Texts are cut into words by the tokenizer's pattern, and words at byte pairs that no vocabulary entry
holds inside: no merge can cross them, so the cut is exact. What remains is merged with a segment
tree over the ranks of adjacent pairs: its root is the leftmost lowest-rank merge, each merge is a few
point updates of logarithmic cost, until no mergeable pair is left. Ids of words and pieces met
before are remembered per worker, within a bound.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the word pattern of the byte-level tokenizers, with white space spelled out.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
REMEMBERED = 1 << 17
LONGEST_REMEMBERED = 96
ROUND_CHARS = 1 << 21


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """The merges of a tokenizer file, and ids of words by them."""

    def __init__(self, file: bytes) -> None:
        model = json.loads(file)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        inside = np.zeros((256, 256), bool)
        for token in vocab:
            raw = np.fromiter((letters.get(c, 0) for c in token), np.uint8, len(token))
            inside[raw[:-1], raw[1:]] = True
        self.cut = ~inside
        self.words: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.byte_ids[b] for b in raw]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        none = (1 << 62, 0, 0)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                tree[width + i] = (m[0], i, m[1])
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, leaf: tuple[int, int, int]) -> None:
            i += width
            tree[i] = leaf
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                tree[i] = a if a <= b else b

        def pair(i: int, j: int) -> tuple[int, int, int]:
            m = merges.get((ids[i], ids[j]))
            return (m[0], i, m[1]) if m else none

        while (best := tree[1]) is not none:
            i, j = best[1], after[best[1]]
            ids[i] = best[2]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                put(j, none)
            if k < n:
                before[k] = i
            put(i, pair(i, k) if k < n else none)
            if before[i] >= 0:
                put(before[i], pair(before[i], i))
        return [x for x in ids if x >= 0]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct words, cut into pieces all at once."""
        if not words:
            return {}
        raws = [w.encode() for w in words]
        blob = b"".join(raws)
        data = np.frombuffer(blob, np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        border = np.zeros(len(data) + 1, bool)
        border[1:-1] = self.cut[data[:-1], data[1:]]
        border[ends] = True
        stops = np.flatnonzero(border)
        cuts = [0, *stops.tolist()]
        pieces, known = [blob[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], self.pieces
        for p in set(pieces).difference(known):
            known[p] = np.array(self.merge(p), np.int32).tobytes()
        packed = list(map(known.__getitem__, pieces))
        upto = (np.searchsorted(stops, ends) + 1).tolist()
        found = {w: b"".join(packed[a:b]) for w, a, b in zip(words, [0, *upto], upto, strict=False)}
        if len(known) > REMEMBERED:
            known.clear()
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; of null and empty texts none."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and size < ROUND_CHARS:
                split.append(WORDS.findall(texts[at]) if texts[at] else [])
                size += len(texts[at] or "")
                at += 1
            met = set(chain.from_iterable(split))
            if len(self.words) > REMEMBERED:
                self.words.clear()
            learnt = self.learn(list(met.difference(self.words)))
            ids = {w: self.words[w] if w in self.words else learnt[w] for w in met}
            self.words.update((w, i) for w, i in learnt.items() if len(w) <= LONGEST_REMEMBERED)
            get = ids.__getitem__
            out.extend(b"".join(map(get, words)) for words in split)
        return out


_bpes: dict[str, Bpe] = {}


def _encoder(df: DataFrame, tokenizer_path: str):
    """A function, for workers, from texts to packed ids; the file travels as a broadcast of fixed size."""
    with open(tokenizer_path, "rb") as f:
        file = f.read()
    shared, name = df.sparkSession.sparkContext.broadcast(file), hashlib.sha256(file).hexdigest()

    def encode(texts: list[str | None]) -> list[bytes]:
        if name not in _bpes:
            _bpes.clear()
            _bpes[name] = Bpe(shared.value)
        return _bpes[name].encode(texts)

    return encode


def encode_texts(df: DataFrame, key: str, text: str, tokenizer_path: str) -> DataFrame:
    """Rows ``key, ids``: the token ids of every row, without special tokens.

    Null and empty texts give an empty list; blank text is encoded as it stands; strings that look like
    special tokens are ordinary text. Rows come out as often as they came in, null keys included; other
    columns are not read.
    """
    encode = _encoder(df, tokenizer_path)
    schema = df.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                packed = encode(batch.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str, text: str, tokenizer_path: str, out: str = "tokens") -> DataFrame:
    """Rows ``key, tokens``: the number of tokens of every row; 0 for null and empty texts."""
    encode = _encoder(df, tokenizer_path)
    schema = df.select(key).schema.add(out, T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                counts = [len(p) // 4 for p in encode(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=[key, out])

    return df.select(key, text).mapInArrow(run, schema)
