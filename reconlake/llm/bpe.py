"""Exact byte-level BPE by dynamic programming over prefixes.

For each prefix of a pre-token the last token of its encoding is unique: among the vocabulary's tokens that end there
(matches of an automaton with suffix links), it is the one that is compatible with the last token of what precedes it.
Back-pointers from the end give the ids.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.llm.chunks import ChunkCache

# Fixed value: the pre-tokenization pattern of the vocabulary, with white space as Unicode defines it.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.ids = ids
        self.bytes = [b""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for b, i in ids.items():
            self.bytes[i] = b
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = map(raw, m if isinstance(m, list) else m.split(" "))
            self.rank[ids[a], ids[b]] = (k, ids[a + b])

        parts = {t: p for p, (_, t) in self.rank.items()}
        self.right, self.left = {}, {}
        for t in ids.values():
            self.right[t], self.left[t] = self._edge(t, parts, 1), self._edge(t, parts, 0)

    def _edge(self, token: int, parts: dict[int, tuple[int, int]], side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one end of `token` while it is merged, each with the rank of the merge that uses it up."""
        out, until = [(token, float("inf"))], float("inf")
        while token in parts:
            until = self.rank[parts[token]][0]
            token = parts[token][side]
            out.append((token, until))
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether bytes of a then b are merged to just these two tokens, both of which merging can reach.

        Up to a first merge across the border both sides go their own ways. A pair across it is merged if its rank is due
        before either part is used up inside its token; between equal ranks the leftmost goes first.
        """
        rank = self.rank
        for x, until_x in self.right[a]:
            for y, until_y in self.left[b]:
                m = rank.get((x, y))
                if m and m[0] < until_x and m[0] <= until_y:
                    return False
        return True

    def spelled(self, b: bytes) -> list[int]:
        """BPE by its definition: the pair of lowest rank, leftmost first, is merged until none is left."""
        ids = [self.ids[b[k : k + 1]] for k in range(len(b))]
        while True:
            due = [(self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
            if not due:
                return ids
            k = min(due)[1]
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]


class Encoder:
    """Encodes and decodes whole texts; one per Python worker."""

    def __init__(self, path: str, most_pairs: int = 400_000):
        self.vocabulary = v = Vocabulary(path)
        self.most_pairs = most_pairs
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}
        for b, i in v.ids.items():
            if v.spelled(b) == [i]:  # tokens that merging can reach
                s = b.decode("latin-1")
                self.whole[s] = i
                self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True)) + ")") if v.special else None
        self.cache = ChunkCache(self._chunk)

    def pretoken(self, s: str) -> list[int]:
        """Ids of one pre-token, its bytes given as Latin-1 letters."""
        one = self.whole.get(s)
        if one is not None:
            return [one]
        n = len(s)
        last, size, pairs = [-1] * (n + 1), [0] * (n + 1), self.pairs
        for at, (length, token) in self.automaton.iter(s):
            end = at + 1
            if last[end] < 0:
                begin = end - length
                if begin:
                    pair = last[begin], token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= self.most_pairs:
                            pairs.clear()
                        fits = pairs[pair] = self.vocabulary.compatible(*pair)
                    if not fits:
                        continue
                last[end], size[end] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def _chunk(self, part: str) -> bytes:
        ids: list[int] = []
        for t in PRETOKEN.findall(part):
            ids += self.pretoken(t if t.isascii() else t.encode().decode("latin-1"))
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; special tokens in it are found first."""
        parts = self.cut.split(text) if self.cut else [text]
        if len(parts) == 1:
            return np.frombuffer(b"".join(self.cache.of(text)), np.int32)
        out: list[bytes] = []
        for k, p in enumerate(parts):
            out += [np.int32(self.vocabulary.special[p]).tobytes()] if k % 2 else self.cache.of(p)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        table = self.vocabulary.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): one row per input row, the whole text encoded and decoded again.

    path: the tokenizer's file, present on every machine. Null and empty texts give no ids. Repeated rows stay repeated;
    other columns are not read. A worker keeps a bounded cache of text parts and of tested pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                ids = [e.encode(t.as_py() or "") for t in some.column(1)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([some.column(0), flat, pa.array([e.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
