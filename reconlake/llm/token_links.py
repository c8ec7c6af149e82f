"""Alignment of two tokenizers' tokens over the same bytes, by products of sparse incidence matrices.

A byte-level BPE (A) and a piece vocabulary (B) cut the same bytes. Incidence of tokens and bytes in compressed rows, A and the
transpose of B, multiplied row by row, gives every pair of overlapping tokens with the bytes they share; incidence of tokens and
groups gives those that share a group, a stretch between two places where tokens of both end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.llm.bpe import byte_letters
from reconlake.llm.chunks import ChunkCache, chunks
from reconlake.llm.packing import _Ids
from reconlake.plans.lineage import stored

#: Characters of texts whose parts are looked up together, and parts that a worker remembers.
TOGETHER, REMEMBERED = 2 << 20, 250_000


class Rows(NamedTuple):
    """A sparse matrix in compressed rows: row i has `value` at columns column[start[i]:start[i + 1]]."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    columns: int


def incidence(owner: np.ndarray, owners: int) -> Rows:
    """owners x items of ones, item k in row owner[k]."""
    order = np.argsort(owner, kind="stable")
    start = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=owners)))).astype(np.int64)
    return Rows(start, order, np.ones(len(owner), np.int64), len(owner))


def transposed(m: Rows) -> Rows:
    row = np.repeat(np.arange(len(m.start) - 1), np.diff(m.start))
    order = np.argsort(m.column, kind="stable")
    start = np.concatenate(([0], np.cumsum(np.bincount(m.column, minlength=m.columns)))).astype(np.int64)
    return Rows(start, row[order], m.value[order], len(m.start) - 1)


def product(a: Rows, b: Rows) -> Rows:
    """a b by rows: each entry of a row of a adds its multiple of a row of b; entries of one column are summed up."""
    n = np.diff(b.start)[a.column]
    row = np.repeat(np.repeat(np.arange(len(a.start) - 1), np.diff(a.start)), n)
    at = np.repeat(b.start[a.column] - np.cumsum(n) + n, n) + np.arange(n.sum())
    key, back = np.unique(row * b.columns + b.column[at], return_inverse=True)
    value = np.zeros(len(key), np.int64)
    np.add.at(value, back, np.repeat(a.value, n) * b.value[at])
    row = key // max(b.columns, 1)
    start = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(a.start) - 1)))).astype(np.int64)
    return Rows(start, key % max(b.columns, 1), value, b.columns)


class Alignment(NamedTuple):
    """Two sequences of tokens over the same bytes by where each token ends, and the ends that both have."""

    end_a: np.ndarray
    end_b: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, len_a: np.ndarray, len_b: np.ndarray) -> Alignment:
        end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
        return cls(end_a, end_b, np.intersect1d(end_a, end_b, assume_unique=True))

    def overlaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token of A, token of B, bytes they share) of all overlapping tokens, in order."""
        by_byte = lambda end: incidence(np.repeat(np.arange(len(end)), np.diff(end, prepend=0)), len(end))
        both = product(by_byte(self.end_a), transposed(by_byte(self.end_b)))
        return np.repeat(np.arange(len(self.end_a)), np.diff(both.start)), both.column, both.value

    def end_links(self) -> tuple[np.ndarray, np.ndarray]:
        """Those overlapping tokens that also end together."""
        a, b, _ = self.overlaps()
        same = self.end_a[a] == self.end_b[b]
        return a[same], b[same]

    def members(self) -> tuple[Rows, Rows]:
        """Groups x tokens of A, and of B."""
        return tuple(incidence(np.searchsorted(self.cuts, end), len(self.cuts)) for end in (self.end_a, self.end_b))

    def group_links(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that share a group. Their number can grow with the square of a group; `members` doesn't."""
        a, b = self.members()
        both = product(transposed(a), b)
        return np.repeat(np.arange(len(self.end_a)), np.diff(both.start)), both.column


class Part(NamedTuple):
    """What a part of a text adds: tokens of each kind, groups, id pairs of its links (little-endian 32-bit numbers), and groups as text."""

    n_a: int
    n_b: int
    n_groups: int
    pairs: bytes
    groups: str


class Tokenizers:
    """The two vocabularies, and the numbers of the id pairs that can end together: the bytes of one are a suffix of the other's.

    These pairs follow from the vocabularies, so tables by pair have a fixed size whatever the corpus (about 320,000 pairs for a
    byte vocabulary of 50,000 and a piece vocabulary of 32,000).
    """

    def __init__(self, byte_path: str, piece_path: str):
        self.a = _Ids(byte_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = byte_letters()
        with open(byte_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = {i: bytes(letters[c] for c in s) for s, i in vocabulary.items() if s not in self.a.special}
        self.bytes_b = {i: x for i in range(self.b.vocab_size()) if (x := self._piece(i)) is not None}
        self.size_b = self.b.vocab_size()
        ends = {}
        for k, vocabulary in enumerate((self.bytes_a, self.bytes_b)):
            for i, x in vocabulary.items():
                ends.setdefault(x, ([], []))[k].append(i)
        codes = set()
        for k, vocabulary in enumerate((self.bytes_a, self.bytes_b)):
            for i, x in vocabulary.items():
                for at in range(len(x)):
                    for j in ends.get(x[at:], ((), ()))[1 - k]:
                        codes.add(self.size_b * (j if k else i) + (i if k else j))
        self.pairs = np.array(sorted(codes), np.int64)
        self.len_a, self.len_b = (np.array([len(v.get(i, b"")) for i in range(max(v) + 1)], np.int64) for v in (self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes | None:
        if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i):
            return None
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def parts(self, texts: list[str]) -> list[Part | None]:
        """One for each non-empty text; None where the bytes of one kind's tokens aren't those of a space and the text."""
        ids = [self.a._part(" " + t) for t in texts], self.b.encode(texts, num_threads=1)
        raw = [(" " + t).encode("utf-8", "surrogatepass") for t in texts]
        out: list[Part | None] = [None] * len(texts)
        kept = range(len(texts))
        if not self._same(ids, raw, kept):
            kept = [k for k in kept if self._same(ids, raw, [k])]
            if not kept:
                return out
        # the kept texts follow each other as one sequence of bytes; where one ends, tokens of both kinds end
        all_a, all_b = (np.fromiter(chain.from_iterable(own[k] for k in kept), np.int64) for own in ids)
        both = Alignment.of(self.len_a[all_a], self.len_b[all_b])
        link_a, link_b = both.end_links()
        numbers = np.searchsorted(self.pairs, self.size_b * all_a[link_a] + all_b[link_b]).astype("<i4").tobytes()
        last = np.cumsum([len(raw[k]) for k in kept])
        at_group, at_link = np.searchsorted(both.cuts, last) + 1, 4 * np.searchsorted(both.end_a[link_a], last, "right")
        groups = self._listed(both, all_a, all_b, at_group)
        g = n = 0
        for k, g2, n2, text in zip(kept, at_group.tolist(), at_link.tolist(), groups):
            out[k] = Part(len(ids[0][k]), len(ids[1][k]), g2 - g, numbers[n:n2], text)
            g, n = g2, n2
        return out

    def _same(self, ids: tuple[list, list], raw: list[bytes], some: Sequence[int]) -> bool:
        """True if the tokens of each of some texts give its bytes back, in both kinds."""
        whole = b"".join(raw[k] for k in some)
        for own, known, size in zip(ids, (self.bytes_a, self.bytes_b), (self.len_a, self.len_b)):
            if b"".join(known.get(i, b"") for k in some for i in own[k]) != whole:
                return False
            ends = np.cumsum(size[np.fromiter(chain.from_iterable(own[k] for k in some), np.int64)])
            count = np.cumsum([len(own[k]) for k in some])
            if not np.array_equal(ends[count - 1], np.cumsum([len(raw[k]) for k in some])):
                return False
        return True

    def _listed(self, both: Alignment, all_a: np.ndarray, all_b: np.ndarray, at_group: np.ndarray) -> list[str]:
        """Groups as text for each text; at_group is how many groups there are up to its end. Tokens are read off the rows of groups x tokens."""
        size, at, kind = [], [], []
        for k, m in enumerate(both.members()):
            size.append(np.diff(m.start))
            at.append(m.column)
            kind.append(2 * np.repeat(np.arange(len(both.cuts)), size[k]) + k)
        order = np.argsort(np.concatenate(kind), kind="stable")
        tokens = np.concatenate((all_a[at[0]], all_b[at[1]]))[order]
        after = np.zeros(len(tokens), np.int64)  # a comma, a bar, a semicolon, or the end of a text
        ends = np.cumsum(size[0] + size[1])
        after[ends - size[1] - 1] = 1
        after[ends - 1] = 2
        after[ends[at_group - 1] - 1] = 3
        flat = [""] * (2 * len(tokens))
        flat[::2] = map(str, tokens.tolist())
        flat[1::2] = np.array([",", "|", ";", "\n"], object)[after].tolist()
        return "".join(flat).split("\n")


@lru_cache(maxsize=2)
def _tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(byte_path, piece_path)


@lru_cache(maxsize=2)
def _remembered(byte_path: str, piece_path: str) -> ChunkCache:
    return ChunkCache(lambda part: b"", REMEMBERED)


def _aligned(texts: list[str], byte_path: str, piece_path: str) -> list[Part | None]:
    """Each text's whole alignment. Neither kind has tokens over a lone space and what precedes it, so parts between such spaces
    are aligned on their own, each different one once, and those up to a length are remembered by the worker."""
    tokens, cache = _tokenizers(byte_path, piece_path), _remembered(byte_path, piece_path)
    split = [chunks(t) if t else [] for t in texts]
    found: dict[str, Part | bool] = {}
    for p in {p for parts in split for p in parts}:
        known = cache.new.get(p)
        found[p] = cache.known(p) if known is None else known
    missed = [p for p, x in found.items() if x is None]
    for p, x in zip(missed, tokens.parts(missed) if missed else ()):
        found[p] = cache.keep(p, x or False)
    out = []
    for parts in split:
        got = [found[p] for p in parts]
        if not got or not all(got):
            out.append(None)
            continue
        n_a, n_b, n_groups, pairs, groups = zip(*got)
        out.append(Part(sum(n_a), sum(n_b), sum(n_groups), b"".join(pairs), ";".join(groups)))
    return out


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>"


def alignments(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times): one row per document.

    groups: ids of the tokens in each group as `a1,a2|b1;a3|b2,b3`. pairs: the numbers (see id_pairs) of the id pairs that are linked,
    each once, with how many times. Links are pairs of tokens that end together. Texts that are null or empty, or that one kind's
    tokens don't give back, have zeros, empty lists and ''. Whole texts; repeated rows stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = b.column(0), 0
            texts = b.column(1)
            while at < len(ids):
                some, size, first = [], 0, at
                while at < len(ids) and size < TOGETHER:
                    some.append(texts[at].as_py() or "")
                    size += len(some[-1])
                    at += 1
                cols: list[list] = [[] for _ in range(7)]
                for x in _aligned(some, byte_path, piece_path):
                    x = x or Part(0, 0, 0, b"", "")
                    links = np.frombuffer(x.pairs, "<i4")
                    pairs, times = np.unique(links, return_counts=True)
                    for c, v in zip(cols, (x.n_a, x.n_b, x.n_groups, len(links), x.groups, pairs, times.astype(np.int32))):
                        c.append(v)
                longs = [pa.array(c, pa.int64()) for c in cols[:4]]
                lists = [pa.array(c, pa.list_(pa.int32())) for c in cols[5:]]
                yield pa.RecordBatch.from_arrays([ids.slice(first, at - first), *longs, pa.array(cols[4], pa.string()), *lists], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, ALIGNED)


def id_pairs(spark: SparkSession, byte_path: str, piece_path: str) -> DataFrame:
    """(pair, a_id, b_id): the id pairs that can be linked, by number. As many as the vocabularies give, whatever the corpus."""
    t = _tokenizers(byte_path, piece_path)
    return spark.createDataFrame(pa.table({"pair": pa.array(np.arange(len(t.pairs)), pa.int32()), "a_id": t.pairs // t.size_b, "b_id": t.pairs % t.size_b}))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how many links of all of `rows` (pairs, times) hold each id pair linked. Tasks sum up first; there are as many rows at most
    as id pairs, times tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            pairs, times = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            if len(pairs):
                total = np.concatenate((total, np.zeros(max(0, int(pairs.max()) + 1 - len(total)), np.int64)))
                np.add.at(total, pairs, times.astype(np.int64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["pair", "n"])

    return rows.select("pairs", "times").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def weighed(rows: DataFrame, counts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """rows with n_best, links whose pair's count is the highest of its B id (ties included), and count_sum over all links, instead of pairs and times.

    counts: pair_counts of the whole corpus. A table by id pair is broadcast; its size is fixed by the vocabularies.
    """
    t = _tokenizers(byte_path, piece_path)
    got = counts.toArrow()
    n = np.zeros(len(t.pairs), np.int64)
    n[got["pair"].to_numpy()] = got["n"].to_numpy()
    most = np.zeros(t.size_b, np.int64)
    np.maximum.at(most, t.pairs % t.size_b, n)
    shared = rows.sparkSession.sparkContext.broadcast((n, n == most[t.pairs % t.size_b]))
    rest = [c for c in rows.columns if c not in ("pairs", "times", "n_best", "count_sum")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = shared.value
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = pairs.flatten().to_numpy(zero_copy_only=False)
            size = pairs.value_lengths().to_numpy(zero_copy_only=False)
            end = np.cumsum(size)
            sums = [np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (times * best[numbers], times * n[numbers])]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *[pa.array(s[end] - s[end - size]) for s in sums]], names=[*rest, "n_best", "count_sum"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], "n_best long", "count_sum long"]))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum): one row per document, in two passes over stored links.

    groups_sha256 is '' without tokens. An empty table gives an empty table; rows with a null id stay.
    """
    rows = alignments(docs, byte_path, piece_path, id_col, text_col)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    rows = stored(rows.withColumn("groups_sha256", digest).drop("groups"), "links")
    return weighed(rows, pair_counts(rows), byte_path, piece_path)
