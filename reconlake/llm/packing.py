"""Best-fit packing planned over the histogram of lengths; pieces take planned slots by their rank within their length."""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconlake.llm.bpe import byte_letters
from reconlake.plans.lineage import stored

#: Pieces of one rank bucket, about, and buckets whose counts are summed up together.
RANKED_TOGETHER, BUCKETS_TOGETHER = 256, 1024
#: White space of this length is encoded apart from the text around it.
LONG_SPACE = 10_000

# Fixed value: the pre-tokenization pattern of the vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LONG_SPACE = regex.compile(r"\p{White_Space}{%d,}" % LONG_SPACE)


class _Ids:
    """Ids of whole texts as 32-bit little-endian bytes, from a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        # in such vocabularies ids rise with the merges' ranks, so ids serve as ranks
        ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        encoding = tiktoken.Encoding("packing", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain, self.pretoken = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _part(self, text: str) -> list[int]:
        """Ids of a text without special tokens. Its very long runs of white space, all but the last character where more follows, are
        one pre-token each and are merged as such, since the library's matcher overflows its stack on them."""
        if len(text) < LONG_SPACE:
            return self.plain(text)
        ids, at = [], 0
        for m in _LONG_SPACE.finditer(text):
            end = m.end() - (m.end() < len(text))
            ids += self.plain(text[at : m.start()])
            ids += self.pretoken(m[0][: end - m.start()].encode())
            at = end
        return ids + self.plain(text[at:])

    def of(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            return array("I", self._part(text)).tobytes()
        parts = self.cut.split(text)
        return b"".join(array("I", [self.special[p]] if k % 2 else self._part(p)).tobytes() for k, p in enumerate(parts))


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as pieces of at most `capacity` ids, end_id added to each document.

    Longer documents are cut; their first piece takes the remainder. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = _ids(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = tokens.of(t.as_py() or "") + end
                n = len(raw) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    rows.append((d, piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                    at, piece = at + size, piece + 1
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(histogram: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """Slots for `histogram[length]` pieces of each length: (first rank, first sequence, offset), ranks rising.

    Longest first, each length goes to the fullest open sequences that still hold it. Open sequences are kept as runs of
    consecutive numbers with equal room, so the work depends on lengths and runs, not on how many pieces there are.
    """
    plan: dict[int, list[tuple[int, int, int]]] = {}
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    opened = 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank, slots = histogram[length], 0, plan.setdefault(length, [])
        while left and (k := bisect_left(rooms, length)) < len(rooms):
            room = rooms[k]
            first, n = runs[room].pop()
            if not runs[room]:
                del runs[room], rooms[k]
            used = min(n, left)
            slots.append((rank, first, capacity - room))
            leave(room, first + used, n - used)
            leave(room - length, first, used)
            left, rank = left - used, rank + used
        if left:
            each = capacity // length
            full, over = divmod(left, each)
            for j in range(each):
                n = full + (j < over)
                if n:
                    slots.append((rank, opened, j * length))
                    rank += n
            leave(capacity - each * length, opened, full)
            leave(capacity - over * length, opened + full, bool(over))
            opened += full + bool(over)
    return plan


def ranked(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with rank, from 0 within each value of `by`, in an order that depends on the rows alone.

    Rows are dealt over hash buckets; counts of (value, bucket) are summed up in two levels, within blocks of buckets and
    over the blocks, and rows are numbered within their bucket. A value that many rows have is spread over as many tasks.
    """
    buckets = max(1, -(-rows.count() // RANKED_TOGETHER))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))

    def before(within: list[str], along: str, n: str) -> Column:
        return F.sum(n).over(Window.partitionBy(*within).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n)

    counts = rows.groupBy(by, "_bucket").agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_bucket") / BUCKETS_TOGETHER))
    blocks = counts.groupBy(by, "_block").agg(F.sum("_n").alias("_m"))
    blocks = blocks.select(by, "_block", before([by], "_block", "_m").alias("_first"))
    counts = counts.select(by, "_bucket", "_block", before([by, "_block"], "_bucket", "_n").alias("_before")).join(blocks, [by, "_block"]).drop("_block")
    local = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1
    out = rows.withColumn("_local", local).join(counts, [by, "_bucket"])
    return out.withColumn("rank", F.col("_first") + F.col("_before") + F.col("_local")).drop("_bucket", "_local", "_before", "_first")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece with its place.

    The histogram has `capacity` lengths at most and is planned on the driver. Repeated rows are packed each; an empty table
    gives an empty table; other columns are not read.
    """
    rows = stored(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in best_fit_plan(histogram, capacity).items()}
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                first, start, offset = shared.value[int(x)]
                at = np.flatnonzero(length == x)
                k = np.searchsorted(first, rank[at], "right") - 1
                seq[at], off[at] = start[k] + rank[at] - first[k], offset[k]
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked(rows, "length", ["doc_id", "piece", "start", "ids_crc32"])
    return out.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
