"""Exact removal of repeated byte strings, by column-wise construction over segments that hold all repeats.

1. Every string of `length` bytes has an anchor: its leftmost window of `anchor` bytes with the least hash. Strings in a row
   with one anchor form a segment, so equal strings lie in segments of equal anchor, at the same distance from it.
2. Segments of equal content (128-bit BLAKE2 of their bytes) are one text to the construction; met twice they are repeats in full.
3. Different segments of one anchor are aligned at it and built column by column from the right: each round inserts one
   symbol of every segment, which gives the round's column of the collection's Burrows-Wheeler transform (the symbols to the
   left of the sorted suffixes) and the common prefixes of neighbours. Both go to a table in the shared folder, a row a round.
4. The table is passed through once more in the order of rounds: sorting a column stably maps each suffix to its place in the
   next round, so the transform alone tells which segments the neighbours with `length` common symbols belong to.
5. Groups of more than AT_ONCE segments (a passage in many places) are parted by longer anchors first: strings that reach
   far to the left of their anchor, and those that reach far to the right, until groups are small or single strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.plans.lineage import stored

ANCHOR = 128
#: Segments of one group that are built together, at most, and segments in one construction, about.
AT_ONCE, TOGETHER = 1024, 8192
#: Bytes hashed at a time; positions take the low bits of an anchor's sort key. Texts held at a time by a task. Columns made at a time.
BUFFER_BITS, ROWS, COLUMNS = 17, 64, 64

_BUFFER = 1 << BUFFER_BITS
_LOW = np.uint64(_BUFFER - 1)
_END = 256


def _digest(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=16).digest()


def _text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, since a batch of texts is large."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


class _Hashes:
    """Polynomial hashes modulo 2^64 of any stretch of a buffer, over random values of the bytes. They only choose anchors; nothing is equal by them."""

    #: odd multiplier; fixed so that every worker hashes alike
    base = 0x9E3779B97F4A7C15
    made = None

    def __init__(self):
        self.values = np.random.default_rng(20).integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = _powers(self.base, _BUFFER + 1), _powers(pow(self.base, -1, 1 << 64), _BUFFER + 1)

    @classmethod
    def get(cls) -> _Hashes:
        if cls.made is None:
            cls.made = cls()
        return cls.made

    def windows(self, buf: np.ndarray, n: int) -> np.ndarray:
        """The hash of each n bytes in a row."""
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.values[buf] * self.up[: len(buf)], out=sums[1:])
        return (sums[n:] - sums[:-n]) * self.down[: len(buf) - n + 1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from running minima of blocks."""
    n = len(x) - w + 1
    blocks = np.concatenate((x, np.full(-len(x) % w, np.uint64(2**64 - 1)))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(buf: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> dict[str, np.ndarray]:
    """Segments of texts that lie one after another in buf: text, start (in buf), strings, before (the anchor), anchor."""
    n = len(buf)
    k = n - length + 1
    if k <= 0:
        return {}
    keys = _mix(_Hashes.get().windows(buf, anchor))
    at = np.arange(len(keys))
    where = (_least((keys & ~_LOW) | at.astype(np.uint64), length - anchor + 1) & _LOW).astype(np.int64)
    at = at[:k]
    text = np.searchsorted(ends, at, "right")
    inside = at + length <= ends[text]
    new = np.ones(k, bool)
    new[1:] = (where[1:] != where[:-1]) | (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], k)
    s, e = s[inside[s]], e[inside[s]]
    return {"text": text[s], "start": s, "strings": e - s, "before": where[s] - s, "anchor": keys[where[s]].view(np.int64)}


def _buffers(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts (index, offset in the text, bytes) gathered into buffers; longer ones are cut, with length - 1 bytes repeated."""
    idx, off, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at >= length:
            room = _BUFFER - size
            if room < min(len(t) - at, _BUFFER // 2):
                yield idx, off, parts
                idx, off, parts, size = [], [], [], 0
                continue
            p = t[at : at + room]
            idx, off, parts, size = [*idx, i], [*off, at], [*parts, p], size + len(p)
            if at + len(p) == len(t):
                break
            at += len(p) - length + 1
    if parts:
        yield idx, off, parts


def occurrences(docs: DataFrame, text_col: str, length: int, anchor: int) -> DataFrame:
    """(key, start, strings, before, anchor, content): a row per segment of every text; key stands for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "start", "strings", "before", "anchor", "content"]
        for b in _slices(batches):
            texts = [t.as_py() for t in b.column(0).cast(pa.binary())]
            keys = [hashlib.sha256(t).digest()[:16] for t in texts]
            for idx, off, parts in _buffers(texts, length):
                raw = b"".join(parts)
                ends = np.cumsum([len(p) for p in parts])
                found = segments(np.frombuffer(raw, np.uint8), ends, length, anchor)
                if not found or not len(found["text"]):
                    continue
                begin = np.concatenate(([0], ends[:-1]))
                t = np.array(idx)[found["text"]]
                start = found["start"] - begin[found["text"]] + np.array(off)[found["text"]]
                content = [_digest(raw[x:y]) for x, y in zip(found["start"].tolist(), (found["start"] + found["strings"] - 1 + length).tolist())]
                cols = [pa.array([keys[i] for i in t.tolist()], pa.binary()), start, found["strings"].astype(np.int32), found["before"].astype(np.int32), found["anchor"], pa.array(content, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    slim = docs.select(F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= length)
    return slim.mapInArrow(run, "key binary, start long, strings int, before int, anchor long, content binary")


def symbols(rows: list[bytes], before: np.ndarray) -> Iterator[np.ndarray]:
    """Columns of the segments aligned at their anchors, from the rightmost one; a few are made at a time. _END: begins later or has ended."""
    left = int(before.max())
    width = max(len(r) - int(x) for r, x in zip(rows, before)) + left
    for high in range(width, 0, -COLUMNS):
        low = max(0, high - COLUMNS)
        table = np.full((high - low, len(rows)), _END, np.uint16)
        for i, r in enumerate(rows):
            shift = left - int(before[i])
            a, e = max(low, shift), min(high, shift + len(r))
            if a < e:
                table[a - low : e - low, i] = np.frombuffer(r, np.uint8)[a - shift : e - shift]
        yield from table[::-1]


def construct(columns: Iterator[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Round by round the transform's column and the common prefixes of the suffixes it leads to.

    The column holds the new symbols in the order of the suffixes that they precede. Sorted stably, they give the order of the
    longer suffixes; the common prefix of two neighbours with equal symbols is one more than the least between them in
    the round before. An end mark equals nothing. Prefixes over `length` count as `length`.
    """
    order = prefix = None
    for now in columns:
        if order is None:
            order, prefix = np.arange(len(now)), np.zeros(len(now), np.int32)
        column = now[order]
        turn = np.argsort(column, kind="stable")
        ranked = column[turn]
        same = np.flatnonzero((ranked[1:] == ranked[:-1]) & (ranked[1:] != _END)) + 1
        common = np.zeros(len(now), np.int32)
        if len(same):
            between = np.stack((turn[same - 1] + 1, turn[same] + 1), axis=1).ravel()
            common[same] = np.minimum.reduceat(np.append(prefix, 0), between)[::2] + 1
        order, prefix = order[turn], np.minimum(common, length)
        yield column, prefix


def replay(rounds: Iterator[tuple[np.ndarray, np.ndarray]], strings: np.ndarray, before: np.ndarray, width: int, length: int) -> list[np.ndarray]:
    """For each segment, which of its strings another segment holds at the same place; read off the transform and the prefixes."""
    found = [np.zeros(k, bool) for k in strings]
    left = int(before.max())
    order = np.arange(len(strings))
    for j, (column, prefix) in zip(range(width - 1, -1, -1), rounds):
        order = order[np.argsort(column, kind="stable")]
        long = prefix >= length
        if long.any():
            long[:-1] |= long[1:]
            for i in order[long]:
                found[i][j - left + before[i]] = True
    return found


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _packed(docs: DataFrame, text_col: str, keep: list[tuple[Column, str]]) -> DataFrame:
    """docs' text compressed, with its key, so that less is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for b in _slices(batches):
            z = pa.array([c.compress(t.as_py()) if t.is_valid else None for t in b.column(b.num_columns - 1).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], z], names=[*b.schema.names[:-1], "z"])

    text = F.col(text_col).cast("string")
    slim = docs.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(keep)], _text_key(text).alias("key"), text.alias("text"))
    fields = [f"k{i} {kind}" for i, (_, kind) in enumerate(keep)]
    return slim.mapInArrow(run, ", ".join([*fields, "key binary", "z binary"]))


_PART = "group long, anchor long, content binary, skipped int, strings int, before int, bytes binary, low int, high int"
_INT = pa.int32()
_PARTS = pa.schema([("group", pa.int64()), ("anchor", pa.int64()), ("content", pa.binary()), ("skipped", _INT), ("strings", _INT), ("before", _INT), ("bytes", pa.binary()), ("low", _INT), ("high", _INT)])


def _with_text(docs: DataFrame, text_col: str, wanted: DataFrame, length: int, anchor: int) -> DataFrame:
    """Wanted segments with their bytes, cut from the texts they were seen in, as parts: the group is the anchor, no string is skipped.

    Members of a group share the bytes from low to high, counted from the anchor: at first the anchor alone.
    """
    texts = _packed(docs.where(F.octet_length(F.col(text_col).cast("string")) >= length), text_col, [])
    listed = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "strings", "before", "anchor", "content", "n")).alias("want"))
    pairs = texts.groupBy("key").agg(F.first("z").alias("z")).join(listed, "key").select("z", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in _slices(batches):
            for z, want in zip(b.column(0), b.column(1)):
                text, want = d.decompress(z.as_py()), want.as_py()
                rows = [{"group": x["anchor"], "anchor": x["anchor"], "content": x["content"], "skipped": 0, "strings": x["strings"], "before": x["before"], "bytes": text[x["start"] : x["start"] + x["strings"] - 1 + length], "low": 0, "high": anchor, "n": x["n"]} for x in want]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*_PARTS, ("n", pa.int64())]))

    return pairs.mapInArrow(run, _PART + ", n long")


def _parted(parts: DataFrame, length: int) -> DataFrame:
    """Parts regrouped by longer anchors.

    Of the strings that hold [low, high), half start far enough to the left to hold `reach` bytes more there; the others hold
    as many more to the right. A part takes its strings of either kind along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            out = []
            for x in b.to_pylist():
                low, high, before = x["low"], x["high"], x["before"]
                slack = length - (high - low)
                reach = -(-slack // 2)
                for a, e, first, last in ((low - reach, high, high - length, low - reach), (low, high + slack - reach + 1, low - reach + 1, low)):
                    # string j starts at j - before
                    j, k = max(0, first + before), min(x["strings"], last + before + 1)
                    if j < k:
                        group = _digest(x["anchor"].to_bytes(8, "little", signed=True) + a.to_bytes(4, "little", signed=True) + x["bytes"][a + before : e + before])
                        out.append(x | {"group": int.from_bytes(group[:8], "little", signed=True), "skipped": x["skipped"] + j, "strings": k - j, "before": before - j, "bytes": x["bytes"][j : k - 1 + length], "low": a, "high": e})
            yield pa.RecordBatch.from_pylist(out, schema=_PARTS)

    return parts.mapInArrow(run, _PART)


def _grouped(parts: DataFrame, length: int, at_once: int) -> tuple[DataFrame, DataFrame | None]:
    """Parts (with n, their group's size) in groups of at_once at most; and (anchor, content, lo, hi) of single strings that more parts share, if there are any.

    Each round halves the strings of too large groups and lengthens the bytes that their members share, so that after about
    log2(length) rounds a group is one string.
    """
    small = single = None
    while True:
        few = parts.where(F.col("n") <= at_once).drop("n")
        small = few if small is None else small.unionByName(few)
        large = parts.where(F.col("n") > at_once).drop("n")
        if not large.limit(1).count():
            return small, single
        ended = large.where(F.col("high") - F.col("low") == length)
        same = stored(ended.groupBy("bytes").agg(F.count("*").alias("n")).where("n > 1").select("bytes"), "strings")
        same = ended.join(same, "bytes").select("anchor", "content", F.col("skipped").alias("lo"), (F.col("skipped") + 1).alias("hi"))
        single = same if single is None else single.unionByName(same)
        parts = stored(_parted(large.where(F.col("high") - F.col("low") < length), length), "parted")
        n = parts.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
        parts = stored(parts.join(n, "group"), "grouped")


def _constructed(parts: DataFrame, length: int) -> DataFrame:
    """(anchor, content, lo, hi): ranges of strings that different segments of one group share.

    First pass: the transform and the prefixes of many groups at once, a row a round, to a table in the shared folder. Second
    pass: that table in the order of rounds.
    """
    kind = np.dtype("<i2" if length < 1 << 15 else "<i4")
    schema = "batch binary, round int, transform binary, prefix binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def rounds() -> Iterator[pa.RecordBatch]:
            before = np.array([x["before"] for x in held], np.int32)
            head = pa.RecordBatch.from_pylist([{c: x[c] for c in ("anchor", "content", "skipped", "strings", "before")} for x in held])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as w:
                w.write_batch(head)
            raw = sink.getvalue().to_pybytes()
            batch = _digest(raw)
            out = [(batch, -1, raw, b"")]
            for n, (column, prefix) in enumerate(construct(symbols([x["bytes"] for x in held], before), length)):
                out.append((batch, n, column.astype("<u2").tobytes(), prefix.astype(kind).tobytes()))
                if len(out) == COLUMNS:
                    yield made(out)
                    out = []
            yield made(out)

        def made(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.binary(), pa.binary()))], names=["batch", "round", "transform", "prefix"])

        for b in _slices(batches):
            for x in b.to_pylist():
                if len(held) >= TOGETHER and x["group"] != held[-1]["group"]:
                    yield from rounds()
                    held = []
                held.append(x)
        if held:
            yield from rounds()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r[0].as_py(), r[1].as_py(), r[2].as_py(), r[3].as_py()) for b in batches for r in zip(*b.columns))
        row = next(rows, None)
        while row is not None:
            batch = row[0]
            head = pa.ipc.open_stream(row[2]).read_all()
            strings, before, skipped = (head.column(c).to_numpy() for c in ("strings", "before", "skipped"))
            width = int((strings - before).max()) - 1 + length + int(before.max())
            held: list[tuple] = []

            def rounds() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for r in rows:
                    if r[0] != batch:
                        held.append(r)
                        return
                    yield np.frombuffer(r[2], "<u2"), np.frombuffer(r[3], kind)

            walk = rounds()
            flags = replay(walk, strings, before, width, length)
            for _ in walk:
                raise ValueError("more rounds than columns")
            row = held[0] if held else None
            found = [(i, a, e) for i, f in enumerate(flags) for a, e in _ranges(f)]
            if found:
                i, a, e = map(np.array, zip(*found))
                yield pa.RecordBatch.from_arrays([head.column("anchor").combine_chunks().take(pa.array(i)), head.column("content").combine_chunks().take(pa.array(i)), pa.array((a + skipped[i]).astype(np.int32)), pa.array((e + skipped[i]).astype(np.int32))], names=["anchor", "content", "lo", "hi"])

    columns = stored(parts.repartition("group").sortWithinPartitions("group").mapInArrow(first, schema), "transform")
    ordered = columns.repartition("batch").sortWithinPartitions("batch", "round")
    return ordered.mapInArrow(second, "anchor long, content binary, lo int, hi int")


def _together(ranges: Column) -> Column:
    """Sorted ranges (lo, hi) of strings, those that overlap or touch as one."""
    last = lambda out: F.element_at(out, -1)
    one = lambda lo, hi: F.array(F.struct(lo.alias("lo"), hi.alias("hi")))
    add = lambda out, r: F.when(r["lo"] <= last(out)["hi"], F.concat(F.slice(out, 1, F.size(out) - 1), one(last(out)["lo"], F.greatest(last(out)["hi"], r["hi"])))).otherwise(F.concat(out, F.array(r)))
    return F.aggregate(ranges, F.slice(ranges, 1, 1), add)


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 400, anchor: int = ANCHOR, at_once: int = AT_ONCE) -> DataFrame:
    """(key, spans): for each distinct text with repeats, the merged-to-be byte ranges of strings that start elsewhere too."""
    seen = stored(occurrences(docs, text_col, length, anchor), "segments")
    # counts are stored first: a join of plain tables can be split where an anchor is in a large share of the texts
    often = stored(seen.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    seen = stored(seen.join(often, "anchor"), "segments-often")
    one = F.min(F.struct("key", "start")).alias("at")
    classes = stored(seen.groupBy("anchor", "content", "strings", "before").agg(F.count("*").alias("n"), one), "classes")
    per = stored(classes.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    mixed = classes.drop("n").join(per, "anchor").select("anchor", "content", "strings", "before", "at.*", F.col("kinds").alias("n"))
    small, single = _grouped(stored(_with_text(docs, text_col, mixed, length, anchor), "parts"), length, at_once)
    shared = _constructed(small, length)
    if single is not None:
        shared = shared.unionByName(single)
    whole = classes.where("n > 1").select("anchor", "content", F.lit(0).alias("lo"), F.col("strings").alias("hi"))
    found = stored(whole.unionByName(shared), "repeats")
    # a row a segment, whatever the number of its ranges, which is that of its strings at most
    found = found.groupBy("anchor", "content").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))
    found = found.select("anchor", "content", _together(F.col("ranges")).alias("ranges"))
    rows = seen.join(found, ["anchor", "content"])
    spans = F.transform("ranges", lambda r: F.struct((F.col("start") + r["lo"]).alias("a"), (F.col("start") + r["hi"] - 1 + length).alias("b")))
    return rows.select("key", spans.alias("spans")).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def merged(spans: list[dict]) -> list[list[int]]:
    """Overlapping and touching ranges as one; spans are sorted."""
    out: list[list[int]] = []
    for s in spans:
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, anchor: int = ANCHOR, at_once: int = AT_ONCE, keep: tuple[str, ...] = (), as_text: bool = False, min_words: int = 0, long: int = 0
) -> DataFrame:
    """(id, *keep, n_bytes, spans array<struct<a,b>>, kept binary): one row per input row.

    spans are the maximal removed byte ranges, kept the bytes that are left. Strings are judged on the input, and one that
    starts in two places is removed in both, overlaps and repeated rows included. min_words: only ranges with that many
    words (between ASCII white space), or of `long` bytes, are removed. as_text: kept is a string; of a character that was
    removed in part, the rest goes too. Null texts count as empty; texts shorter than `length` keep everything. An empty
    table gives an empty table. Columns that aren't named are not read, so they may have any name.
    """
    spans = repeated_spans(docs, text_col, length, anchor, at_once)
    kinds = dict(docs.dtypes)
    names = [id_col, *keep]
    rows = _packed(docs, text_col, [(F.col(c), kinds[c]) for c in names])
    rows = rows.join(spans, "key", "left").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in _slices(batches):
            out = []
            for z, found in zip(b.column("z"), b.column("spans")):
                text = d.decompress(z.as_py()) if z.is_valid else b""
                ranges = [m for m in merged(found.as_py() or []) if not min_words or m[1] - m[0] >= long > 0 or len(text[m[0] : m[1]].split()) >= min_words]
                cuts = [0, *(x for m in ranges for x in m), len(text)]
                out.append((len(text), [{"a": a, "b": e} for a, e in ranges], b"".join(text[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2))))
            n, s, kept = list(zip(*out)) or [()] * 3
            spans_of = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            left = pa.array([x.decode(errors="ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(f"k{i}") for i in range(len(names))], pa.array(n, pa.int64()), pa.array(s, spans_of), left], names=[*[f"k{i}" for i in range(len(names))], "n_bytes", "spans", "kept"])

    fields = [f"k{i} {kinds[c]}" for i, c in enumerate(names)]
    done = rows.mapInArrow(run, ", ".join([*fields, "n_bytes long", "spans array<struct<a:long,b:long>>", "kept string" if as_text else "kept binary"]))
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "n_bytes", "spans", "kept")
