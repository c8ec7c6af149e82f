"""Quotation linking: quoted passages are joined to the messages they come from, and conversations put in reply order."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.plans.lineage import stored

_QUOTED = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
#: Words of the windows by which parts of a message are found.
WINDOW = 5
_SAID = re.compile(r"On .{1,200} wrote:\s*")


def _hash(text: str) -> str | None:
    plain = " ".join(text.lower().split())
    return hashlib.sha256(plain.encode()).hexdigest()[:32] if plain else None


def windows(text: str) -> list[int]:
    """Distinct hashes of the windows of WINDOW words of a normalised text, as signed longs; none if it has fewer words."""
    words = text.lower().split()
    hashes = {xxhash.xxh64_intdigest(" ".join(words[k : k + WINDOW])) for k in range(len(words) - WINDOW + 1)}
    return sorted(h - (1 << 64) if h >> 63 else h for h in hashes)


def _short_runs(lines: list[str]) -> Iterator[str]:
    """Runs of neighbouring lines with under WINDOW words: too short to be found by windows."""
    for k in range(len(lines)):
        n, end = 0, k
        while end < len(lines) and end < k + 2 * WINDOW and (n := n + len(lines[end].split())) < WINDOW:
            end += 1
            yield "\n".join(lines[k:end])


class Parsed(NamedTuple):
    body: str  # the own text without quotes
    passages: list[tuple[int, str]]  # level and quoted text
    parts: set[str]  # hashes by which the own text may be quoted as a whole, by paragraphs, lines or short runs of lines
    segments: list[tuple[int | None, str]]  # the whole text in order: own parts (None) and passages by their number


def parse(text: str | None) -> Parsed:
    """The level of a line is the number of its leading '>'; a passage is a run of lines of one level.

    A line "On ... wrote:" just before a quote goes with it. White space and case don't count; a passage of white space
    alone is part of the own text's segments but no passage.
    """
    runs: list[tuple[int, list[str], list[str]]] = []  # level, lines as they are, lines without marks
    for line in (text or "").split("\n"):
        m = _QUOTED.fullmatch(line)
        level = m[1].count(">") if m else 0
        if not runs or level != runs[-1][0]:
            said = bool(level and runs and not runs[-1][0] and _SAID.fullmatch(runs[-1][1][-1]))
            head = [runs[-1][1].pop()] if said else []
            if said:
                runs[-1][2].pop()
            runs.append((level, head, []))
        runs[-1][1].append(line)
        runs[-1][2].append(m[2] if m else line)
    passages: list[tuple[int, str]] = []
    segments: list[tuple[int | None, str]] = []
    for level, raw, plain in runs:
        quoted = level and _hash("\n".join(plain))
        if raw:
            segments.append((len(passages) if quoted else None, "\n".join(raw)))
        if quoted:
            passages.append((level, "\n".join(plain)))
    own = [line for level, _, plain in runs if not level for line in plain]
    body = "\n".join(own).strip() if any(level for level, _, _ in runs) else (text or "")
    pieces = {body, *re.split(r"\n[ \t]*\n", body), *own, *_short_runs(own)}
    return Parsed(body, passages, {h for p in pieces if (h := _hash(p))}, segments)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a dense number from 0 in the order of these columns. Rows are dealt by ranges; only partitions' counts reach the driver."""
    rows = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33).cast("int")
    counts = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    first, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        first.append(total)
        total += counts.get(k, 0)
    offsets = F.split(F.lit(",".join(map(str, first or [0]))), ",").cast("array<bigint>")
    return rows.withColumn(name, F.get(offsets, part) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def _depths(parents: DataFrame) -> DataFrame:
    """(idx, depth, root) from (idx, parent) by doubling: each round every pointer jumps as far again as it has come."""
    state = stored(parents.select("idx", F.col("parent").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("parent", "idx").alias("root")), "pointers")
    while state.where("to is not null").limit(1).count():
        at = state.select(F.col("idx").alias("a"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("root").alias("up"))
        jumped = state.where("to is not null").join(at, F.col("to") == F.col("a")).select("idx", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.col("up").alias("root"))
        state = stored(jumped.unionByName(state.where("to is null")), "pointers")
    return state.select("idx", "depth", "root")


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, parent_turn, depth, position, n_quotes, n_linked): one row per input row, linked quotes removed.

    A quoted passage comes from the first message of its conversation that has it as its own whole text, paragraph, line or
    short run of lines. One that none has so, of WINDOW words or more, comes from the message in which the last of its word
    windows is first met, if that message holds them all: so partial, re-wrapped and trimmed quotes are found. The source must be earlier. Passages
    without a source stay in the text, as do interpreter prompts. A message
    answers the source of its outermost, first linked passage; without one, the message before it. depth counts answers up to
    the thread's first message; position, from 0, orders a conversation by thread, depth and turn, so that every message
    follows what it answers. Rows with equal conversation and turn are ordered by role and text. Null conversations form
    one conversation, null turns come first, null texts are empty. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quote = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.string()), ("windows", pa.list_(pa.int64()))]))
        segment = pa.list_(pa.struct([("no", pa.int32()), ("text", pa.string())]))
        for b in batches:
            found = [parse(t.as_py()) for t in b.column(b.schema.get_field_index("text"))]
            keep = [b.column(c) for c in ("idx", "conv", "turn", "role")]
            columns = [
                pa.array([f.body for f in found], pa.string()),
                pa.array([[{"no": n, "text": t} for n, t in f.segments] for f in found], segment),
                pa.array([[{"level": n, "hash": _hash(t), "windows": windows(t)} for n, t in f.passages] for f in found], quote),
                pa.array([sorted(f.parts) for f in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*keep, *columns], names=["idx", "conv", "turn", "role", "body", "segments", "quotes", "own"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([windows(t.as_py()) for t in b.column(2)], pa.list_(pa.int64()))], names=["conv", "idx", "ws"])

    rows = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = numbered(rows, ["conv", "turn", "role", "text"], "idx")
    kinds = "idx long, conv long, turn long, role string, body string, segments array<struct<no:int,text:string>>, quotes array<struct<level:int,hash:string,windows:array<bigint>>>, own array<string>"
    rows = stored(rows.select("idx", "conv", "turn", "role", "text").mapInArrow(run, kinds), "messages")

    same = lambda a, b: a["conv"].eqNullSafe(b["conv"])
    source = rows.select("conv", "idx", F.explode("own").alias("hash")).groupBy("conv", "hash").agg(F.min("idx").alias("source"))
    asked = stored(rows.select("conv", "idx", F.posexplode("quotes").alias("no", "q")).select("conv", "idx", "no", "q.*"), "passages")
    met = asked.join(source, same(asked, source) & (asked["hash"] == source["hash"])).where("source < idx").select("idx", "no", "level", "source")
    todo = stored(asked.where(F.size("windows") > 0).join(met, ["idx", "no"], "left_anti"), "unlinked")
    if not todo.isEmpty():
        convs = todo.select("conv").distinct()
        own = rows.join(convs, same(rows, convs), "left_semi").select("conv", "idx", "body").mapInArrow(held, "conv long, idx long, ws array<bigint>")
        own = stored(own.select("conv", "idx", F.explode("ws").alias("w")), "windows")
        first = own.groupBy("conv", "w").agg(F.min("idx").alias("first"))
        sought = todo.select("conv", "idx", "no", "level", F.size("windows").alias("n"), F.explode("windows").alias("w"))
        last = sought.join(first, same(sought, first) & (sought["w"] == first["w"])).groupBy("idx", "no", "level", "n").agg(F.max("first").alias("source"), F.count("*").alias("seen"))
        last = last.where("seen = n and source < idx").select("idx", "no", "level", "n", "source")
        each = last.join(todo.select("idx", "no", F.explode("windows").alias("w")), ["idx", "no"])
        proven = each.join(own.select(F.col("idx").alias("source"), "w"), ["source", "w"]).groupBy("idx", "no", "level", "n", "source").agg(F.count("*").alias("held"))
        met = met.unionByName(proven.where("held = n").select("idx", "no", "level", "source"))
    links = met.groupBy("idx").agg(F.min(F.struct("level", "no", "source"))["source"].alias("linked"), F.count("*").alias("n_linked"), F.collect_set("no").alias("gone"))

    before = rows.select((F.col("idx") + 1).alias("idx"), F.col("conv").alias("conv_before"))
    told = rows.drop("own", "body").join(before, "idx", "left").join(links, "idx", "left")
    last = F.when((F.col("idx") > 0) & F.col("conv").eqNullSafe(F.col("conv_before")), F.col("idx") - 1)
    kept = F.filter("segments", lambda x: ~F.coalesce(F.array_contains("gone", x["no"]), F.lit(False)))
    left = F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    left = F.when(F.col("gone").isNotNull(), F.regexp_replace(left, r"^\s+|\s+$", "")).otherwise(left)
    told = stored(told.withColumns({"parent": F.coalesce("linked", last), "text": left}).drop("segments", "gone"), "linked")
    depths = _depths(told.select("idx", "parent"))
    turns = rows.select(F.col("idx").alias("parent"), F.col("turn").alias("parent_turn"))
    out = told.join(depths, "idx").join(turns, "parent", "left")
    out = numbered(out, ["conv", "root", "depth", "idx"], "at")
    first = out.groupBy(F.col("conv").alias("c")).agg(F.min("at").alias("first"))
    out = out.join(first, F.col("conv").eqNullSafe(F.col("c")))
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", "text", "parent_turn", "depth", (F.col("at") - F.col("first")).alias("position"), F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")
    )
