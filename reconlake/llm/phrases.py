"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

Stripes of one prefix are merged element by element. Merged, one structure gives the extensions of a prefix (its entries), the
prefix's own count (their sum, with an entry for whatever is no frequent extension) and how much of it its extensions take up
(their largest entry).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconlake.plans.lineage import stored

#: Bytes of texts of one language whose stripes a task merges before it hands them on; a longer text is taken on its own.
BLOCK = 12 << 20
#: Bits (as a power of two) of the filter of frequent phrases that tasks share: 8 MB whatever the corpus.
FILTER_BITS = 26
#: A prefix with at least this part of its language's words has its stripe cut into SEGMENTS by the next word.
#: There are at most HEAVY such prefixes a language, so they are shared with the tasks.
HEAVY, SEGMENTS = 1000, 1024
#: Most languages, for what is shared by language.
LANGUAGES = 4096
#: Ways that the first rows of a language are chosen among at a time.
FAN = 8

_REST = ""  # the entry of a stripe for ends of pieces and for words that make no frequent phrase; no word is empty
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 0x2E if c in b".,;:!?" or 10 <= c <= 13 else 0x20 if c == 9 else c for c in range(256))
_STRIPES = "lang string, prefix string, segment int, word string, n string"  # words that follow, and how often, each joined by spaces


def _words(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of lower-cased texts, and for each word in order its number; -1 stands between pieces and at the end."""
    b = np.frombuffer(raw.translate(_LOWER) + b".", np.uint8)
    cut = b == 0x2E
    solid = b != 0x20
    start = solid & (cut | np.concatenate(([True], (cut | ~solid)[:-1])))
    at = np.flatnonzero(start[solid]).astype(np.int32)
    offsets = np.append(at, np.int32(np.count_nonzero(solid))).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(b[solid])]).dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    mark = ids[-1]  # the cut at the end, which is in the dictionary as a word
    ids = np.where(ids == mark, -1, ids - (ids > mark))
    keep = pa.array(np.flatnonzero(np.arange(len(words)) != mark))
    return words.take(keep).cast(pa.string()), ids


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(words: Sequence[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64)


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word at the end."""
    return _mixed(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """Hashes of phrases of equally many words each."""
    h = _hashes(langs)
    for words in zip(*[p.split(" ") for p in phrases]):
        h = _longer(h, _hashes(words))
    return h


class _Filter:
    """A set of phrase hashes as bits; it may hold some that were never added, but lacks none that were."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(h), bool)
        at = h & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _block_stripes(lang: str, raw: bytes, size: int, frequent: _Filter, heavy: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
    """Stripes of prefixes of size - 1 words over texts of one language, merged.

    Only prefixes that may be frequent have one. A following word has an entry of its own if the phrase without its first word may
    be frequent, since else the whole cannot be.
    """
    words, ids = _words(raw)
    if not len(words):
        return
    hashes = _hashes(words.to_pylist())
    if size == 1:  # the stripe of the empty prefix, in segments by word
        n = np.bincount(ids[ids >= 0], minlength=len(words))
        prefix_of, prefixes, after = np.zeros(len(words), np.int64), pa.array([""]), np.arange(len(words))
        segment = (hashes % np.uint64(segments)).astype(np.int64)
    else:
        last = len(ids) - size + 1
        at = np.flatnonzero(np.all([ids[k : last + k] >= 0 for k in range(size - 1)], axis=0))
        head = np.full(len(at), _hashes([lang])[0])
        for k in range(size - 1):
            head = _longer(head, hashes[ids[at + k]])
        may = frequent.has(head)
        at, head = at[may], head[may]
        if not len(at):
            return
        after, tail = ids[at + size - 1], np.full(len(at), _hashes([lang])[0])
        for k in range(1, size):
            tail = _longer(tail, hashes[ids[at + k]])  # of no meaning, and not used, where a piece ends
        after = np.where((after >= 0) & frequent.has(tail), after, -1)
        key = ids[at]
        for k in range(1, size - 1):
            key = np.unique(key * len(words) + ids[at + k], return_inverse=True)[1]
        _, some, key = np.unique(key, return_index=True, return_inverse=True)
        parts = [words.take(pa.array(ids[at[some] + k])) for k in range(size - 1)]
        prefixes = parts[0] if size == 2 else pc.binary_join_element_wise(*parts, " ")
        code, n = np.unique(key * (len(words) + 1) + after + 1, return_counts=True)
        prefix_of, after = code // (len(words) + 1), code % (len(words) + 1) - 1
        spread = np.isin(head[some], heavy)[prefix_of] & (after >= 0)
        segment = np.where(spread, (hashes[after] % np.uint64(segments)).astype(np.int64), 0)
    order = np.lexsort((after, segment, prefix_of))
    prefix_of, segment, after, n = prefix_of[order], segment[order], after[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(prefix_of) != 0) | (np.diff(segment) != 0))))
    known = pa.concat_arrays([words, pa.array([_REST])])
    nexts = known.take(pa.array(np.where(after < 0, len(words), after)))
    offsets = pa.array(np.append(new, len(after)).astype(np.int32))
    columns = [pa.array([lang] * len(new), pa.string()), prefixes.take(pa.array(prefix_of[new])), pa.array(segment[new], pa.int32())]
    columns += [pc.binary_join(pa.ListArray.from_arrays(offsets, x), " ") for x in (nexts, pa.array(n).cast(pa.string()))]
    whole_batch = pa.RecordBatch.from_arrays(columns, names=["lang", "prefix", "segment", "word", "n"])
    for k in range(0, len(new), 20_000):
        yield whole_batch.slice(k, 20_000)


def _stripes(docs: DataFrame, size: int, frequent, heavy) -> DataFrame:
    """Stripes of the prefixes of size - 1 words in (lang, text), merged within tasks, a block of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, heavy_by = _Filter(frequent.value if frequent else None), heavy.value if heavy else {}
        held: dict[str, list[bytes]] = {}
        bytes_held: dict[str, int] = {}

        def handed_on(lang: str) -> Iterator[pa.RecordBatch]:
            bytes_held.pop(lang)
            return _block_stripes(lang, b".".join(held.pop(lang)), size, found, heavy_by.get(lang, np.zeros(0, np.uint64)), SEGMENTS)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                raw = text.as_py()
                held.setdefault(lang, []).append(raw)
                bytes_held[lang] = bytes_held.get(lang, 0) + len(raw) + 1
                if sum(bytes_held.values()) > BLOCK:
                    yield from handed_on(max(bytes_held, key=bytes_held.get))
        for lang in list(held):
            yield from handed_on(lang)

    return docs.mapInArrow(run, _STRIPES)


def _merged(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, word, n): stripes merged element by element; words that follow less than `least` times go to the rest entry.

    Stripes are shuffled whole, by prefix and segment; both sums keep that partitioning.
    """
    by = ["lang", "prefix", "segment"]
    entries = stripes.repartition(*by).select(*by, F.inline(F.arrays_zip(F.split("word", " ").alias("word"), F.split("n", " ").alias("n")))).withColumn("n", F.col("n").cast("long"))
    counts = entries.groupBy(*by, "word").agg(F.sum("n").alias("n"))
    folded = counts.withColumn("word", F.when(F.col("n") >= least, F.col("word")).otherwise(F.lit(_REST)))
    return folded.groupBy(*by, "word").agg(F.sum("n").alias("n")).drop("segment")


def _bits(phrases: DataFrame) -> np.ndarray:
    """The filter of (lang, phrase), made where the rows are; at most 2**(FILTER_BITS - 6) numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _phrase_hashes(b.column(0).to_pylist(), b.column(1).to_pylist()) & np.uint64((1 << FILTER_BITS) - 1)
            bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["place", "bits"])

    got = phrases.select("lang", "phrase").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[got["place"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bits


def stripes(docs: DataFrame, max_words: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> list[DataFrame]:
    """For each size from 1 to max_words, (lang, prefix, word, n): how often `word` follows the prefix of size - 1 words within a piece.

    Words that follow less than `least` times, and ends of pieces, are summed up under ''. Every phrase of fewer than max_words words
    that occurs `least` times is a prefix; the entries of a prefix sum up to its count. All documents are read once for each size.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    out: list[DataFrame] = []
    frequent = heavy = total = None
    for size in range(1, max_words + 1):
        out.append(stored(_merged(_stripes(slim, size, frequent, heavy), least), f"stripes{size}"))
        if size == max_words:
            break
        phrases = _entries(out[-1]).select("lang", "phrase", "n")
        if total is None:
            total = out[0].groupBy("lang").agg(F.sum("n").alias("total"))
            if total.count() > LANGUAGES:
                raise ValueError(f"phrases are counted for up to {LANGUAGES} languages")
        large = phrases.join(total, "lang").where(F.col("n") * HEAVY >= F.col("total")).select("lang", "phrase").toArrow()  # at most HEAVY a language
        langs, h = np.array(large["lang"].to_pylist()), _phrase_hashes(large["lang"].to_pylist(), large["phrase"].to_pylist())
        heavy = spark.sparkContext.broadcast({k: h[langs == k] for k in set(langs.tolist())})
        frequent = spark.sparkContext.broadcast(_bits(phrases))
    return out


def _entries(merged: DataFrame) -> DataFrame:
    """merged without the rest, with the whole phrase."""
    phrase = F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word"))
    return merged.where(F.col("word") != _REST).withColumn("phrase", phrase)


def _first(rows: DataFrame, by: str, order: list, most: int, spread: str) -> DataFrame:
    """The first `most` rows of each value of `by`, chosen among FAN parts at a time, so that no task sees all rows of a value."""
    for k in (2, 1, 0):
        part = F.pmod(F.xxhash64(spread), F.lit(FAN**k))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by, part).orderBy(*order))).where(F.col("rank") <= most)
    return rows


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, subsumed: int = 50, most: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `most` phrases of 2 to max_words words of each language.

    Texts are lower-cased (A-Z) and split at `.,;:!?` and line ends into pieces, those at spaces and tabs into words. a is how often
    the phrase occurs within pieces, overlaps included, at least `least`; n is how many words the language has. Of all cuts of the
    phrase in two, with l and r the counts of the parts, the one with the lowest floor(1000000 a a / (l r)) counts (ties: the shorter
    first part). Phrases that lie in a longer candidate with at least `subsumed` percent of their count are dropped. Order: score
    and a descending, then bytes of the phrase.

    Null languages are `und`; null texts add nothing; repeated rows count each time; an empty table gives an empty table; other
    columns are not read. A longer candidate that holds a phrase also has an extension of it by one word that occurs as often, so
    extensions by one word decide what is subsumed.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words or more")
    merged = stripes(docs, max_words, least, lang_col, text_col)
    total = merged[0].groupBy("lang").agg(F.sum("n").alias("n"))
    candidates = reduce(DataFrame.unionByName, [_entries(m).select("lang", "phrase", F.col("n").alias("a")) for m in merged[1:]])
    prefixes = reduce(DataFrame.unionByName, [m.groupBy("lang", "prefix").agg(F.sum("n").alias("f")) for m in merged[1:]])

    # facts about each phrase, brought together by it: its cuts with the counts of their parts, and its most frequent extension
    words = F.split("phrase", " ")
    joined = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array(F.struct(k.alias("k"), F.lit("l").alias("side"), joined(F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit("r").alias("side"), joined(k + 1, F.size(words)).alias("part"))))
    parts = candidates.select("lang", "phrase", "a", F.inline(F.flatten(cuts)))
    facts = parts.join(prefixes.withColumnRenamed("prefix", "part"), ["lang", "part"]).select("lang", "phrase", "a", F.struct("k", "side", "f").alias("cut"))
    for m in merged[2:]:
        for inner in (F.col("prefix"), F.expr("substring(phrase, locate(' ', phrase) + 1)")):
            longer = _entries(m).groupBy("lang", inner.alias("phrase")).agg(F.max("n").alias("longer"))
            facts = facts.unionByName(longer, allowMissingColumns=True)
    if "longer" not in facts.columns:
        facts = facts.withColumn("longer", F.lit(None).cast("long"))
    held = facts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.collect_list("cut").alias("cuts"), F.max("longer").alias("longer"))
    held = held.where(F.col("a").isNotNull() & F.coalesce(100 * F.col("longer") < subsumed * F.col("a"), F.lit(True)))

    part = lambda k, s: F.get(F.filter("cuts", lambda c: (c["k"] == k) & (c["side"] == s)), F.lit(0))["f"]
    whole = lambda c: c.cast("decimal(19, 0)")
    held = held.withColumn("cuts", F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(k.alias("k"), part(k, "l").alias("l"), part(k, "r").alias("r"))))
    held = held.select("lang", "phrase", "a", (F.lit(1_000_000).cast("decimal(7, 0)") * whole(F.col("a")) * whole(F.col("a"))).alias("top"), F.transform("cuts", lambda c: F.struct((whole(c["l"]) * whole(c["r"])).alias("below"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))).alias("cuts"))
    lowest = F.array_min(F.expr("transform(cuts, c -> struct(top div c.below as score, c.k as k, c.l as l, c.r as r))"))
    scored = held.select("lang", "phrase", "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    first = _first(scored, "lang", [F.desc("score"), F.desc("a"), F.col("phrase")], most, "phrase")
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
