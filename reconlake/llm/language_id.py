"""Language identification by rank order: a document's most frequent n-grams against each language's profile."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconlake.plans.lineage import stored

#: Most frequent n-grams of a profile; also what an n-gram that a profile lacks is out of place by.
PROFILE = 400
#: Most languages that profiles are shared for: at most PROFILE * LANGUAGES entries reach the driver and the workers.
LANGUAGES = 4096
#: N-grams that a task holds before it sums them up, and twice the different ones before it hands them on.
COUNTED_TOGETHER = 1 << 20

_GAP, _BITS = 1, 21  # the mark between words, and bits of a character; an n-gram of up to three characters fits a long


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of a text's words, which are runs of letters in lower case with a gap at either end.

    Characters sit at 21 bits each, the last one lowest; no n-gram is the gap alone or has it in its middle.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    gap_before = np.concatenate(([True], ~letter[:-1])) if len(letter) else letter
    # of each run of other characters one gap stays; one more goes to either end
    x = np.concatenate(([_GAP], np.where(letter, points, _GAP)[letter | ~gap_before], [_GAP]))
    x = x[np.concatenate(([True], (x[1:] != _GAP) | (x[:-1] != _GAP)))]
    ones = x[x != _GAP]
    if not len(ones):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    twos = (x[:-1] << _BITS) | x[1:]
    threes = ((x[:-2] << 2 * _BITS) | (x[1:-1] << _BITS) | x[2:])[x[1:-1] != _GAP]
    return np.unique(np.concatenate((ones, twos, threes)), return_counts=True)


def _ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes in order, ties to the smaller code."""
    return codes[np.lexsort((codes, -counts))[:most]]


def profiles(docs: DataFrame, profile: int = PROFILE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, gram, n): the `profile` most frequent n-grams of each language, rank from 0, ties to the smaller code.

    All documents with a language count, repeated rows each time. Null languages, and texts that are null or have no letter, add
    nothing. Counts are summed up within tasks before they are shuffled, so a language that most rows have is no hot key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        waiting = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            counts = np.zeros(len(codes), np.int64)
            np.add.at(counts, at, np.concatenate([n for _, n in parts]))
            return codes, counts

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                codes, counts = ngrams(text.as_py())
                held.setdefault(lang, []).append((codes, counts))
                waiting += len(codes)
                if waiting > COUNTED_TOGETHER:
                    for k, parts in held.items():
                        held[k] = [merged(parts)]
                    waiting = sum(len(parts[0][0]) for parts in held.values())
                    if waiting > COUNTED_TOGETHER // 2:
                        yield from handed_on()
                        waiting = 0
        yield from handed_on()

    learned = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = learned.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    first = counts.withColumn("place", F.row_number().over(by)).where(F.col("place") <= profile)  # Spark keeps that many a task before the shuffle
    return first.select("lang", (F.col("place") - 1).alias("rank"), "gram", "n")


class _Profiles(NamedTuple):
    """Profiles by n-gram: gram[k] is in the profiles of lang[start[k]:start[k + 1]] at those ranks."""

    langs: list[str]
    gram: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    rank: np.ndarray


def _shared(rows: DataFrame) -> _Profiles:
    if rows.select("lang").distinct().count() > LANGUAGES:
        raise ValueError(f"profiles are shared for up to {LANGUAGES} languages")
    got = rows.select("lang", "rank", "gram").toArrow()
    langs = sorted(set(got["lang"].to_pylist()), key=lambda x: x.encode())
    number = {x: k for k, x in enumerate(langs)}
    gram, rank = got["gram"].to_numpy(), got["rank"].to_numpy().astype(np.int64)
    lang = np.array([number[x] for x in got["lang"].to_pylist()], np.int64)
    order = np.lexsort((lang, gram))
    codes, start = np.unique(gram[order], return_index=True)
    return _Profiles(langs, codes, np.append(start, len(gram)), lang[order], rank[order])


def closeness(text: str, known: _Profiles, profile: int = PROFILE) -> np.ndarray | None:
    """1 - distance / largest distance to each language; None if the text has no letter.

    The out-of-place distance sums up, over the text's most frequent n-grams, how many ranks apart each is in the two profiles, and
    `profile` where the language's lacks it.
    """
    codes = _ranked(*ngrams(text), profile)
    if not len(codes):
        return None
    at = np.minimum(np.searchsorted(known.gram, codes), max(len(known.gram) - 1, 0))
    met = np.flatnonzero(known.gram[at] == codes) if len(known.gram) else at[:0]
    first, n = known.start[at[met]], known.start[at[met] + 1] - known.start[at[met]]
    entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    near = profile - np.abs(known.rank[entry] - np.repeat(met, n))
    return np.bincount(known.lang[entry], near, len(known.langs)) / (profile * len(codes))


def predict(docs: DataFrame, rows: DataFrame, profile: int = PROFILE, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the language of the closest profile of `rows` (ties to the first by bytes) and its closeness from 0 to 1.

    Null texts, texts without a letter, and all texts if there is no profile, get `und` and 0. Rows and other columns stay; columns
    named like the two new ones are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(_shared(rows))

    @F.pandas_udf("lang string, score double")
    def judged(texts):
        import pandas as pd

        out = []
        for t in texts:
            close = closeness(t, known.value, profile) if isinstance(t, str) and known.value.langs else None
            best = None if close is None else int(np.argmax(close))
            out.append(("und", 0.0) if best is None else (known.value.langs[best], float(close[best])))
        return pd.DataFrame(out, columns=["lang", "score"])

    rest = [c for c in docs.columns if c not in (pred_col, score_col)]
    out = docs.select(*[F.col(f"`{c}`") for c in rest], judged(F.col(text_col).cast("string")).alias("_judged"))
    return out.select(*[F.col(f"`{c}`") for c in rest], F.col("_judged.lang").alias(pred_col), F.col("_judged.score").alias(score_col))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for documents that are not learned from: crc32 of the id as text is divisible by `folds`, or the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", profile: int = PROFILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): profiles from the rows that aren't held out, predictions for all.

    One row per input row, repeated rows too; rows with a null id are held out. Only the text decides a prediction. An empty table
    gives an empty table; other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), "text", "lang").withColumn("held_out", held_out("doc_id"))
    known = stored(profiles(slim.where(~F.col("held_out")), profile), "profiles")
    return predict(slim.select("doc_id", "held_out", "text"), known, profile).select("doc_id", "held_out", "lang_pred", "score")
