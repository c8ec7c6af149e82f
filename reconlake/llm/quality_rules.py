"""Quality rules: counts on whole texts, then a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

DataFrame functions only. Weights are whole numbers, so scores don't depend on the order of additions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.operators.quantiles import quantiles
from reconlake.plans.lineage import stored

#: Hash buckets of the multinomials; weights are kept in units of 1 / SCALE nats.
BUCKETS, SCALE = 16384, 10_000
#: Slots of 32 bits that the trusted ids' hashes are marked in.
SLOTS = 1 << 17
#: Labelled documents that the target multinomial is fitted on, at most, those of smallest hash; None: all of them.
MAX_TRUSTED: int | None = None
#: A document is rejected if its mean log-likelihood ratio for an n-gram is under that of all but this share of the trusted
#: documents of at least MIN_WORDS words, each scored by a target that it is not part of.
MAX_REJECTED, MIN_WORDS = 0.01, 10
#: Pseudo-counts of a bucket, as a share of the mean bucket.
SMOOTHING = 0.1

_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def _next(words: Column, k: int = 1) -> Column:
    return F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0)))


def _ngrams(hashes: Column, n: int) -> Column:
    """64-bit hashes of the windows of n words, in order, from the words' hashes (a column, since it is used n times)."""
    out = hashes
    for k in range(1, n):
        out = F.zip_with(F.slice(out, 1, F.greatest(F.size(hashes) - k, F.lit(0))), _next(hashes, k), lambda a, b: F.xxhash64(a, b))
    return out


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text, words, hashes): the input row as one column, so that columns made here clash with none of its own."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("words", words_of(F.col("text"))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def _base(rows: DataFrame, window: int = 5) -> DataFrame:
    """_rows with the base columns. Null and empty texts have zero everywhere and fail.

    Arrays that are used more than once are columns of their own, so that each is made once. Words in repeated windows: hashes
    of a text with repeats are sorted with their places, equal neighbours are marked, and the marked windows' places merged.
    """
    out = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("windows", _ngrams(F.col("hashes"), window))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    out = out.withColumn("placed", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn("same", F.zip_with("placed", _next(F.col("placed")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    before = F.concat(F.array(F.lit(False)), F.slice("same", 1, F.size("same") - 1))
    out = out.withColumn("twice", F.zip_with("same", before, lambda a, b: a | b))
    out = out.withColumn("at", F.sort_array(F.array_compact(F.zip_with("placed", "twice", lambda r, t: F.when(t, r["i"])))))
    gaps = F.zip_with("at", _next(F.col("at")), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
    out = out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, g: s + g), F.lit(0)).cast("long"),
        }
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _with_row(out: DataFrame, docs: DataFrame, made: list[str]) -> DataFrame:
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in made], *made)


def base_counts(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """docs with the base columns, which replace columns of those names."""
    return _with_row(_base(_rows(docs, text_col), window), docs, BASE)


def _bucket(*words: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame, most: int | None = MAX_TRUSTED) -> DataFrame:
    """(trusted, fold): all distinct non-null doc_id of quality 1, or the `most` of smallest hash, in two folds by hash."""
    ids = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("trusted")).where("trusted is not null").distinct()
    if most is not None:
        ids = ids.orderBy(F.xxhash64("trusted"), "trusted").limit(most)
    return ids.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "trusted"), F.lit(2)).cast("int"))


def labelled(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fold, text): the trusted documents, stored once.

    trusted grows with the labels, so this join is shuffled. Bits of the trusted ids, SLOTS * 32 at most, are broadcast to leave
    texts that can't be trusted out of the shuffle; they give false positives only, so the join decides.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    if kind == dict(trusted.dtypes)["trusted"] and kind in ("tinyint", "smallint", "int", "bigint", "string"):
        h = lambda c: F.xxhash64(F.lit("bits"), c)
        slot = lambda c: F.pmod(F.shiftright(h(c), 6), F.lit(SLOTS)).cast("int")
        bit = lambda c: F.pow(F.lit(2.0), F.pmod(h(c), F.lit(32))).cast("long")
        bits = trusted.groupBy(slot(F.col("trusted")).alias("slot")).agg(F.bit_or(bit(F.col("trusted"))).alias("bits"))
        rows = rows.where("id is not null").withColumn("slot", slot(F.col("id"))).join(F.broadcast(bits), "slot")
        rows = rows.where(F.col("bits").bitwiseAND(bit(F.col("id"))) != 0).select("id", "text")
    return stored(rows.join(trusted.hint("merge"), F.col("id") == F.col("trusted")).select("fold", "text"), "labelled")


def bucket_counts(rows: DataFrame, by: tuple[str, ...] = (), text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(by, bucket, n): occurrences of hashed words and word pairs."""
    rows = rows.select(*by, words_of(F.col(text_col)).alias("w"))
    rows = rows.select(*by, F.explode(F.arrays_zip(F.col("w").alias("a"), _next(F.col("w")).alias("b"))).alias("g"))
    pair = F.when(F.col("g.b").isNotNull(), _bucket(F.col("g.a"), F.col("g.b"), buckets=buckets))
    rows = rows.select(*by, F.explode(F.array(_bucket(F.col("g.a"), buckets=buckets), pair)).alias("bucket")).where("bucket is not null")
    return rows.groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def weights(counts: DataFrame, buckets: int = BUCKETS, **how) -> list[int]:
    """log_ratios of (bucket, raw, target); `buckets` rows reach the driver, no more."""
    raw, target = [0] * buckets, [0] * buckets
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return log_ratios(raw, target, **how)


def log_ratios(raw: list[int], target: list[int], scale: int = SCALE, smoothing: float = SMOOTHING) -> list[int]:
    """Log-likelihood ratio of target against raw for each bucket, in whole units; zeros without a target."""
    n_raw, n_target, buckets = sum(raw), sum(target), len(raw)
    if not n_target:
        return [0] * buckets
    share = lambda x, n: (x + smoothing * n / buckets) / (n * (1 + smoothing))
    return [round(scale * (math.log(share(t, n_target)) - math.log(share(r, n_raw)))) for r, t in zip(raw, target)]


def _score(w: list[int]) -> Column:
    """Sum of the weights of a document's words and word pairs."""
    table = F.split(F.lit(",".join(map(str, w))), ",").cast("array<int>")  # constant, of fixed size
    at = lambda *x: F.get(table, _bucket(*x, buckets=len(w)))
    grams = F.arrays_zip(F.col("words").alias("a"), _next(F.col("words")).alias("b"))
    return F.aggregate(grams, F.lit(0).cast("long"), lambda s, g: s + at(g["a"]) + F.when(g["b"].isNull(), F.lit(0)).otherwise(at(g["a"], g["b"])))


def _n_grams() -> Column:
    return F.greatest(2 * F.size("words").cast("long") - 1, F.lit(0))


def held_out_threshold(rows: DataFrame, raw: list[int], targets: list[list[int]], rejected: float = MAX_REJECTED) -> int | None:
    """The mean score, in whole units, that all but this share of the trusted documents reach when scored by the other fold's target.

    rows: the trusted documents as `labelled` gives them. None if a fold is empty: then no score tells anything. Every trusted
    document is scored; one number reaches the driver.
    """
    if not all(map(sum, targets)):
        return None
    rows = rows.withColumn("words", words_of(F.col("text"))).where(F.size("words") >= MIN_WORDS)
    other = F.when(F.col("fold") == 0, _score(log_ratios(raw, targets[1]))).otherwise(_score(log_ratios(raw, targets[0])))
    low = quantiles(rows.select((other / _n_grams()).alias("mean")), [], "mean", {"t": rejected}).first()
    return None if low is None or low["t"] is None else math.floor(low["t"])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float | None = None, rejected: float = MAX_REJECTED, most: int | None = MAX_TRUSTED) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score_units, n_grams and kept.

    kept: the base rules hold and score_units / n_grams, the mean log-likelihood ratio of the document's words and word
    pairs, is not under the threshold: `threshold` nats, or what the labels give (held_out_threshold). Every row is judged; repeated rows alike.
    Without trusted documents every score is zero and the base rules alone decide. Columns of docs with those names are
    replaced, columns of any other name stay as they are; labels may repeat ids or hold nulls. Null texts have no words.
    """
    rows = labelled(docs, trusted_ids(labels, most), id_col, text_col)
    raw, targets = [0] * buckets, [[0] * buckets, [0] * buckets]
    for r in bucket_counts(docs, text_col=text_col, buckets=buckets).collect():  # `buckets` rows, no more
        raw[r["bucket"]] = r["n"]
    for r in bucket_counts(rows, ("fold",), buckets=buckets).collect():  # and twice as many
        targets[r["fold"]][r["bucket"]] = r["n"]
    least = held_out_threshold(rows, raw, targets, rejected) if threshold is None else round(threshold * SCALE)
    both = log_ratios(raw, [a + b for a, b in zip(*targets)])
    out = _base(_rows(docs, text_col)).withColumn("score_units", _score(both)).withColumn("n_grams", _n_grams())
    passed = F.lit(True) if least is None else F.col("score_units") >= F.lit(least) * F.col("n_grams")
    return _with_row(out.withColumn("kept", ~F.col("base_failed") & passed), docs, [*BASE, "score_units", "n_grams", "kept"])
