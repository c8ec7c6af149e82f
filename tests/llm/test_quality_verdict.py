"""The registered verdict of quality rules against a plain version, and columns whose names clash with those used inside."""

import math
import re
import struct

import duckdb
import numpy as np
import xxhash

from reconlake.llm import quality_rules, queries

SF = "/root/testdata/sf0.001"


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs, each seeded by the one before."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def plain_kept(docs, labels, base_failed):
    n = quality_rules.BUCKETS
    ids = sorted({d for d, q in labels if q == 1 and d is not None}, key=lambda d: (spark_hash(d), d))[: quality_rules.MAX_TRUSTED]
    fold = {d: spark_hash("fold", d) % 2 for d in ids}
    grams, raw, targets = {}, [0] * n, [[0] * n, [0] * n]
    for k, (d, text) in enumerate(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams[k] = [spark_hash(x) % n for x in w] + [spark_hash(x, y) % n for x, y in zip(w, w[1:])]
        for b in grams[k]:
            raw[b] += 1
            if d in fold:
                targets[fold[d]][b] += 1
    mean = lambda k, t: sum(t[b] for b in grams[k]) / len(grams[k])
    other = [quality_rules.log_ratios(raw, targets[1 - f]) for f in (0, 1)]
    held = [mean(k, other[fold[d]]) for k, (d, _) in enumerate(docs) if d in fold and (len(grams[k]) + 1) // 2 >= quality_rules.MIN_WORDS]
    least = math.floor(np.quantile(held, quality_rules.MAX_REJECTED))
    both = quality_rules.log_ratios(raw, [a + b for a, b in zip(*targets)])
    return [not failed and sum(both[b] for b in grams[k]) >= least * len(grams[k]) for k, failed in enumerate(base_failed)]


def test_registered_verdict(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    got = sorted(queries.op2_quality_rules(spark, SF).collect(), key=lambda r: r["doc_id"])
    assert [r["kept"] for r in got] == plain_kept(docs, labels, [r["base_failed"] for r in got])
    assert {r["kept"] for r in got} == {True, False}


def test_columns_of_any_name_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = ["fold", "trusted", "id", "w", "g", "bucket", "row", "words", "same", "at"]
    wide = docs.selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(names)])
    got = {r["doc_id"]: r for r in quality_rules.quality(wide, labels).collect()}
    for r in quality_rules.quality(docs, labels).collect():
        assert got[r["doc_id"]]["kept"] == r["kept"] and [got[r["doc_id"]][c] for c in names] == list(range(len(names)))


def test_all_labelled_documents_are_trusted(spark):
    labels = spark.range(120_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    both = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1)], "doc_id long, quality int"))
    got = quality_rules.trusted_ids(both)
    assert got.count() == 60_000 and got.select("trusted").distinct().count() == 60_000
    assert {r["fold"] for r in got.select("fold").distinct().collect()} == {0, 1}


def test_only_trusted_texts_are_shuffled(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('text ', id) END AS text")
    ids = quality_rules.trusted_ids(spark.range(0, 40_000, 4).selectExpr("id AS doc_id", "1 AS quality"))
    shuffled = []
    plain = quality_rules.stored
    quality_rules.stored = lambda df, name: shuffled.append(df) or plain(df, name)
    try:
        got = quality_rules.labelled(docs.unionByName(docs.where("doc_id < 8")), ids)
    finally:
        quality_rules.stored = plain
    assert got.count() == 10_002 and got.where("text is null").count() == 1430  # 0 twice
    plan = shuffled[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [slot" in plan
    text = spark.range(9).selectExpr("CAST(id AS STRING) AS doc_id", "'a' AS text")
    assert quality_rules.labelled(text, ids).count() == 3
