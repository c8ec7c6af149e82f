"""Tree search against brute force: recall, exact scores, ties, hot copies, unusable vectors."""

import numpy as np

from reconlake.llm import ann_tree

SCHEMA = "vec_id long, embedding array<float>, label int, query_id string, rank int, v string, leaf int"


def brute(rows, every, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, q in rows:
        if i % every == 0:
            s = ann_tree.cosine(x, np.array(q, np.float64))
            s[ids == i] = -np.inf
            at = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
            out[i] = [(int(ids[j]), float(s[j])) for j in at]
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 16))
    x = (centres[r.integers(0, 40, 3000)] + 0.4 * r.normal(size=(3000, 16))).astype(np.float32)
    x[r.integers(0, 3000, 1000)] = x[17]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] + [1.0] * 15), (5150, [float("inf")] + [1.0] * 15), (5200, [None] + [1.0] * 15), (5250, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 1, "x", 2, "y", 3) for i, v in [*rows, *odd, rows[100], rows[7]]], SCHEMA).repartition(4)
    got = {}
    for q in ann_tree.search(df, calibrate=32).orderBy("query_id", "rank").collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    want = brute(rows, 50, 5)
    assert set(got) == set(want)
    hits = 0
    by = dict(rows)
    for i, found in got.items():
        assert [n for n, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(s == ann_tree.cosine(np.array([by[j]], np.float64), np.array(by[i], np.float64))[0] for _, j, s in found)
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        hits += len({j for _, j, _ in found} & {j for j, _ in want[i]})
    assert hits >= 0.9 * 5 * len(want)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<float>")
    got = [tuple(r)[:3] for r in ann_tree.search(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert ann_tree.search(df.limit(0)).count() == 0
    assert ann_tree.search(df.where("vec_id = 1")).count() == 0


def test_tight_clusters_still_give_k(spark):
    """400 clusters of 6 or 7: a query's own leaf has few rows, so it visits more until it has k."""
    r = np.random.default_rng(17)
    centres = r.normal(size=(400, 16))
    rows = [(k, (centres[k % 400] + 1e-4 * r.normal(size=16)).tolist()) for k in range(2600)]
    got = ann_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10)
    per = {}
    for x in got.collect():
        per.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    assert len(per) == 260 and all(sorted(n for n, _ in v) == [1, 2, 3, 4, 5] and len({i for _, i in v}) == 5 for v in per.values())
    few = ann_tree.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), every=1)
    assert few.count() == 6


def test_odd_length_and_repeated_ids(spark):
    """One vector of another length takes no part; of an id's vectors the smallest counts."""
    r = np.random.default_rng(18)
    rows = [(k, r.normal(size=16).tolist()) for k in range(200)] + [(900, r.normal(size=40).tolist())]
    plain = sorted(map(tuple, ann_tree.search(spark.createDataFrame(rows[:200], "vec_id long, embedding array<double>"), every=20).collect()))
    with_odd = sorted(map(tuple, ann_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20).collect()))
    assert plain == with_odd and len(plain) == 50
    again = rows[:200] + [(k, [99.0, *v[1:]]) for k, v in rows[:60]] + rows[:5]
    x = np.array([v for _, v in rows[:200]])
    got = ann_tree.search(spark.createDataFrame(again, "vec_id long, embedding array<double>"), every=20).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in got}) == len(got) == 50
    for g in got:
        assert abs(g["score"] - ann_tree.cosine(x[g["vec_id"]][None], x[g["query_id"]])[0]) < 1e-12
