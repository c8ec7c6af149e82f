"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconlake.plans.lineage import stored

#: Vectors that the tree is fitted on, at most: those whose ids have the smallest hash. Every row is indexed.
SAMPLE = 16384
BRANCHES, LEAF_SAMPLE = 16, 24
#: Queries that visits are calibrated on, at most, and the recall that they must reach.
CALIBRATED, RECALL = 128, 0.97
#: Vectors and queries of one cell of the search, about.
CELL = 2048


@dataclass
class Tree:
    """centres[node] of the node's children, and their names: node numbers, or ~leaf for leaves."""

    centres: list[np.ndarray]
    children: list[list[int]]
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each unit vector belongs to, down the nearest centres."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            nearest = np.argmax(x[rows] @ self.centres[node].T, axis=1)
            for k in np.unique(nearest):
                child, some = self.children[node][k], rows[nearest == k]
                if child < 0:
                    out[some] = ~child
                else:
                    todo.append((child, some))
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in the order of a best-bin-first search: the open branch whose centre is most similar goes first."""
        queue, out = [(-2.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(~node)
                continue
            for s, child in zip((self.centres[node] @ q).tolist(), self.children[node]):
                heapq.heappush(queue, (-s, child))
        return out


def fit(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF_SAMPLE, rounds: int = 8) -> Tree:
    """The tree of unit vectors x: each node's vectors are parted by spherical k-means until few are left."""
    tree, rng = Tree([], [], 0), np.random.default_rng(1)

    def grow(rows: np.ndarray) -> int:
        node = len(tree.centres)
        tree.centres.append(np.zeros(0))
        tree.children.append([])
        k = int(min(branches, max(1, len(rows) // max(1, leaf // 2))))
        c = x[rng.choice(rows, k, replace=False)]
        for _ in range(rounds):
            of = np.argmax(x[rows] @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, of, x[rows])
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), c)
        of = np.argmax(x[rows] @ c.T, axis=1)
        names = []
        for j in range(k):
            part = rows[of == j]
            if len(part) > leaf and len(part) < len(rows):
                names.append(grow(part))
            else:
                names.append(~tree.leaves)
                tree.leaves += 1
        tree.centres[node], tree.children[node] = c, names
        return node

    grow(np.arange(len(x)))
    return tree


def usable(v: Column) -> Column:
    """Not null, finite in every component, and not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares of large or tiny components stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows of x with rows of q (or one vector), in double precision; equal rows give equal values."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum(axis=-1)))


def nearest(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of the k nearest rows of x for each row of q but itself, ties to smaller ids.

    One product finds what can be among them; their cosines are then taken exactly.
    """
    near = _unit(q) @ _unit(x).T
    near[q_ids[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:
        least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
    else:
        least = np.full(len(q), -2.0)
    row, col = np.nonzero((near >= least[:, None] - 1e-9) & (near > -np.inf))
    score = np.concatenate([cosine(x[col[i : i + 65536]], q[row[i : i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0)])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    first = place < k
    return q_ids[row[first]], ids[col[first]], score[first]


def _top(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: dict[int, np.ndarray], k: int) -> DataFrame:
    """(query_id, vec_id, score, leaf, rank) of a bounded set of queries against every row, block by block."""
    ids, q = np.array(list(queries)), np.array(list(queries.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                names = b.column(0).to_numpy()
                one, found, score = nearest(names, _matrix(b.column(1)), ids, q, k)
                order = np.argsort(names)
                leaf = b.column(2).to_numpy()[order[np.searchsorted(names[order], found)]]
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(found), pa.array(score), pa.array(leaf)], names=["query_id", "vec_id", "score", "leaf"])

    return _top(vectors.select("vec_id", "v", "leaf").mapInArrow(run, "query_id long, vec_id long, score double, leaf int"), k)


def calibrated(tree: Tree, truth: list[tuple[int, int]], queries: dict[int, np.ndarray], recall: float) -> int:
    """Leaf visits, widened one by one until this share of the true neighbours (query, leaf) lies in a visited leaf."""
    rank = {i: {leaf: n for n, leaf in enumerate(tree.visits(_unit(q[None])[0], tree.leaves))} for i, q in queries.items()}
    needed = sorted(rank[i][leaf] for i, leaf in truth)
    visits = 1
    while visits < tree.leaves and sum(n < visits for n in needed) < recall * len(needed):
        visits += 1
    return visits


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, recall: float = RECALL, calibrate: int = CALIBRATED) -> DataFrame:
    """(query_id, rank, vec_id, score): for ids divisible by `every`, the k rows found nearest by cosine, ties to smaller ids.

    Rows with a null id, and vectors that are null, zero, of another length than most of the sample (ties: the longer), or with null
    or non-finite components take no part. Of equal vectors the k + 1 smallest ids can be among the nearest, so those are
    searched. Repeated rows of one id count once, with the smallest of their vectors. Queries that met fewer than k rows visit four
    times as many leaves, until they have k or have visited all. No usable vector: an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    schema = "query_id long, rank int, vec_id long, score double"
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not some:
        return spark.createDataFrame([], schema)
    lengths = Counter(len(r["v"]) for r in some)
    size = max(lengths, key=lambda n: (lengths[n], n))
    fitted = _unit(np.array([r["v"] for r in some if len(r["v"]) == size]))
    tree = fit(fitted)
    rows = rows.where(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.assign(_unit(_matrix(b.column(1)))))], names=["vec_id", "v", "leaf"])

    # equal vectors: a group limit before the shuffle keeps the k + 1 smallest ids of each
    copies = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("vec_id", "v")
    index = stored(kept.mapInArrow(assign, "vec_id long, v array<double>, leaf int"), "leaves")
    asked = rows.where(F.col("vec_id") % every == 0)
    tried = {r["vec_id"]: np.array(r["v"]) for r in asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(calibrate).collect()}
    if not tried:
        return spark.createDataFrame([], schema)
    truth = [(r["query_id"], r["leaf"]) for r in exact(index, tried, k).collect()]
    visits = calibrated(tree, truth, tried, recall)

    asked, out = stored(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries"), None
    while True:
        found = stored(_met(index, asked, tree, visits, k), "found")
        out = found if out is None else out.unionByName(found)
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        short = stored(asked.join(full, "query_id", "left_anti"), "short")
        if visits >= tree.leaves or short.isEmpty():
            return _top(out.dropDuplicates(["query_id", "vec_id"]), k).select("query_id", "rank", "vec_id", "score")
        asked, visits = short, min(4 * visits, tree.leaves)


def _met(index: DataFrame, asked: DataFrame, tree: Tree, visits: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of the index (vec_id, v, leaf) for each query (query_id, q) in its first `visits` leaves."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = [tree.visits(q, visits) for q in _unit(_matrix(b.column(1)))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["query_id", "q", "leaves"])

    asked = stored(asked.select("query_id", "q").mapInArrow(plan, "query_id long, q array<double>, leaves array<int>"), "visits")
    asked = asked.select("query_id", "q", F.explode("leaves").alias("leaf"))
    # a leaf with many vectors or queries is dealt over cells of bounded size; leaves are as many as the tree has
    counts = lambda df: dict(map(tuple, df.groupBy("leaf").count().collect()))
    cells = lambda n: F.split(F.lit(",".join(str(max(1, -(-n.get(i, 0) // CELL))) for i in range(tree.leaves))), ",").cast("array<int>")
    parts, asks = cells(counts(index)), cells(counts(asked))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.get(n, F.col("leaf")) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.get(n, F.col("leaf"))).cast("int")
    left = index.select("leaf", "vec_id", "v", dealt("vec_id", parts).alias("part"), spread(asks).alias("ask"))
    right = asked.select("leaf", "query_id", "q", dealt("query_id", asks).alias("ask"), spread(parts).alias("part"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        one, found, s = nearest(a["vec_id"].to_numpy(), np.stack(a["v"].to_numpy()), b["query_id"].to_numpy(), np.stack(b["q"].to_numpy()), k)
        return pd.DataFrame({"query_id": one, "vec_id": found, "score": s})

    keys = ["leaf", "part", "ask"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "query_id long, vec_id long, score double")
    return _top(found, k)
