"""Functions that a user brings: field models, metrics, mesh loaders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Metrics by name.
METRICS: dict[str, Column | Callable[[], Column]] = {}


def apply_field(q: DataFrame, model: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], batch: int = 4096, budget: int | None = None) -> DataFrame:
    """Q with udf_m and logit from model(points [n, 3]), called on at most `batch` points at a time. More rows than the budget: an error."""
    if budget is not None and q.count() > budget:
        raise ValueError("more queries than the budget allows")
    schema = q.drop("udf_m", "logit").schema.add("udf_m", "double").add("logit", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch].copy()
                part["udf_m"], part["logit"] = model(part[["x", "y", "z"]].to_numpy(float))
                yield part

    return q.drop("udf_m", "logit").mapInPandas(run, schema)


def register_metric(name: str, expr: Callable[[], Column]) -> None:
    """Adds a metric; names can't be taken twice."""
    if name in METRICS:
        raise ValueError(f"{name} is taken")
    METRICS[name] = expr


def metric_values(scores: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """Long rows (ids, metric, value) of registered metrics."""
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), METRICS[n]().cast("double").alias("value")) for n in names])
    return scores.select(*ids, F.explode(rows).alias("_m")).select(*ids, "_m.metric", "_m.value")


def register_source(spark, name: str, load: Callable[[str], Iterator[tuple]]) -> None:
    """A SQL table function name(path) that gives triangle rows (fid, ax .. cz) from load(path)."""

    class Source:
        def eval(self, path: str):
            yield from load(path)

    columns = ", ".join(["fid long", *[f"{k}{a} double" for k in "abc" for a in "xyz"]])
    spark.udtf.register(name, udtf(Source, returnType=columns))
