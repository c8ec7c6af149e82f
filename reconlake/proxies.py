"""Domain tables built from the given ones. The same text runs in Spark and in DuckDB; {name} stands for a given table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from reconlake.plans.lineage import importable

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

PROXIES = {
    "scores": "SELECT event_id AS sample_id, user_id % 40 AS object_id, event_id % 13 AS scene_id, event_type AS arm, event_id % 3 AS seed, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value FROM {events}",
    "pairs": "SELECT user_id AS sample_id, user_id % 40 AS object_id, user_id % 13 AS scene_id, event_type AS arm, event_id % 3 AS seed, round(avg(value), 6) AS value FROM {events} GROUP BY user_id, event_type, event_id % 3",
    "obs": "SELECT event_id AS sample_id, user_id % 33 AS object_id, event_id % 13 AS scene_id, (event_id * 7) % 1000 AS image_id, CAST(floor(value * 100) AS BIGINT) AS pixels, ((event_id * 37) % 100) / CAST(100 AS DOUBLE) AS vis FROM {events}",
    "px": "SELECT event_type AS sample_id, CAST(extract(DAY FROM ts) AS INT) - 1 AS v, CAST(extract(HOUR FROM ts) AS INT) AS u, CASE WHEN count(*) % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE 1 + floor(sum(floor(value * 1000)) / count(*)) / CAST(1000000 AS DOUBLE) END AS depth, max(value) > 8 AS mask, CAST(round(max(value)) AS INT) % 256 AS r, CAST(count(*) AS INT) % 256 AS g, CAST(round(min(value) * 10) AS INT) % 256 AS b FROM {events} GROUP BY 1, 2, 3",
    "edit": "SELECT event_type AS sample_id, CAST(extract(DAY FROM ts) AS INT) - 1 AS v, CAST(extract(HOUR FROM ts) AS INT) AS u, max(value) > 9 AS mask, CAST(round(max(value)) AS INT) % 256 AS r, CAST(count(*) + CASE WHEN max(value) > 20 THEN 1 ELSE 0 END AS INT) % 256 AS g, CAST(round(min(value) * 10) AS INT) % 256 AS b FROM {events} GROUP BY 1, 2, 3",
    "assets": "SELECT p_partkey AS asset, p_brand AS family, p_type AS category, p_size AS size, p_retailprice AS price, p_name AS name, p_partkey % 50 = 0 AS pilot FROM {part}",
    "vertices": "SELECT CAST('all' AS STRING) AS mesh_id, p_partkey AS vid, CAST(p_size AS DOUBLE) / 10 AS x, p_retailprice / 1000 AS y, CAST(length(p_name) AS DOUBLE) / 10 AS z FROM {part}",
    "faces": "SELECT CAST('all' AS STRING) AS mesh_id, l_orderkey AS fid, max(CASE WHEN n = 1 THEN l_partkey END) AS a, max(CASE WHEN n = 2 THEN l_partkey END) AS b, max(CASE WHEN n = 3 THEN l_partkey END) AS c FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n FROM {lineitem}) AS ranked WHERE n <= 3 GROUP BY l_orderkey HAVING count(*) = 3",
    "manifest": "SELECT doc_id, source, lang, sha256_text, n_chars FROM {hashed}",
    "admitted": "SELECT d.doc_id AS sample_id, d.n_chars % 3 <> 0 AS source_calibrated, d.n_chars % 5 <> 0 AS edited_raw_screen_pass, (d.n_chars % 3 <> 0) AND (d.n_chars % 5 <> 0) AS calibrated_silhouette_pass FROM {documents} AS d",
    "reviews": "SELECT doc_id AS sample_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'pass' ELSE 'uncertain' END AS decision FROM {labels}",
    "curves": "SELECT event_type AS run, event_id AS step, value AS loss, value / 2 + 1 AS seconds, CAST(round(value * 1000) AS BIGINT) AS bytes FROM {events}",
}
_DIALECT = {"spark": {"sha256_text": "sha2(text, 256)"}, "duckdb": {"sha256_text": "sha256(text)"}}
_HASHED = "SELECT doc_id, source, lang, n_chars, {sha} AS sha256_text FROM {documents}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def proxy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A proxy, or a given table by its name. Only the columns that a query needs are read."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = PROXIES[name].replace("{hashed}", "(" + _HASHED.replace("{sha}", _DIALECT["spark"]["sha256_text"]) + ") AS hashed")
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def points(spark: SparkSession, sf_dir: str, odd: int | None = None) -> DataFrame:
    """Clouds by label: point_id and the first three components; odd 0 or 1 keeps even or odd ids."""
    df = table(spark, sf_dir, "embeddings").selectExpr("label AS cloud", "vec_id AS point_id", *[f"CAST(embedding[{k}] AS DOUBLE) AS {a}" for k, a in enumerate("xyz")])
    return df if odd is None else df.where(f"point_id % 2 = {odd}")


def duck(sql: str) -> str:
    """SQL with {proxy} names replaced by subqueries over the given tables."""
    texts = dict(PROXIES)
    pts = "SELECT label AS cloud, vec_id AS point_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {a}" for k, a in enumerate("xyz")) + " FROM {embeddings}"
    texts |= {"points": pts, "even": f"SELECT * FROM ({pts}) AS p WHERE point_id % 2 = 0", "odd": f"SELECT * FROM ({pts}) AS p WHERE point_id % 2 = 1"}
    texts["hashed"] = _HASHED.replace("{sha}", _DIALECT["duckdb"]["sha256_text"])

    def sub(m: re.Match) -> str:
        name = m[1]
        return name if name in TABLES else "(" + re.sub(r"\{(\w+)\}", sub, texts[name]) + ")"

    return re.sub(r"\{(\w+)\}", sub, sql)
