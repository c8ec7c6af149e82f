"""Registered queries of the library's own operators, with the SQL that returns the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconlake.functions import expr as X
from reconlake.functions import udf as U
from reconlake.operators import integrity as I
from reconlake.operators import mesh as G
from reconlake.operators import neighbours as N
from reconlake.operators import raster as R
from reconlake.operators import rules as P
from reconlake.operators import select as W
from reconlake.operators import spatial as J
from reconlake.operators import stats as T
from reconlake.operators import summarize as A
from reconlake.operators import surface as V
from reconlake.plans import schedules as D
from reconlake.plans.lineage import scratch_path, stored
from reconlake.proxies import duck, points, proxy
from reconlake.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = duck(sql)
        return f

    return add


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since sums in another order differ in their last bits; negative zero becomes zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# hash draws of functions.expr as SQL
def _h(seed: str, key: str) -> str:
    return f"sha256('{seed}/' || {key})"


def _u(seed: str, key: str) -> str:
    return f"(CAST('0x' || substr({_h(seed, key)}, 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def _k(n: str, seed: str, key: str) -> str:
    return f"(CAST('0x' || substr({_h(seed, key)}, 1, 8) AS BIGINT) % {n})"


# ---- sources and sinks


@query("SELECT 'user' || CAST(user_id % 7 AS VARCHAR) AS name, max(event_id) AS record, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY 1")
def s04_read_catalog(s, d):
    rows = proxy(s, d, "events")
    rec = F.struct(F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")).alias("name"), F.when(F.col("event_type") == "error", "other").otherwise("own").alias("owner"), F.col("event_id").alias("record"), "value")
    pages = rows.groupBy(F.floor(F.col("event_id") / 500).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", rec.alias("r")))), lambda x: x["r"]).alias("records"))
    return S.read_catalog(pages, "own").select("name", "record", "value")


@query("SELECT event_type AS archive, count(*) FILTER (user_id % 4 = 0) AS annotations, count(*) FILTER (user_id % 4 = 1) AS rgb, count(*) FILTER (user_id % 4 = 2) AS depth, count(*) FILTER (user_id % 4 = 3) AS masks, count(*) AS members FROM events GROUP BY 1")
def s07_archive_inventory(s, d):
    kind = F.get(F.array(F.lit("a/scene_gt.json"), F.lit("a/rgb/x.png"), F.lit("depth/x.png"), F.lit("a/mask_visib/x.png")), (F.col("user_id") % 4).cast("int"))
    return S.archive_inventory(proxy(s, d, "events").select(F.col("event_type").alias("archive"), kind.alias("member")))


@query("SELECT sample_id, arm, 'value' AS metric, value FROM {scores} UNION ALL SELECT sample_id, arm, 'seed', CAST(seed AS DOUBLE) FROM {scores}")
def s11_metric_rows(s, d):
    return S.metric_rows(proxy(s, d, "scores"), ["sample_id", "arm"], ["value", "seed"])


@query("SELECT sample_id, value FROM {scores}")
def s12_split_export(s, d):
    public, truth = S.split_export(proxy(s, d, "scores"), "sample_id", ["arm", "seed"], ["value"])
    return truth.join(public.select("sample_id"), "sample_id", "left_semi")


# ---- integrity


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'ok' END AS status FROM documents")
def i01_check_bindings(s, d):
    m = proxy(s, d, "manifest").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("sha256_text").alias("sha256"))
    inv = m.where("doc_id % 11 <> 0").select("path", F.when(F.expr("doc_id % 7 = 0"), "0").otherwise(F.col("sha256")).alias("sha256"))
    return I.check_bindings(m, inv).select("doc_id", "status")


@query("SELECT level, status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 100 = 0 THEN 1 ELSE 2 END AS level, CASE WHEN doc_id % 13 = 0 THEN 'changed' ELSE 'ok' END AS status FROM documents) AS x GROUP BY 1, 2")
def i02_binding_chain(s, d):
    m = proxy(s, d, "manifest").select(F.col("doc_id").cast("string").alias("path"), F.when(F.expr("doc_id % 100 = 0"), "root").otherwise((F.col("doc_id") - F.col("doc_id") % 100).cast("string")).alias("parent"), F.col("sha256_text").alias("sha256"), "doc_id")
    inv = m.select("path", F.when(F.expr("doc_id % 13 = 0"), "0").otherwise(F.col("sha256")).alias("sha256"))
    roots = m.where("parent = 'root'").select(F.lit("root").alias("path")).distinct()
    return I.check_binding_chain(m, inv, roots, 2).groupBy("level", "status").agg(F.count("*").alias("n"))


@query("""SELECT source, sha256(string_agg(d, chr(10) ORDER BY d)) AS digest, count(*) AS n FROM (SELECT source, sha256('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || ',"sha256_text":"' || sha256_text || '"}') AS d FROM {manifest}) AS x GROUP BY 1""")
def i03_canonical_digest(s, d):
    return I.rowset_digest(I.canonical_digest(proxy(s, d, "manifest"), ["n_chars", "doc_id", "sha256_text"]), ["source"], "row_digest")


@query("SELECT source, sha256(string_agg(p || chr(0) || sha256_text || chr(10), '' ORDER BY p)) AS bundle_sha256, count(*) AS files FROM (SELECT source, CAST(doc_id AS VARCHAR) AS p, sha256_text FROM {manifest}) AS x GROUP BY 1")
def i04_bundle_digest(s, d):
    return I.bundle_digest(proxy(s, d, "manifest"), ["source"], "doc_id", "sha256_text")


@query("SELECT doc_id, sha256('text[' || n_chars || ']' || text) AS digest FROM documents")
def i05_array_digest(s, d):
    docs = proxy(s, d, "documents")
    return docs.select("doc_id", I.array_digest(F.lit("text"), F.array("n_chars"), F.encode("text", "UTF-8")).alias("digest"))


@query("SELECT page_id FROM pages WHERE page_id % 3 = 1 OR page_id % 10 = 4")
def i06_check_paths(s, d):
    k = F.col("page_id")
    path = F.when(k % 3 == 1, F.concat(F.lit("/abs/"), k.cast("string"))).when(k % 10 == 4, F.lit("a/../../x")).when(k % 10 == 5, F.lit("a/b/../../x")).otherwise(F.lit("./a//b"))
    return I.check_paths(proxy(s, d, "pages").select("page_id", path.alias("path")), "path").select("page_id")


@query("SELECT violation, count(*) AS n FROM (SELECT 'family is required' AS violation FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT 'sha256 is malformed' FROM documents WHERE doc_id % 8 = 0 UNION ALL SELECT 'size_bytes is not positive' FROM documents WHERE n_chars <= 0 UNION ALL SELECT 'derived assets need lineage_root' FROM documents WHERE doc_id % 6 = 0 AND doc_id % 4 <> 0) AS x GROUP BY 1")
def i07_validate_assets(s, d):
    k = F.col("doc_id")
    m = proxy(s, d, "manifest").select(k.cast("string").alias("asset_id"), F.lit("u").alias("uri"), F.when(k % 9 == 0, "  ").otherwise("f").alias("family"), F.lit("cc0").alias("license"), F.when(k % 8 == 0, F.upper(F.lit("AB"))).otherwise(F.col("sha256_text")).alias("sha256"), F.col("n_chars").alias("size_bytes"), (k % 6 == 0).alias("derived"), F.when(k % 4 == 0, "root").alias("lineage_root"))
    return I.validate_assets(m).groupBy("violation").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'lang' AS field FROM documents WHERE doc_id % 5 = 0 AND doc_id % 17 <> 0 UNION ALL SELECT doc_id, unnest(['lang', 'source']) FROM documents WHERE doc_id % 17 = 0")
def i08_check_copied(s, d):
    m = proxy(s, d, "manifest").select("doc_id", "lang", "source")
    copied = m.withColumn("lang", F.when(F.expr("doc_id % 5 = 0"), "xx").otherwise(F.col("lang")))
    return I.check_copied(copied, m.where("doc_id % 17 <> 0"), "doc_id", ["lang", "source"])


@query("SELECT object_id, position, a.sample_id AS left_id, b.sample_id AS right_id FROM (SELECT object_id, sample_id, row_number() OVER (PARTITION BY object_id ORDER BY sample_id) AS position FROM {obs}) AS a FULL JOIN (SELECT object_id, sample_id, row_number() OVER (PARTITION BY object_id ORDER BY sample_id) AS position FROM {obs} WHERE sample_id % 997 <> 5) AS b USING (object_id, position) WHERE a.sample_id IS DISTINCT FROM b.sample_id")
def i09_check_order(s, d):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("object_id").orderBy("sample_id")).alias("position")
    obs = proxy(s, d, "obs")
    a, b = obs.select("object_id", "sample_id", at), obs.where("sample_id % 997 <> 5").select("object_id", "sample_id", at)
    return I.check_order(a, b, "object_id", "position", "sample_id")


_WANTED = "['click', 'error', 'purchase', 'view']"


@query(f"SELECT sample, array_to_string([w FOR w IN {_WANTED} IF NOT list_contains(seen, w)], ',') AS missing, CASE WHEN list_contains(seen, 'signup') THEN 'signup' ELSE '' END AS extra FROM (SELECT event_id // 20 AS sample, list(DISTINCT event_type) AS seen FROM events GROUP BY 1) AS x WHERE missing <> '' OR extra <> ''")
def i10_check_file_sets(s, d):
    files = proxy(s, d, "events").select(F.expr("event_id div 20").alias("sample"), "event_type")
    return I.check_file_sets(files, "sample", "event_type", ["click", "error", "purchase", "view"])


@query("SELECT sample_id, seed, arm, new_value, value AS old_value FROM (SELECT *, CASE WHEN sample_id % 9 = 0 THEN value + 0.5 WHEN sample_id % 9 = 1 THEN NULL ELSE value + 0.0000001 END AS new_value FROM {pairs}) AS x WHERE sample_id % 9 < 2")
def i11_check_parity(s, d):
    old = proxy(s, d, "pairs").select("sample_id", "seed", "arm", "value")
    k = F.col("sample_id") % 9
    new = old.withColumn("value", F.when(k == 0, F.col("value") + 0.5).when(k != 1, F.col("value") + 1e-7))
    return I.check_parity(new, old, ["sample_id", "seed", "arm"], "value", 1e-6)


@query("SELECT conv_id, count(*) AS steps, min(gap) AS first_gap, count(DISTINCT turn) AS distinct_steps, min(gap) IS NULL AND count(*) = count(DISTINCT turn) AS continuous FROM (SELECT conv_id, turn, CASE WHEN coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) + 1 <> turn THEN coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) + 1 END AS gap FROM conversations WHERE (conv_id + turn) % 11 <> 3) AS x GROUP BY 1")
def i12_check_step_log(s, d):
    return I.check_step_log(proxy(s, d, "conversations").where("(conv_id + turn) % 11 <> 3"), "conv_id", "turn", 0)


@query("SELECT count(*) AS steps, round(max(abs(v - w)), 6) AS max_diff, round(avg(abs(v - w)), 6) AS mean_diff, bool_and(v = w) AS identical FROM (SELECT event_id, value AS v, CASE WHEN event_id % 100 = 0 THEN value + 1 ELSE value END AS w FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events)) AS x")
def i13_compare_prefix(s, d):
    a = proxy(s, d, "events")
    half = a.agg(F.expr("max(event_id) div 2").alias("half"))  # the second run stopped half-way
    b = a.join(F.broadcast(half), F.col("event_id") <= F.col("half")).withColumn("value", F.when(F.expr("event_id % 100 = 0"), F.col("value") + 1).otherwise(F.col("value")))
    return r6(I.compare_prefix(a, b, "event_id", "value"))


@query("SELECT vec_id, unnest(CASE WHEN vec_id % 7 = 0 THEN ['embedding is missing', 'embedding has another length', 'embedding is not finite', 'embedding is negative'] WHEN list_min(embedding) < 0 THEN ['embedding is negative'] ELSE [] END) AS violation FROM embeddings")
def i14_audit_cache(s, d):
    e = proxy(s, d, "embeddings").withColumn("embedding", F.when(F.expr("vec_id % 7 <> 0"), F.col("embedding")))
    return I.audit_cache(e, "vec_id", {"embedding": ("float", 64)})


@query("SELECT a.sample_id, count(*) FILTER (a.r <> b.r OR a.g <> b.g OR a.b <> b.b) AS mismatches, count(*) AS pixels FROM {px} AS a JOIN {edit} AS b USING (sample_id, v, u) GROUP BY 1")
def i15_check_pixels(s, d):
    return I.check_pixels(proxy(s, d, "px"), proxy(s, d, "edit"), "sample_id", ["r", "g", "b"])


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'reflection' WHEN 2 THEN 'shear' WHEN 3 THEN 'non_uniform_scale' WHEN 4 THEN 'singular' ELSE 'scale_drift' END AS verdict FROM part")
def i16_classify_transform(s, d):
    k = F.col("p_partkey") % 6
    sc = F.when(k == 5, 3.0).otherwise(2.0)
    m = {"m0": sc, "m1": F.when(k == 2, 0.5).otherwise(0.0), "m2": F.lit(0.0), "m3": F.lit(1.0), "m4": F.lit(0.0), "m5": F.when(k == 3, 2.5).otherwise(sc), "m6": F.lit(0.0), "m7": F.lit(0.0), "m8": F.lit(0.0), "m9": F.lit(0.0), "m10": F.when(k == 1, -sc).when(k == 4, 0.0).otherwise(sc), "m11": F.lit(0.0)}
    df = proxy(s, d, "part").withColumns({**m, "declared": F.lit(2.0)})
    return I.classify_transform(df, list(m), "declared").select("p_partkey", "verdict")


@query("SELECT text AS sha, count(DISTINCT lang) AS roles FROM (SELECT sha256_text AS text, source AS lang FROM {manifest}) AS x GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def h01_disjoint(s, d):
    return I.disjoint(proxy(s, d, "manifest").select(F.col("source").alias("role"), F.col("sha256_text").alias("sha")), "role", "sha")


@query("SELECT 'customer' AS source, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def h02_union_sources(s, d):
    c = proxy(s, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return I.union_sources(c, proxy(s, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")))


@query("SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0) UNION ALL SELECT DISTINCT -doc_id, 'extra' FROM labels WHERE doc_id % 3 = 0 AND doc_id > 0")
def h03_coverage(s, d):
    have = proxy(s, d, "labels").select(F.when(F.expr("doc_id % 3 = 0"), -F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id")).where("doc_id <> 0")
    return I.coverage(proxy(s, d, "documents"), have, "doc_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def h04_last_by_key(s, d):
    return I.last_by_key(proxy(s, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def u01_duplicates(s, d):
    return I.duplicates(proxy(s, d, "lineitem"), "l_orderkey", "l_linenumber")


# ---- rules


@query("SELECT sample_id FROM {obs} WHERE pixels >= 512 AND vis >= 0.1")
def p01_eligible(s, d):
    return P.eligible(proxy(s, d, "obs"), "pixels", "vis").select("sample_id")


@query("SELECT CASE WHEN vis < 0.4 THEN 'low' WHEN vis < 0.7 THEN 'medium' ELSE 'high' END AS bin, count(*) AS n FROM {obs} GROUP BY 1")
def p02_visibility_bin(s, d):
    return proxy(s, d, "obs").groupBy(P.visibility_bin("vis").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN pixels < 512 THEN 'pixels' WHEN vis < 0.1 THEN 'hidden' WHEN object_id % 5 = 0 THEN 'excluded' ELSE 'kept' END AS reason, count(*) AS n FROM {obs} GROUP BY 1")
def p03_reject_first(s, d):
    kept, n = P.reject_first(proxy(s, d, "obs"), {"pixels": F.col("pixels") < 512, "hidden": F.col("vis") < 0.1, "excluded": F.col("object_id") % 5 == 0})
    return n.unionByName(kept.agg(F.lit("kept").alias("reason"), F.count("*").alias("n")))


@query("SELECT reason, count(*) AS n FROM (SELECT 'pixels' AS reason FROM {obs} WHERE pixels < 512 UNION ALL SELECT 'hidden' FROM {obs} WHERE vis < 0.1 UNION ALL SELECT 'excluded' FROM {obs} WHERE object_id % 5 = 0) AS x GROUP BY 1")
def p04_reject_all(s, d):
    return P.reason_histogram(P.reject_all(proxy(s, d, "obs"), {"pixels": F.col("pixels") < 512, "hidden": F.col("vis") < 0.1, "excluded": F.col("object_id") % 5 == 0}))


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size % 3 <> 0 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def p05_catalog_candidates(s, d):
    rows = proxy(s, d, "part").withColumn("cats", F.when(F.col("p_size") % 3 == 0, F.array("p_type", F.lit("other"))).otherwise(F.array("p_type")))
    ex = proxy(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return P.catalog_candidates(rows, "cats", "PROMO", "p_brand", ["Brand#1", "Brand#2", "Brand#3"], ex, "p_partkey").select("p_partkey")


@query("SELECT asset FROM {assets} WHERE (family, category) NOT IN (SELECT family, category FROM {assets} WHERE pilot)")
def p06_exclude_families(s, d):
    rows = proxy(s, d, "assets").withColumn("fam", F.struct("family", "category"))
    return P.exclude_families(rows, "fam", F.col("pilot")).select("asset")


@query("SELECT user_id, bool_and(value > 1) AND count(*) = 40 AS passed, count(*) AS trials FROM events GROUP BY 1")
def p07_physics_gate(s, d):
    return P.physics_gate(proxy(s, d, "events").withColumn("ok", F.col("value") > 1), "user_id", "ok", 40)


_QUOTAS = {"PROMO": 100, "SMALL": 7, "LARGE": 40}


@query("SELECT asset, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY price DESC, asset) <= CASE category WHEN 'PROMO' THEN 100 WHEN 'SMALL' THEN 7 WHEN 'LARGE' THEN 40 ELSE 0 END THEN 'admitted' ELSE 'reserve' END AS decision FROM {assets}")
def p08_admit_quota(s, d):
    return P.admit_quota(proxy(s, d, "assets"), "category", [F.col("price").desc(), "asset"], _QUOTAS).select("asset", "decision")


@query("SELECT sample_id, CASE WHEN value IS NULL THEN 'input_failure' WHEN value <= 2 AND value * 2 <= 15 THEN 'passed' ELSE 'registration_flag' END AS status FROM {scores}")
def p09_registration_status(s, d):
    rows = proxy(s, d, "scores").withColumn("p95", F.col("value") * 2)
    return rows.select("sample_id", P.registration_status("value", "p95", 2.0, 15.0).alias("status"))


@query("SELECT sample_id, status, n FROM (SELECT sample_id, CASE seed WHEN 0 THEN 'success' WHEN 1 THEN 'empty' ELSE 'failure' END AS status, CASE WHEN value IS NOT NULL THEN CAST(floor(value) AS BIGINT) END AS n FROM {scores}) AS x WHERE NOT coalesce((status = 'success' AND n > 0) OR (status = 'empty' AND n = 0) OR (status = 'failure' AND n IS NULL), false)")
def p10_prediction_status(s, d):
    rows = proxy(s, d, "scores").select("sample_id", F.when(F.col("seed") == 0, "success").when(F.col("seed") == 1, "empty").otherwise("failure").alias("status"), F.floor("value").alias("n"))
    return P.check_prediction_status(rows, "sample_id", "status", "n")


@query("SELECT sample_id, max(x) AS max, round(stddev_pop(x), 6) AS std, round(avg(CASE WHEN x > 3 THEN 1 ELSE 0 END), 6) AS share_above_3, max(x) > 3 AND stddev_pop(x) > 1 AS good FROM (SELECT sample_id, unnest([r, g, b]) AS x FROM {px}) AS y GROUP BY 1")
def p11_rgb_qa(s, d):
    return r6(P.rgb_qa(proxy(s, d, "px"), "sample_id"))


@query("SELECT severity, message, count(*) AS n FROM (SELECT 'error' AS severity, 'too little of the object is visible' AS message FROM {obs} WHERE vis < 0.1 UNION ALL SELECT 'error', 'too few pixels' FROM {obs} WHERE pixels < 200 UNION ALL SELECT 'warning', 'the object fills the frame' FROM {obs} WHERE pixels / 10000.0 > 0.6 UNION ALL SELECT 'warning', 'the object touches the border' FROM {obs} WHERE image_id % 10 = 0) AS x GROUP BY 1, 2")
def p12_validate_scenes(s, d):
    rows = proxy(s, d, "obs").selectExpr("sample_id", "vis AS visible_fraction", "pixels", "pixels / 10000.0D AS fill", "CASE WHEN image_id % 10 = 0 THEN 4 ELSE 0 END AS border", "1 AS frames", "2 AS objects")
    return P.validate_scenes(rows, "sample_id", P.scene_checks()).groupBy("severity", "message").agg(F.count("*").alias("n"))


@query("SELECT sample_id, concat_ws(',', CASE WHEN area / 720.0 < 0.5 THEN 'small' END, CASE WHEN area / 720.0 > 0.9 THEN 'large' END, CASE WHEN border > 0 THEN 'border' END) AS warnings FROM (SELECT sample_id, count(*) AS area, count(*) FILTER (v IN (0, 29) OR u IN (0, 23)) AS border FROM {px} WHERE mask GROUP BY 1) AS x")
def p13_mask_qc(s, d):
    stats = R.mask_stats(proxy(s, d, "px"), height=30, width=24).withColumn("parts", F.lit(1))
    return P.mask_qc(stats, "sample_id", 30, 24, 0.5, 0.9)


@query("SELECT a.sample_id, a.calibrated_silhouette_pass AND (r.decision IS NULL OR r.decision = 'pass') AS accepted, CASE WHEN NOT a.calibrated_silhouette_pass THEN 'source_or_edit_SAM_screen_failed' WHEN r.decision IS NULL THEN 'author_authorized_unreviewed_SAM_eligible' ELSE 'visual_' || r.decision END AS admission_reason FROM {admitted} AS a LEFT JOIN {reviews} AS r USING (sample_id)")
def p14_admission(s, d):
    return P.admission(proxy(s, d, "admitted"), proxy(s, d, "reviews")).select("sample_id", "accepted", "admission_reason")


@query("SELECT event_id, CASE WHEN value > 10 THEN event_type ELSE 'source' END AS effective FROM events")
def p16_effective_source(s, d):
    rows = proxy(s, d, "events").select("event_id", (F.col("value") > 10).alias("ok"), "event_type", F.lit("source").alias("src"))
    return P.effective_source(rows, "ok", "event_type", "src").select("event_id", "effective")


@query("SELECT user_id AS sample_id, coalesce(bool_and(value > 0.1) FILTER (event_type = 'view'), false) AS source_calibrated, coalesce(bool_and(value < 60) FILTER (event_type = 'click'), false) AS edited_raw_screen_pass, coalesce(bool_and(value > 0.1) FILTER (event_type = 'view'), false) AND coalesce(bool_and(value < 60) FILTER (event_type = 'click'), false) AS calibrated_silhouette_pass FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def p17_paired_screen(s, d):
    e = proxy(s, d, "events").where("event_type in ('view', 'click')")
    rows = e.selectExpr("user_id AS sample_id", "CASE event_type WHEN 'view' THEN 'source' ELSE 'edited' END AS condition", "CASE event_type WHEN 'view' THEN value > 0.1 ELSE value < 60 END AS passed")
    return P.paired_screen(rows)


@query("SELECT l_orderkey, count(*) AS objects, count(DISTINCT l_partkey) AS families, count(DISTINCT l_returnflag) AS splits FROM lineitem GROUP BY 1 HAVING count(*) <> 4 OR count(DISTINCT l_partkey) <> 4 OR count(DISTINCT l_returnflag) <> 1")
def p18_scene_guard(s, d):
    return P.scene_guard(proxy(s, d, "lineitem"), "l_orderkey", "l_partkey", "l_returnflag", 4)


@query("SELECT user_id, count(*) AS frames, count(*) FILTER (value > 0.5 AND event_type <> 'error') AS passing, bool_and(value > 0.5 AND event_type <> 'error') AND count(*) = 20 AS passed FROM events GROUP BY 1")
def p19_frame_gate(s, d):
    return P.frame_gate(proxy(s, d, "events"), "user_id", {"value": F.col("value") > 0.5, "type": F.col("event_type") != "error"})


@query("SELECT asset FROM {assets} WHERE size / 50.0 BETWEEN 0.1 AND 0.8 AND price <= 1000")
def p20_size_gate(s, d):
    return P.size_gate(proxy(s, d, "assets").withColumn("extent", F.col("size") / 50), "extent", "price", 0.1, 0.8, 1000).select("asset")


@query("SELECT scene, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type IN ('click', 'error')) AS remove, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type NOT IN ('click', 'error')), '') AS keep, count(*) FILTER (event_type = 'click') = 0 AS audit_agrees FROM (SELECT event_id // 5 AS scene, event_type FROM events) AS x GROUP BY 1 HAVING count(*) FILTER (event_type IN ('click', 'error')) > 0")
def p21_repair_list(s, d):
    sets = proxy(s, d, "events").groupBy(F.expr("event_id div 5").alias("scene")).agg(F.collect_set("event_type").alias("seen"))
    return P.repair_list(sets.withColumn("audit", F.array(F.lit("error"))), ["click", "error"], "scene", "seen", "audit")


# ---- joins


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def j01_join_and_exclude(s, d):
    c = proxy(s, d, "customer")
    good = c.join(c.where("c_acctbal < 0").select("c_custkey"), "c_custkey", "left_anti")
    return proxy(s, d, "orders").join(good, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part AS a JOIN part AS b ON a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 0.5 AND abs(a.p_retailprice - b.p_retailprice) <= 0.5")
def j05_candidate_pairs(s, d):
    rows = proxy(s, d, "part").selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS w", "p_retailprice AS h")
    return J.candidate_pairs(rows, "p_partkey", ["w", "h"], 0.5)


@query("SELECT a.cloud, a.point_id, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) AS distance FROM {even} AS a JOIN {odd} AS b USING (cloud) GROUP BY 1, 2")
def j06_nn_join(s, d):
    b = points(s, d, 1).withColumnRenamed("point_id", "other")
    return r6(N.nn_join(points(s, d, 0), b, ["cloud"], "point_id", "other").select("cloud", "point_id", "distance"))


@query("SELECT a.cloud, a.point_id FROM {even} AS a WHERE EXISTS (SELECT 1 FROM {odd} AS b WHERE a.cloud = b.cloud AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.05)")
def j07_within(s, d):
    return N.within(points(s, d, 0), points(s, d, 1), ["cloud"], 0.05).select("cloud", "point_id")


@query("SELECT a.event_type AS sample_id, a.point, count(*) AS n, round(sum(b.depth), 6) AS total FROM (SELECT event_type, event_id AS point, event_id % 30 AS v, event_id % 24 AS u FROM events) AS a JOIN {px} AS b ON a.event_type = b.sample_id AND b.v BETWEEN a.v - 1 AND a.v + 1 AND b.u BETWEEN a.u - 1 AND a.u + 1 GROUP BY 1, 2")
def j09_patch_join(s, d):
    pts = proxy(s, d, "events").selectExpr("event_type AS sample_id", "event_id AS point", "event_id % 30 AS v", "event_id % 24 AS u")
    return r6(J.patch_join(pts, proxy(s, d, "px"), "sample_id", "point").groupBy("sample_id", "point").agg(F.count("*").alias("n"), F.sum("_v").alias("total")))


@query("SELECT sample_id, seed, object_id, scene_id, max(CASE WHEN arm = 'view' THEN value END) AS \"left\", max(CASE WHEN arm = 'click' THEN value END) AS \"right\", round(max(CASE WHEN arm = 'view' THEN value END) - max(CASE WHEN arm = 'click' THEN value END), 6) AS difference FROM {pairs} WHERE arm IN ('view', 'click') GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT arm) = 2")
def j10_paired(s, d):
    return r6(_paired(s, d))


@query("SELECT l_orderkey, a.key AS key, b.key AS other FROM {boxes} AS a JOIN {boxes} AS b USING (l_orderkey) WHERE a.key < b.key AND a.lo_x <= b.hi_x AND b.lo_x <= a.hi_x AND a.lo_y <= b.hi_y AND b.lo_y <= a.hi_y".replace("{boxes}", "(SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS key, l_quantity - 5 AS lo_x, l_quantity + 5 AS hi_x, l_suppkey - 20 AS lo_y, l_suppkey + 20 AS hi_y FROM lineitem)"))
def j12_aabb_pairs(s, d):
    box = proxy(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber * 1000000L + l_partkey AS key", "l_quantity - 5 AS lo_x", "l_quantity + 5 AS hi_x", "l_suppkey - 20 AS lo_y", "l_suppkey + 20 AS hi_y", "0 AS lo_z", "0 AS hi_z")
    return J.aabb_pairs(box, "l_orderkey", "key")


@query("SELECT DISTINCT p_partkey AS src, m AS dst FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS m FROM part) AS x WHERE p_partkey <> m UNION SELECT l_orderkey, l_partkey FROM lineitem")
def j14_inherit_links(s, d):
    e = proxy(s, d, "lineitem").selectExpr("l_orderkey AS src", "l_partkey AS dst")
    fam = proxy(s, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("fam"), "p_partkey")
    return J.inherit_links(e, fam, "fam", "p_partkey")


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 5 <> 0 THEN n_chars END AS reused FROM documents")
def j15_reuse_prior(s, d):
    m = proxy(s, d, "manifest").withColumn("recipe", F.lit("v1"))
    prior = m.where("doc_id % 5 <> 0").withColumn("recipe", F.when(F.expr("doc_id % 4 = 0"), "v0").otherwise("v1"))
    return J.reuse_prior(m, prior, ["doc_id"], ["sha256_text", "recipe"], "n_chars").select("doc_id", "reused")


# ---- aggregations


@query("SELECT arm, seed, count(*) AS n FROM {scores} GROUP BY 1, 2")
def a01_status_counts(s, d):
    return A.status_counts(proxy(s, d, "scores"), "arm", "seed")


@query("SELECT count(*) FILTER (calibrated_silhouette_pass) AS eligible, count(*) FILTER (source_calibrated) AS calibrated, count(*) AS pairs FROM {admitted}")
def a02_counter_summary(s, d):
    return A.counter_summary(proxy(s, d, "admitted"), {"eligible": F.col("calibrated_silhouette_pass"), "calibrated": F.col("source_calibrated"), "pairs": F.lit(True)})


_OBJECT = "SELECT arm, round(avg(m), 6) AS mean, count(m) AS objects_defined, count(*) AS objects, CAST(sum(dd) AS BIGINT) AS views_defined, CAST(sum(n) AS BIGINT) AS views FROM (SELECT arm, object_id, avg(value) AS m, count(value) AS dd, count(*) AS n FROM {%s} GROUP BY 1, 2) AS x GROUP BY 1"


@query(_OBJECT % "scores")
def a03_object_mean(s, d):
    return r6(A.object_mean(proxy(s, d, "scores"), ["arm"], "object_id", "value"))


@query("SELECT arm, object_id, CASE WHEN count(*) = count(value) THEN round(avg(value), 6) END AS mean, count(*) AS n FROM {scores} GROUP BY 1, 2")
def a04_strict_mean(s, d):
    return r6(A.strict_mean(proxy(s, d, "scores"), ["arm", "object_id"], "value"))


@query("SELECT arm, round(avg(m), 6) AS mean, count(m) AS objects FROM (SELECT arm, object_id, avg(v) AS m FROM (SELECT arm, object_id, sample_id, avg(value) AS v FROM {pairs} GROUP BY 1, 2, 3) AS y GROUP BY 1, 2) AS x GROUP BY 1")
def a05_seed_mean(s, d):
    return r6(A.seed_mean(proxy(s, d, "pairs"), ["arm"], "sample_id", "object_id", "value")).select("arm", "mean", F.col("objects_defined").alias("objects"))


@query("SELECT seed, round(avg(m), 6) AS macro_mean, count(m) AS categories FROM (SELECT seed, scene_id, avg(value) AS m FROM {scores} GROUP BY 1, 2) AS x GROUP BY 1")
def a06_category_macro(s, d):
    return r6(A.category_macro(proxy(s, d, "scores"), ["seed"], "scene_id", "value"))


@query("SELECT arm, count(*) FILTER (value > 10) AS positive, count(*) FILTER (value < 10) AS negative, count(*) FILTER (value = 10) AS ties FROM {scores} GROUP BY 1")
def a07_sign_counts(s, d):
    return A.sign_counts(proxy(s, d, "scores").withColumn("value", F.col("value") - 10), ["arm"], "value")


@query("SELECT arm, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM {scores} GROUP BY 1")
def a08_quantiles(s, d):
    return r6(A.quantiles(proxy(s, d, "scores"), ["arm"], "value", {"median": 0.5, "p95": 0.95}))


@query("SELECT arm, round(median(value), 6) AS median, round(mad(value), 6) AS mad FROM {scores} GROUP BY 1")
def a09_mad(s, d):
    return r6(A.mad(proxy(s, d, "scores"), ["arm"], "value"))


@query("SELECT cloud, round(max(x) - min(x), 6) AS size_x, round(max(y) - min(y), 6) AS size_y, round(max(z) - min(z), 6) AS size_z, round((max(x) + min(x)) / 2, 6) AS centre_x, round((max(y) + min(y)) / 2, 6) AS centre_y, round((max(z) + min(z)) / 2, 6) AS centre_z, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2), 6) AS diagonal FROM {points} GROUP BY 1")
def a10_extents(s, d):
    return r6(A.extents(points(s, d), ["cloud"]))


@query("SELECT population, seed, round(avg(m), 6) AS mean, count(*) AS objects FROM (SELECT population, seed, object_id, avg(value) AS m FROM (SELECT 'all' AS population, * FROM {scores} UNION ALL SELECT 'views', * FROM {scores} WHERE arm = 'view' UNION ALL SELECT 'low scenes', * FROM {scores} WHERE scene_id < 5) AS y GROUP BY 1, 2, 3) AS x GROUP BY 1, 2")
def a11_summary_cube(s, d):
    pops = {"all": F.lit(True), "views": F.col("arm") == "view", "low scenes": F.col("scene_id") < 5}
    return r6(A.summary_cube(proxy(s, d, "scores"), pops, ["seed"], "object_id", "value")).select("population", "seed", "mean", "objects")


@query("SELECT arm, seed, count(value) AS n, round(avg(value), 6) AS mean, CAST(GROUPING(arm) * 2 + GROUPING(seed) AS BIGINT) AS level FROM {scores} GROUP BY CUBE (arm, seed)")
def a11_margins(s, d):
    return r6(A.margins(proxy(s, d, "scores"), ["arm", "seed"], "value"))


@query("SELECT arm, round(sum(value / (1 + seed)) / sum(CASE WHEN value IS NOT NULL THEN 1.0 / (1 + seed) END), 6) AS ratio FROM {scores} GROUP BY 1")
def a12_weighted_ratio(s, d):
    return r6(A.weighted_ratio(proxy(s, d, "scores").withColumn("w", 1 / (1 + F.col("seed"))), ["arm"], "value", "w"))


@query("SELECT l.arm, l.scene_id, round(avg(m), 6) AS mean, count(m) AS objects FROM (SELECT q.arm, q.scene_id, c.object_id, avg(c.value) AS m FROM (SELECT DISTINCT arm, scene_id FROM {scores}) AS q JOIN {scores} AS c ON q.arm = c.arm AND q.scene_id <> c.scene_id GROUP BY 1, 2, 3) AS l GROUP BY 1, 2")
def a13_leave_one_out(s, d):
    return r6(A.leave_one_out(proxy(s, d, "scores"), ["arm"], "scene_id", "object_id", "value"))


@query("SELECT family, string_agg(CAST(asset AS VARCHAR), ',' ORDER BY asset) AS members, count(*) AS n_members, sha256(string_agg(CAST(asset AS VARCHAR), chr(10) ORDER BY asset)) AS family_id FROM {assets} GROUP BY 1")
def a14_family_rollup(s, d):
    return A.family_rollup(proxy(s, d, "assets"), "family", "asset")


@query("SELECT seed, arm, count(*) AS exposures, count(*) FILTER (sample_id % 2 = 0) AS attempts, count(*) FILTER (sample_id % 6 = 0) AS effective, round(avg(value) FILTER (sample_id % 6 = 0), 6) AS mean_changed FROM {scores} GROUP BY 1, 2")
def a15_exposure_totals(s, d):
    rows = proxy(s, d, "scores").withColumns({"a": F.col("sample_id") % 2 == 0, "e": F.col("sample_id") % 6 == 0})
    return r6(A.exposure_totals(rows, ["seed", "arm"], "a", "e", "value"))


@query("SELECT scene_id, min(s) AS samples, min(o) AS objects, min(s) = max(s) AND min(o) = max(o) AS equal FROM (SELECT scene_id, arm, count(DISTINCT sample_id) AS s, count(DISTINCT object_id) AS o FROM {scores} GROUP BY 1, 2) AS x GROUP BY 1")
def a16_subset_coverage(s, d):
    return A.subset_coverage(proxy(s, d, "scores"), "scene_id", "arm", "sample_id", "object_id")


@query("SELECT scene_id, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, count(value) AS defined, count(*) AS n FROM {scores} GROUP BY 1")
def a17_distance_summary(s, d):
    return r6(A.distance_summary(proxy(s, d, "scores"), ["scene_id"], "value"))


@query("SELECT accepted, count(*) AS geometries FROM (SELECT object_id, count(*) FILTER (value > 20) AS accepted FROM {scores} GROUP BY 1) AS x GROUP BY 1")
def a18_accept_histogram(s, d):
    return A.accept_histogram(proxy(s, d, "scores"), "object_id", F.col("value") > 20)


@query("SELECT run, round(median(seconds), 6) AS median_s, round(sum(seconds) / 3600, 6) AS hours, max(bytes) AS peak FROM {curves} GROUP BY 1")
def a19_run_telemetry(s, d):
    return r6(A.run_telemetry(proxy(s, d, "curves"), ["run"], "seconds", "bytes"))


@query("SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess FROM (SELECT count(*) AS n FROM {manifest} GROUP BY sha256_text HAVING count(*) > 1) AS x")
def a20_duplicate_excess(s, d):
    return A.duplicate_excess(proxy(s, d, "manifest"), "sha256_text")


@query("SELECT arm, round(median(m), 6) AS median, count(*) AS samples FROM (SELECT arm, object_id, median(value) AS m FROM {scores} GROUP BY 1, 2) AS x GROUP BY 1")
def a21_median_across(s, d):
    return r6(A.median_across(proxy(s, d, "scores"), ["arm"], "object_id", "value"))


@query("SELECT run, step, loss AS value FROM (SELECT run, step, loss, row_number() OVER (PARTITION BY run ORDER BY loss, step) AS n FROM {curves}) AS x WHERE n = 1")
def a22_best_step(s, d):
    return A.best_step(proxy(s, d, "curves"), ["run"], "step", "loss")


@query("SELECT arm, count(DISTINCT object_id) AS objects, count(DISTINCT scene_id) AS scenes FROM {scores} GROUP BY 1")
def a23_distinct_counts(s, d):
    return A.distinct_counts(proxy(s, d, "scores"), ["arm"], {"objects": "object_id", "scenes": "scene_id"})


# ---- windows, orders, limits


@query(f"SELECT object_id, sample_id, rank FROM (SELECT object_id, sample_id, row_number() OVER (PARTITION BY object_id ORDER BY {_h('pick', 'sample_id')}, sample_id) AS rank FROM {{obs}}) AS x WHERE rank <= 5")
def w01_hash_topk(s, d):
    return W.hash_topk(proxy(s, d, "obs"), ["object_id"], "sample_id", "pick", 5).select("object_id", "sample_id", "rank")


@query()
def w02_spaced_select(s, d):
    rows = proxy(s, d, "obs").withColumn("visibility_bin", P.visibility_bin("vis")).withColumn("rank", X.hash_rank("spaced", "scene_id", "image_id", "sample_id", "object_id"))
    return W.spaced_select(P.eligible(rows, "pixels", "vis"))


@query("SELECT object_id, sample_id, unnest(CASE WHEN i <= ceil(n / 3.0) AND i > n - ceil(n / 3.0) THEN ['relative-low', 'relative-high'] WHEN i <= ceil(n / 3.0) THEN ['relative-low'] WHEN i > n - ceil(n / 3.0) THEN ['relative-high'] ELSE [] END) AS stratum FROM (SELECT object_id, sample_id, row_number() OVER (PARTITION BY object_id ORDER BY vis, sample_id) AS i, count(*) OVER (PARTITION BY object_id) AS n FROM {obs}) AS x")
def w03_relative_thirds(s, d):
    return W.relative_thirds(proxy(s, d, "obs"), ["object_id"], ["vis", "sample_id"]).select("object_id", "sample_id", "stratum")


@query(f"WITH t AS (SELECT *, {_h('pair', 'sample_id')} AS h, row_number() OVER (PARTITION BY object_id ORDER BY vis, sample_id) AS i, count(*) OVER (PARTITION BY object_id) AS n FROM {{obs}}), low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY h) AS k FROM t WHERE i <= ceil(n / 3.0)) AS x WHERE k = 1), high AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY t.object_id ORDER BY CASE WHEN t.scene_id = low.scene_id THEN 1 ELSE 0 END, t.h) AS k FROM t JOIN low USING (object_id) WHERE t.i > t.n - ceil(t.n / 3.0) AND (t.scene_id <> low.scene_id OR t.image_id <> low.image_id)) AS x WHERE k = 1) SELECT object_id, 'relative-low' AS stratum, sample_id FROM low UNION ALL SELECT object_id, 'relative-high', sample_id FROM high")
def w04_pair_select(s, d):
    rows = W.relative_thirds(proxy(s, d, "obs"), ["object_id"], ["vis", "sample_id"]).withColumn("h", X.hash_rank("pair", "sample_id"))
    return W.pair_select(rows, "object_id", "scene_id", "image_id", "h").select("object_id", "stratum", "sample_id")


@query("SELECT object_id, sample_id FROM (SELECT object_id, sample_id, row_number() OVER (PARTITION BY object_id ORDER BY pixels DESC, sample_id) AS n FROM {obs}) AS x WHERE n <= 4")
def w05_top_views(s, d):
    return W.top_views(proxy(s, d, "obs"), ["object_id"], "pixels", "sample_id", 4).select("object_id", "sample_id")


@query("WITH a AS (SELECT p_type AS split, p_brand || '/' || p_size AS digest, p_retailprice AS w, p_partkey AS k FROM part), one AS (SELECT *, row_number() OVER (PARTITION BY split, digest ORDER BY w, k) AS n FROM a), x1 AS (SELECT * FROM one WHERE split = 'PROMO' AND n = 1 ORDER BY w, k LIMIT 60), x2 AS (SELECT * FROM one WHERE split = 'SMALL' AND n = 1 AND digest NOT IN (SELECT digest FROM x1) ORDER BY w, k LIMIT 60), x3 AS (SELECT * FROM one WHERE split = 'LARGE' AND n = 1 AND digest NOT IN (SELECT digest FROM x1 UNION ALL SELECT digest FROM x2) ORDER BY w, k LIMIT 60) SELECT split, k FROM x1 UNION ALL SELECT split, k FROM x2 UNION ALL SELECT split, k FROM x3")
def w06_lightest_unique(s, d):
    rows = proxy(s, d, "part").selectExpr("p_type AS split", "concat(p_brand, '/', p_size) AS digest", "p_retailprice AS w", "p_partkey AS k")
    return W.lightest_unique(rows, "split", "digest", "w", "k", {"PROMO": 60, "SMALL": 60, "LARGE": 60}).select("split", "k")


@query("SELECT object_id, sample_id FROM (SELECT object_id, sample_id, row_number() OVER (PARTITION BY object_id ORDER BY sample_id) - 1 AS i, count(*) OVER (PARTITION BY object_id) AS n FROM {obs}) AS x WHERE n <= 10 OR i IN (SELECT CAST(floor((j + 0.5) * n / 10) AS BIGINT) FROM range(10) AS r(j))")
def w07_midpoint_strata(s, d):
    return W.midpoint_strata(proxy(s, d, "obs"), ["object_id"], ["sample_id"], 10).select("object_id", "sample_id")


_APPORTION = "SELECT category, size, f + CASE WHEN rank <= 146 - sum(f) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT *, row_number() OVER (ORDER BY round(dd - f, 12) DESC, " + _h("split", "category") + ") AS rank FROM (SELECT category, size, 146 * size / CAST(sum(size) OVER () AS DOUBLE) AS dd, CAST(floor(146 * size / CAST(sum(size) OVER () AS DOUBLE)) AS BIGINT) AS f FROM (SELECT category, count(*) AS size FROM {assets} GROUP BY 1) AS z) AS y) AS x"


@query("SELECT category, size, CAST(quota AS BIGINT) AS quota FROM (" + _APPORTION + ") AS q")
def w08_apportion(s, d):
    strata = proxy(s, d, "assets").groupBy("category").agg(F.count("*").alias("size"))
    return W.apportion(strata, "category", "size", 146, "split")


@query(f"SELECT category, asset, row_number() OVER (PARTITION BY category ORDER BY {_h('split', 'asset')}, asset) - 1 AS admission_priority FROM {{assets}}")
def w09_priority(s, d):
    return W.priority(proxy(s, d, "assets"), ["category"], "asset", "split").select("category", "asset", F.col("admission_priority").cast("long"))


@query(f"SELECT category, asset FROM (SELECT category, asset, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN pilot THEN 1 ELSE 0 END DESC, {_h('quota', 'asset')}, asset) AS n FROM {{assets}}) AS x WHERE n <= length(category) * 3")
def w10_quota_topk(s, d):
    rows = proxy(s, d, "assets")
    quotas = rows.select("category").distinct().withColumn("quota", F.length("category") * 3)
    return W.quota_topk(rows, "category", "asset", F.col("pilot"), quotas, "quota").select("category", "asset")


@query("SELECT family, asset FROM (SELECT family, asset, row_number() OVER (PARTITION BY family ORDER BY CASE WHEN category = 'PROMO' THEN 1 ELSE 0 END DESC, asset) AS n FROM {assets}) AS x WHERE n = 1")
def w11_representative(s, d):
    return W.representative(proxy(s, d, "assets"), "family", F.col("category") == "PROMO", "asset").select("family", "asset")


@query("SELECT user_id, event_id, frame_no FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no FROM events) AS x WHERE frame_no <= 20")
def w12_accumulate_frames(s, d):
    return W.accumulate_frames(proxy(s, d, "events"), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id", "frame_no")


@query("SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS exposure FROM events")
def w13_exposure_ordinal(s, d):
    return W.exposure_ordinal(proxy(s, d, "events").select("event_type", "user_id", "event_id"), "event_type", "user_id", "event_id")


@query("SELECT event_type, c AS checkpoint, user_id, count(*) AS n FROM events, (SELECT unnest([500, 1000, 2000]) AS c) AS p WHERE event_id <= c GROUP BY 1, 2, 3")
def w14_running_balance(s, d):
    return W.running_balance(proxy(s, d, "events"), "event_type", "user_id", "event_id", [500, 1000, 2000])


@query("WITH s AS (SELECT sample_id, step FROM (SELECT sample_id, round(depth - lag(depth) OVER (PARTITION BY sample_id ORDER BY depth), 12) AS step FROM (SELECT DISTINCT sample_id, depth FROM {px} WHERE mask AND depth > 0) AS y) AS x WHERE step > 0.0000001) SELECT sample_id, round(median(step), 6) AS quantum, count(*) AS steps FROM s JOIN (SELECT sample_id, quantile_cont(step, 0.1) AS q FROM s GROUP BY 1) AS l USING (sample_id) WHERE step <= round(1.5 * q, 12) GROUP BY 1")
def w15_depth_quantum(s, d):
    return r6(W.depth_quantum(proxy(s, d, "px"), ["sample_id"], "depth"))


@query("SELECT arm, slot, sample_id FROM (SELECT arm, CAST(slot AS DOUBLE) AS slot, sample_id, row_number() OVER (PARTITION BY arm, slot ORDER BY round(abs(pr - slot), 12), sample_id) AS n FROM (SELECT arm, sample_id, percent_rank() OVER (PARTITION BY arm ORDER BY value, sample_id) AS pr FROM {scores} WHERE value IS NOT NULL) AS y, (SELECT unnest([0.25, 0.75]) AS slot) AS q) AS x WHERE n = 1")
def w16_quantile_slots(s, d):
    return W.quantile_slots(proxy(s, d, "scores"), ["arm"], "value", "sample_id").select("arm", "slot", "sample_id")


@query("SELECT arm, sample_id, rank FROM (SELECT arm, sample_id, row_number() OVER (PARTITION BY arm ORDER BY round(abs(value - m), 12) NULLS LAST, sample_id) AS rank FROM (SELECT *, median(value) OVER (PARTITION BY arm) AS m FROM {scores}) AS y) AS x")
def w17_median_order(s, d):
    return W.median_order(proxy(s, d, "scores"), ["arm"], "value", "sample_id").select("arm", "sample_id", "rank")


@query("SELECT DISTINCT arm, value, round(cume_dist() OVER (PARTITION BY arm ORDER BY value), 6) AS share FROM {scores} WHERE value IS NOT NULL")
def w18_ecdf(s, d):
    return r6(W.ecdf(proxy(s, d, "scores"), ["arm"], "value").select("arm", "value", "share"))


@query(f"SELECT object_id, sample_id FROM (SELECT object_id, sample_id, row_number() OVER (PARTITION BY object_id ORDER BY {_h('canary', 'sample_id')}, sample_id) AS n FROM {{obs}} WHERE object_id IN (SELECT object_id FROM (SELECT DISTINCT object_id FROM {{obs}}) AS o ORDER BY {_h('canary', 'object_id')}, object_id LIMIT 8)) AS x WHERE n = 1")
def w19_canary(s, d):
    return W.canary(proxy(s, d, "obs"), "object_id", "sample_id", "canary", 8).select("object_id", "sample_id")


@query("SELECT object_id, min(sample_id) AS sample_id FROM {obs} WHERE pixels > 2000 GROUP BY 1 ORDER BY 1 LIMIT 12")
def w20_first_eligible(s, d):
    return W.first_eligible(proxy(s, d, "obs").where("pixels > 2000"), "object_id", "sample_id", 12)


@query(f"SELECT o, sample_id, ordinal, {_h('batch', 'ordinal')} AS ordinal_hash FROM (SELECT object_id AS o, sample_id, row_number() OVER (ORDER BY object_id, sample_id) - 1 AS ordinal FROM {{obs}}) AS x")
def w21_global_ordinal(s, d):
    return W.global_ordinal(proxy(s, d, "obs").selectExpr("object_id AS o", "sample_id"), "o", "sample_id", "batch")


@query(f"SELECT asset FROM {{assets}} ORDER BY category, size, {_h('order', 'asset')}, asset LIMIT 40 OFFSET 100")
def o02_batch_slice(s, d):
    rows = proxy(s, d, "assets").withColumn("h", X.hash_rank("order", "asset"))
    return W.batch_slice(rows, ["category", "size", "h", "asset"], 100, 40).select("asset")


@query(f"SELECT cloud, point_id FROM (SELECT cloud, point_id, row_number() OVER (PARTITION BY cloud ORDER BY {_h('point-selection', chr(39) + chr(39) + ' || cloud || ' + chr(39) + '/' + chr(39) + ' || point_id')}, point_id) AS n FROM {{points}}) AS x WHERE n <= 20")
def o03_point_budget(s, d):
    return W.point_budget(points(s, d), ["cloud"], "point_id", 20).select("cloud", "point_id")


@query("SELECT arm, CAST(least(16384, coalesce(min(CASE WHEN n >= 45 THEN n END), 45)) AS BIGINT) AS cap FROM (SELECT arm, object_id, count(*) AS n FROM {scores} GROUP BY 1, 2) AS x GROUP BY 1")
def o04_shared_cap(s, d):
    n = proxy(s, d, "scores").groupBy("arm", "object_id").agg(F.count("*").alias("n"))
    return W.shared_cap(n, ["arm"], "n", 45)


# ---- scalar functions


@query(f"SELECT event_id, {_h('seed', 'event_id')} AS rank, CAST(CAST('0x' || substr({_h('seed', 'event_id')}, 1, 16) AS UHUGEINT) AS DECIMAL(20, 0)) AS seed64, {_u('seed', 'event_id')} AS uniform, sha256(event_type || chr(0) || user_id) AS digest FROM events")
def f01_hash_draws(s, d):
    return proxy(s, d, "events").select("event_id", X.hash_rank("seed", "event_id").alias("rank"), X.stable_seed("seed", "event_id").alias("seed64"), X.hash_uniform("seed", "event_id").alias("uniform"), X.selection_digest("event_type", "user_id").alias("digest"))


@query("SELECT event_id, printf('%06d_%06d_000007', user_id, event_id) AS target, user_id AS scene_back FROM events")
def f05_target_id(s, d):
    rows = proxy(s, d, "events").select("event_id", X.target_id("user_id", "event_id", F.lit(7)).alias("target"))
    return rows.withColumn("scene_back", X.parse_id("target")["scene_id"])


@query("SELECT page_id, regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS id FROM pages")
def f06_sanitize_id(s, d):
    return proxy(s, d, "pages").select("page_id", X.sanitize_id("url").alias("id"))


@query("SELECT event_id, CAST(round_even(least(value, 10) * 65535 / 10, 0) AS INT) AS code, abs(least(value, 10) - round_even(least(value, 10) * 65535 / 10, 0) * 10 / 65535) <= 10 / 65535.0 / 2 + 1e-12 AS within FROM events WHERE value >= 0")
def f07_depth_codes(s, d):
    v = F.least("value", F.lit(10.0))
    return proxy(s, d, "events").where("value >= 0").select("event_id", X.encode_depth(v).alias("code"), (X.quantisation_error(v) <= 10 / 65535 / 2 + 1e-12).alias("within"))


@query("SELECT cloud, point_id, round(320 + 500 * x / (2 - z), 6) AS u, round(240 - 500 * y / (2 - z), 6) AS v, true AS same FROM {points}")
def f08_project(s, d):
    p = points(s, d).withColumn("z", F.col("z") - 2)
    u, v = X.project("x", "y", "z", 500.0, 500.0, 320.0, 240.0)
    x, y, z = X.unproject(u, v, -F.col("z"), 500.0, 500.0, 320.0, 240.0)
    same = F.greatest(F.abs(x - F.col("x")), F.abs(y - F.col("y")), F.abs(z - F.col("z"))) < 1e-9
    return r6(p.select("cloud", "point_id", u.alias("u"), v.alias("v"), same.alias("same")))


@query("SELECT cloud, point_id, round(y + 1, 6) AS x, round(-x + 2, 6) AS y, round(z + 3, 6) AS z, true AS back, true AS rigid FROM {points}")
def f09_transforms(s, d):
    m = [F.lit(float(v)) for v in (0, 1, 0, 1, -1, 0, 0, 2, 0, 0, 1, 3)]
    p = points(s, d)
    t = X.transform_points(m, "x", "y", "z")
    back = X.transform_points(X.compose(X.invert_rigid(m), m), "x", "y", "z")
    same = F.greatest(*[F.abs(b - F.col(a)) for a, b in zip("xyz", back)]) < 1e-9
    return r6(p.select("cloud", "point_id", *[c.alias(a) for a, c in zip("xyz", t)], same.alias("back"), X.is_rigid(m).alias("rigid")))


@query("SELECT count(*) AS n, true AS rotation, true AS back FROM {points} WHERE x * x + y * y + z * z > 0")
def f11_quaternions(s, d):
    p = points(s, d).where("x * x + y * y + z * z > 0")
    r = X.quat_to_matrix(F.lit(0.5), "x", "y", "z")
    m = [v for i in range(3) for v in (*r[3 * i : 3 * i + 3], F.lit(0.0))]
    size = F.sqrt(0.25 + F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    p = p.select("*", F.array(*r).alias("r"), X.is_rigid(m, 1e-9).alias("ok"), size.alias("size"))
    q = X.matrix_to_quat([F.get("r", F.lit(k)) for k in range(9)])
    p = p.withColumn("q", q)
    near = F.greatest(F.abs(F.col("q.w") - 0.5 / F.col("size")), *[F.abs(F.col(f"q.{a}") - F.col(a) / F.col("size")) for a in "xyz"]) < 1e-9
    return p.agg(F.count("*").alias("n"), F.bool_and("ok").alias("rotation"), F.bool_and(near).alias("back"))


@query("SELECT mesh_id, fid, round(area2, 6) AS area2 FROM (SELECT f.mesh_id, f.fid, sqrt(((b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y)) ** 2 + ((b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z)) ** 2 + ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) ** 2) AS area2 FROM {faces} AS f JOIN {vertices} AS a ON f.a = a.vid JOIN {vertices} AS b ON f.b = b.vid JOIN {vertices} AS c ON f.c = c.vid) AS t")
def f13_tri_area(s, d):
    return r6(_tri(s, d).select("mesh_id", "fid", X.tri_area2(*[tuple(f"{k}{a}" for a in "xyz") for k in "abc"]).alias("area2")))


@query("SELECT sample_id, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS fscore FROM (SELECT sample_id, (sample_id % 7) / 7.0 AS p, (sample_id % 5) / 5.0 AS r FROM {scores}) AS x")
def f14_fscore(s, d):
    return r6(proxy(s, d, "scores").select("sample_id", X.fscore(F.col("sample_id") % 7 / 7, F.col("sample_id") % 5 / 5).alias("fscore")))


@query("SELECT count(*) AS n, count(DISTINCT (point_id, variant)) AS kinds FROM {points}, range(48) AS r(variant)")
def f15_axis_variants(s, d):
    return G.axis_variants(points(s, d)).agg(F.count("*").alias("n"), F.count_distinct("point_id", "variant").alias("kinds"))


@query("SELECT sample_id, v, u, CAST(CASE WHEN depth > 0 THEN round_even(255 * (1.1 - least(greatest(depth, 1.0), 1.1)) / (1.1 - 1.0), 0) ELSE 0 END AS INT) AS guide FROM {px}")
def f17_depth_guide(s, d):
    return proxy(s, d, "px").select("sample_id", "v", "u", X.depth_guide("depth", 1.0, 1.1).alias("guide"))


@query("SELECT sample_id, v, u, CASE WHEN mask THEN 128 ELSE r END AS r, CASE WHEN mask THEN 128 ELSE g END AS g, CASE WHEN mask THEN 128 ELSE b END AS b FROM {px}")
def f18_neutral_rgb(s, d):
    return R.neutral_rgb(proxy(s, d, "px")).select("sample_id", "v", "u", "r", "g", "b")


@query("SELECT sample_id, v // 3 AS v, u // 3 AS u, max(CASE WHEN v % 3 = 1 AND u % 3 = 1 THEN depth END) AS depth, bool_and(mask) AND count(*) = 9 AS mask, CAST(round_even(avg(g), 0) AS INT) AS g FROM {px} GROUP BY 1, 2, 3")
def f20_block_downsample(s, d):
    return R.block_downsample(proxy(s, d, "px"), 3, ("g",))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 4 = 0 THEN 'N/D' ELSE printf('%.2f', value / 100 * 100) END AS shown FROM events")
def f21_json_and_format(s, d):
    v = F.when(F.expr("event_id % 4 <> 0"), F.col("value") / 100)
    return proxy(s, d, "events").select("event_id", X.json_at("props", "/k").alias("k"), X.fmt(v).alias("shown"))


@query("SELECT cloud, round((min(x) + max(x)) / 2, 6) AS centre_x, round((min(y) + max(y)) / 2, 6) AS centre_y, round((min(z) + max(z)) / 2, 6) AS centre_z, round(greatest(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2 * 1.1, 0.05), 6) AS half_extent FROM {points} GROUP BY 1")
def f24_model_roi(s, d):
    return r6(V.model_roi(points(s, d), ["cloud"]))


@query("SELECT cloud, point_id, round(x, 6) AS x FROM {points} UNION ALL SELECT cloud, -point_id - 1, round(s - x, 6) FROM {points} JOIN (SELECT cloud, min(x) + max(x) AS s FROM {points} GROUP BY 1) AS b USING (cloud)")
def f25_reflect_cloud(s, d):
    return r6(V.reflect_cloud(points(s, d), ["cloud"], "x").select("cloud", "point_id", "x"))


# ---- pixels


@query("SELECT sample_id, count(*) AS area, min(v) AS v_min, max(v) AS v_max, min(u) AS u_min, max(u) AS u_max, count(*) FILTER (v IN (0, 29) OR u IN (0, 23)) AS border, round(count(*) / CAST((max(v) - min(v) + 1) * (max(u) - min(u) + 1) AS DOUBLE), 6) AS fill, round(sqrt((avg(v) - 14.5) ** 2 + (avg(u) - 11.5) ** 2), 6) AS centre_offset FROM {px} WHERE mask GROUP BY 1")
def r01_mask_stats(s, d):
    return r6(R.mask_stats(proxy(s, d, "px"), height=30, width=24))


_INNER = "SELECT a.sample_id, a.v, a.u FROM (SELECT * FROM {px} WHERE mask) AS a JOIN (SELECT * FROM {px} WHERE mask) AS b ON a.sample_id = b.sample_id AND abs(a.v - b.v) + abs(a.u - b.u) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 5"


@query(_INNER)
def r02_erode(s, d):
    return R.erode(proxy(s, d, "px"))


@query("SELECT a.sample_id, a.v, a.u, round(max(b.depth) - min(b.depth), 6) AS range FROM {px} AS a JOIN {px} AS b ON a.sample_id = b.sample_id AND abs(a.v - b.v) <= 2 AND abs(a.u - b.u) <= 2 GROUP BY 1, 2, 3")
def r03_local_range(s, d):
    return r6(R.local_range(proxy(s, d, "px")))


@query("SELECT a.sample_id, a.v, a.u, round(sum(b.depth) - 4 * any_value(a.depth), 6) + 0.0 AS residual FROM {px} AS a JOIN {px} AS b ON a.sample_id = b.sample_id AND abs(a.v - b.v) + abs(a.u - b.u) = 1 GROUP BY 1, 2, 3 HAVING count(*) = 4")
def r04_laplacian(s, d):
    return r6(R.laplacian(proxy(s, d, "px"), "depth"))


@query("SELECT sample_id, round(avg(CASE WHEN inner_ THEN miss END), 6) AS interior, round(avg(CASE WHEN NOT inner_ THEN miss END), 6) AS boundary FROM (SELECT p.sample_id, i.v IS NOT NULL AS inner_, CASE WHEN p.depth > 0 THEN 0 ELSE 1 END AS miss FROM {px} AS p LEFT JOIN (" + _INNER + ") AS i ON p.sample_id = i.sample_id AND p.v = i.v AND p.u = i.u WHERE p.mask) AS x GROUP BY 1")
def r05_missing_rates(s, d):
    return r6(R.missing_rates(proxy(s, d, "px"), 1))


def _normal(seed: str, key: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_u(seed + '/u', key)})) * cos(2 * pi() * {_u(seed + '/v', key)}))"


def _field_sql(height: int, width: int, sigma: float, seed: str) -> str:
    """Normal draws of the frame, mirrored at its edges and weighted along rows, then columns, by exp(-d^2 / 2 sigma^2)."""
    r = int(4 * sigma + 0.5)
    mirror = lambda c, n: f"CASE WHEN {c} < 0 THEN -1 - {c} WHEN {c} >= {n} THEN {2 * n - 1} - {c} ELSE {c} END"
    draws = f"SELECT sample_id, v, u, {_normal(seed, chr(39).join(['sample_id || ', '/', ' || v || ', '/', ' || u']))} AS f FROM (SELECT DISTINCT sample_id FROM px) AS s, range({height}) AS a(v), range({width}) AS b(u)"
    kernel = f"SELECT k, exp(-0.5 * k * k / {sigma * sigma!r}) / sum(exp(-0.5 * k * k / {sigma * sigma!r})) OVER () AS w FROM range({-r}, {r + 1}) AS q(k)"
    rows = f"SELECT x.sample_id, x.v, x.u, sum(w * y.f) AS f FROM draws AS x, kernel JOIN draws AS y ON y.sample_id = x.sample_id AND y.v = x.v AND y.u = {mirror('(x.u + k)', width)} GROUP BY 1, 2, 3"
    columns = f"SELECT x.sample_id, x.v, x.u, sum(w * y.f) AS field FROM lines AS x, kernel JOIN lines AS y ON y.sample_id = x.sample_id AND y.u = x.u AND y.v = {mirror('(x.v + k)', height)} GROUP BY 1, 2, 3"
    return f"draws AS ({draws}), kernel AS ({kernel}), lines AS ({rows}), field AS ({columns})"


_NOISY = "round_even((depth + 0.002 * depth * depth * " + _normal("depth/noise", "p.sample_id || '/' || p.v || '/' || p.u") + ") / 0.001, 0) * 0.001"


@query(
    "WITH px AS (SELECT * FROM {px} AS raw), " + _field_sql(31, 24, 0.8, "depth/dropout") + ", cut AS (SELECT sample_id, quantile_cont(field, 0.1) AS low, quantile_cont(field, 0.3) AS high FROM field GROUP BY 1) "
    f"SELECT p.sample_id, p.v, p.u, p.mask, p.r, p.g, p.b, round(CASE WHEN p.depth > 0 AND NOT (f.field < CASE WHEN p.mask AND i.v IS NULL THEN c.high ELSE c.low END) THEN {_NOISY} ELSE 0 END, 6) + 0.0 AS depth "
    "FROM px AS p JOIN field AS f ON f.sample_id = p.sample_id AND f.v = p.v AND f.u = p.u JOIN cut AS c ON c.sample_id = p.sample_id LEFT JOIN (" + _INNER + ") AS i ON p.sample_id = i.sample_id AND p.v = i.v AND p.u = i.u"
)
def r06_corrupt_depth(s, d):
    return r6(R.corrupt_depth(proxy(s, d, "px"), 0.002, 0.001, 0.1, 0.3, 31, 24, 0.8).select("sample_id", "v", "u", "mask", "r", "g", "b", "depth"))


@query("SELECT p.sample_id, p.v, p.u, p.depth FROM {px} AS p JOIN (SELECT sample_id, median(depth) AS m FROM {px} WHERE mask AND depth > 0 GROUP BY 1) AS q USING (sample_id) WHERE mask AND depth > 0 AND abs(depth - m) <= 0.004")
def r07_observation_filter(s, d):
    return R.observation_filter(proxy(s, d, "px"), 0.004, 1).select("sample_id", "v", "u", "depth")


# not rounded: many of these values lie half-way between two rounded ones, and both sides do the same operations
@query("SELECT sample_id, v, u, (u - CAST(11.5 AS DOUBLE)) * depth / CAST(20 AS DOUBLE) AS x, (CAST(14.5 AS DOUBLE) - v) * depth / CAST(20 AS DOUBLE) AS y, -depth AS z FROM {px} WHERE depth > 0")
def r08_pixels_to_cloud(s, d):
    return R.pixels_to_cloud(proxy(s, d, "px"), _cams(s, d))


@query("SELECT a.sample_id, round(count(*) FILTER (a.mask AND b.mask) / CAST(count(*) FILTER (a.mask OR b.mask) AS DOUBLE), 6) AS iou FROM {px} AS a JOIN {edit} AS b USING (sample_id, v, u) GROUP BY 1")
def r09_mask_iou(s, d):
    return r6(R.mask_iou(proxy(s, d, "px"), proxy(s, d, "edit")))


_EDGE = "(SELECT sample_id, v, u FROM {X} WHERE mask EXCEPT SELECT a.sample_id, a.v, a.u FROM (SELECT * FROM {X} WHERE mask) AS a JOIN (SELECT * FROM {X} WHERE mask) AS b ON a.sample_id = b.sample_id AND abs(a.v - b.v) + abs(a.u - b.u) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 5)"
_WAY = "SELECT sample_id, round(quantile_cont(dd, 0.95), 6) AS q FROM (SELECT a.sample_id, a.v, a.u, min(sqrt((a.v - b.v) ** 2 + (a.u - b.u) ** 2)) AS dd FROM %s AS a JOIN %s AS b USING (sample_id) GROUP BY 1, 2, 3) AS x GROUP BY 1"
_PXE, _EDE = _EDGE.replace("{X}", "{px}"), _EDGE.replace("{X}", "{edit}")


@query(f"SELECT sample_id, x.q AS a_to_b, y.q AS b_to_a FROM ({_WAY % (_PXE, _EDE)}) AS x JOIN ({_WAY % (_EDE, _PXE)}) AS y USING (sample_id)")
def r10_boundary_p95(s, d):
    return r6(R.boundary_p95(proxy(s, d, "px"), proxy(s, d, "edit")))


@query("SELECT a.sample_id, round(avg(CASE WHEN a.g <> b.g THEN 1.0 ELSE 0 END), 6) AS frame, round(avg(CASE WHEN a.mask THEN CASE WHEN a.g <> b.g THEN 1.0 ELSE 0 END END), 6) AS masked, round(avg(CASE WHEN v BETWEEN 1 AND 28 AND u BETWEEN 5 AND 18 THEN CASE WHEN a.g <> b.g THEN 1.0 ELSE 0 END END), 6) AS model_visible FROM {px} AS a JOIN {edit} AS b USING (sample_id, v, u) GROUP BY 1")
def r11_rgb_changes(s, d):
    a = proxy(s, d, "px").select("sample_id", "v", "u", "mask", *[F.col(c).alias(f"s{c}") for c in "rgb"])
    b = proxy(s, d, "edit").select("sample_id", "v", "u", *[F.col(c).alias(f"e{c}") for c in "rgb"])
    return r6(R.rgb_changes(a.join(b, R.KEY), 24, 30))


@query("SELECT sample_id, round(100 * avg(CASE WHEN mask THEN 1.0 ELSE 0 END), 6) AS occupancy, round(100 * avg(CASE WHEN mask THEN CASE WHEN depth > 0 THEN 0.0 ELSE 1 END END), 6) AS missing FROM {px} GROUP BY 1")
def r12_observation_stats(s, d):
    return r6(R.observation_stats(proxy(s, d, "px")))


@query("SELECT sample_id, v, u, CAST(CASE WHEN depth > 0 THEN round_even(255 * least(greatest((1 / depth - lo) / greatest(hi - lo, 1e-12), 0), 1), 0) ELSE 0 END AS INT) AS grey FROM {px} JOIN (SELECT sample_id, quantile_cont(1 / depth, 0.01) AS lo, quantile_cont(1 / depth, 0.99) AS hi FROM {px} WHERE depth > 0 GROUP BY 1) AS q USING (sample_id)")
def r13_depth_control(s, d):
    return R.depth_control(proxy(s, d, "px")).select("sample_id", "v", "u", "grey")


@query("SELECT c.sample_id, c.v, c.u, CASE WHEN t.mask THEN t.r ELSE c.r END AS r, CASE WHEN t.mask THEN t.g ELSE c.g END AS g FROM {px} AS c LEFT JOIN {edit} AS t USING (sample_id, v, u)")
def r14_composite(s, d):
    return R.composite(proxy(s, d, "edit"), proxy(s, d, "px"), ["r", "g"])


# ---- geometry and graphs


@query()
def g01_sample_surface(s, d):
    return r6(G.sample_surface(_tri(s, d), 2000))


@query("SELECT mesh_id, count(DISTINCT list_sort([CAST(CAST(round_even(k.x * 1000000, 0) AS BIGINT) AS VARCHAR) || ',' || CAST(round_even(k.y * 1000000, 0) AS BIGINT) || ',' || CAST(round_even(k.z * 1000000, 0) AS BIGINT) FOR k IN corners])) AS items FROM (SELECT f.mesh_id, [p1, p2, p3] AS corners FROM {faces} AS f JOIN {vertices} AS p1 ON f.a = p1.vid JOIN {vertices} AS p2 ON f.b = p2.vid JOIN {vertices} AS p3 ON f.c = p3.vid) AS t GROUP BY 1")
def g02_mesh_fingerprint(s, d):
    return G.mesh_fingerprint(_tri(s, d)).select("mesh_id", "items")


@query("SELECT mesh_id, count(DISTINCT (round_even((x - lx) / side * 100000, 0), round_even((y - ly) / side * 100000, 0), round_even((z - lz) / side * 100000, 0))) AS items FROM {vertices}, (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM {vertices}) AS b GROUP BY 1")
def g03_normalized_hash(s, d):
    return G.normalized_hash(proxy(s, d, "vertices")).select("mesh_id", "items")


@query("WITH w AS (SELECT vid, min(vid) OVER (PARTITION BY round_even(x * 1000000, 0), round_even(y * 1000000, 0), round_even(z * 1000000, 0)) AS t FROM {vertices}), f AS (SELECT DISTINCT list_sort([a.t, b.t, c.t]) AS k FROM {faces} AS f JOIN w AS a ON f.a = a.vid JOIN w AS b ON f.b = b.vid JOIN w AS c ON f.c = c.vid WHERE a.t <> b.t AND b.t <> c.t AND a.t <> c.t) SELECT (SELECT count(*) FROM f) AS faces, (SELECT count(DISTINCT v) FROM (SELECT unnest(k) AS v FROM f) AS u) AS vertices")
def g04_clean_mesh(s, d):
    v, f = G.clean_mesh(proxy(s, d, "vertices"), proxy(s, d, "faces"))
    one = F.lit(0).alias("k")
    return f.agg(F.count("*").alias("faces"), one).join(v.agg(F.count("*").alias("vertices"), one), "k").drop("k")


@query("SELECT mesh_id, count(*) FILTER (n = 1) AS boundary_edges, count(*) FILTER (n > 2) AS nonmanifold_edges, count(*) FILTER (n = 2 AND up <> 1) AS inconsistent_edges FROM (SELECT mesh_id, least(p, q) AS lo, greatest(p, q) AS hi, count(*) AS n, sum(CASE WHEN p < q THEN 1 ELSE 0 END) AS up FROM (SELECT mesh_id, a AS p, b AS q FROM {faces} UNION ALL SELECT mesh_id, b, c FROM {faces} UNION ALL SELECT mesh_id, c, a FROM {faces}) AS e GROUP BY 1, 2, 3) AS x GROUP BY 1")
def g05_mesh_topology(s, d):
    return G.mesh_topology(proxy(s, d, "faces"), _tri(s, d)).select("mesh_id", "boundary_edges", "nonmanifold_edges", "inconsistent_edges")


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS c, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, min(o_custkey) OVER (PARTITION BY o_orderdate, o_orderpriority) AS h FROM orders), p AS (SELECT DISTINCT c AS a, h AS b FROM e WHERE c <> h), n AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), r AS (SELECT x AS node, x AS reach FROM n UNION SELECT r.node, n.y FROM r JOIN n ON r.reach = n.x) SELECT node, min(reach) AS component FROM r GROUP BY 1")
def g07_connected_components(s, d):
    from reconlake.operators.graph import connected_components

    o = proxy(s, d, "orders")
    hub = o.groupBy("o_orderdate", "o_orderpriority").agg(F.min("o_custkey").alias("dst"))
    return connected_components(o.join(hub, ["o_orderdate", "o_orderpriority"]).selectExpr("o_custkey AS src", "dst"))


@query()
def g08_pca_normalize(s, d):
    return G.pca_normalize(points(s, d), "cloud")


_CAM_PTS = "(SELECT 'view' AS sample_id, point_id, 0.4 * x AS x, 0.4 * y AS y, -1.01 + 0.01 * z AS z FROM {points})"


_NEAR = "(SELECT q.sample_id, q.point_id, -q.z AS zc, min(p.depth) AS lo, max(p.depth) AS hi FROM (SELECT *, 11.5 + 20 * x / -z AS pu, 14.5 - 20 * y / -z AS pv FROM %s AS t) AS q LEFT JOIN {px} AS p ON p.sample_id = q.sample_id AND p.mask AND p.depth > 0 AND pu >= -0.5 AND pu < 23.5 AND pv >= -0.5 AND pv < 29.5 AND abs(p.v - floor(pv + 0.5)) <= 1 AND abs(p.u - floor(pu + 0.5)) <= 1 GROUP BY 1, 2, 3)" % _CAM_PTS


@query("SELECT sample_id, count(*) FILTER (abs(zc - lo) <= 0.005) AS visible, count(*) FILTER (zc - lo > 0.005) AS occluded, count(*) FILTER (zc - lo < -0.005) AS known_free, count(*) AS points FROM " + _NEAR + " AS n GROUP BY 1")
def g10_visibility_min(s, d):
    out = V.visibility_min(_cam_points(s, d), proxy(s, d, "px"), _cams(s, d))
    return out.groupBy("sample_id").agg(*[F.count_if(c).alias(c) for c in ("visible", "occluded", "known_free")], F.count("*").alias("points"))


@query("SELECT sample_id, CAST(CASE WHEN hi IS NULL THEN 0 WHEN zc > hi + 0.005 THEN 2 ELSE 1 END AS TINYINT) AS label, count(*) AS n FROM " + _NEAR + " AS n GROUP BY 1, 2")
def g11_visibility_max(s, d):
    return V.visibility_max(_cam_points(s, d), proxy(s, d, "px"), _cams(s, d)).groupBy("sample_id", "label").agg(F.count("*").alias("n"))


_FWD = "(SELECT a.cloud, a.point_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS dd FROM {odd} AS a JOIN {even} AS b USING (cloud) GROUP BY 1, 2)"
_BWD = "(SELECT a.cloud, a.point_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS dd FROM {even} AS a JOIN {odd} AS b USING (cloud) GROUP BY 1, 2)"


@query(f"SELECT cloud, round(p, 6) AS precision50, round(r, 6) AS recall50, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS fscore50, round((pm + rm) / 2, 6) AS chamfer FROM (SELECT cloud, avg(CASE WHEN dd <= 0.05 THEN 1.0 ELSE 0 END) AS p, avg(dd) AS pm FROM {_FWD} AS f GROUP BY 1) AS x JOIN (SELECT cloud, avg(CASE WHEN dd <= 0.05 THEN 1.0 ELSE 0 END) AS r, avg(dd) AS rm FROM {_BWD} AS b GROUP BY 1) AS y USING (cloud)")
def g13_score_clouds(s, d):
    out = V.score_clouds(points(s, d, 1), points(s, d, 0), ["cloud"], thresholds=(0.05,), cap=0.2)
    return r6(out.select("cloud", "precision50", "recall50", "fscore50", "chamfer"))


@query(f"SELECT cloud, round(quantile_cont(dd, 0.95) FILTER (f), 6) AS accuracy_p95, round(quantile_cont(dd, 0.95) FILTER (NOT f), 6) AS completeness_p95, round(quantile_cont(dd, 0.95), 6) AS chamfer_p95 FROM (SELECT cloud, dd, true AS f FROM {_FWD} AS a UNION ALL SELECT cloud, dd, false FROM {_BWD} AS b) AS x GROUP BY 1")
def g14_surface_p95(s, d):
    return r6(V.surface_p95(*V.distances(points(s, d, 1), points(s, d, 0), ["cloud"]), ["cloud"]))


@query(f"SELECT cloud, round(avg(CASE WHEN point_id % 3 = 0 THEN CASE WHEN dd <= 0.05 THEN 1.0 ELSE 0 END END), 6) AS recall_visible, count(*) FILTER (point_id % 3 = 0) AS count_visible FROM {_BWD} AS b GROUP BY 1")
def g15_subset_recall(s, d):
    _, back = V.distances(points(s, d, 1), points(s, d, 0), ["cloud"])
    flags = points(s, d, 0).select("cloud", "point_id", (F.col("point_id") % 3 == 0).alias("visible"))
    return r6(V.subset_recall(back, flags, ["cloud"], ["visible"], t=0.05))


@query(f"SELECT cloud, count(*) FILTER (NOT near) AS added, round(avg(CASE WHEN NOT near THEN CASE WHEN dd <= 0.05 THEN 1.0 ELSE 0 END END), 6) AS added_precision FROM (SELECT f.cloud, f.dd, EXISTS (SELECT 1 FROM {{odd}} AS p, {{even}} AS q WHERE p.cloud = f.cloud AND p.point_id = f.point_id AND q.cloud = p.cloud AND sqrt((p.x - q.x - 0.02) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) <= 0.05) AS near FROM {_FWD} AS f) AS x GROUP BY 1")
def g16_added_points(s, d):
    p, t = points(s, d, 1), points(s, d, 0)
    forward, _ = V.distances(p, t, ["cloud"])
    return r6(V.added_points(p, t.withColumn("x", F.col("x") + 0.02), forward, ["cloud"], t=0.05))


@query(f"SELECT cloud, round(avg(dd), 6) AS mean, round(quantile_cont(dd, 0.95), 6) AS p95, round(max(dd), 6) AS max FROM (SELECT cloud, dd FROM {_FWD} AS a UNION ALL SELECT cloud, dd FROM {_BWD} AS b) AS x GROUP BY 1")
def g18_compare_clouds(s, d):
    return r6(V.compare_clouds(points(s, d, 1), points(s, d, 0), ["cloud"]).drop("identical"))


@query("SELECT cloud, point_id, floor(x * 10) % 2 = 0 AND abs(x) < 1 AND abs(y) < 1 AND abs(z) < 1 AS occupied FROM {points}")
def g20_occupancy(s, d):
    p = points(s, d)
    cells = p.select("cloud", *[F.floor((F.col(a) + 1) * 10).alias(f"i{a}") for a in "xyz"]).where("(ix - 10) % 2 = 0").distinct()
    grids = p.select("cloud").distinct().selectExpr("cloud", "-1.0D AS ox", "-1.0D AS oy", "-1.0D AS oz", "0.1D AS voxel", "20 AS nx", "20 AS ny", "20 AS nz")
    return G.occupancy(p, cells, grids, "cloud").select("cloud", "point_id", "occupied")


@query()
def g21_sample_queries(s, d):
    tri = _tri(s, d)
    roi = V.model_roi(proxy(s, d, "vertices"), ["mesh_id"])
    return r6(G.sample_queries(tri, roi, 500, 500, 0.02))


@query(f"SELECT arm, sample_id FROM (SELECT arm, sample_id, row_number() OVER (PARTITION BY arm ORDER BY {_h('mix', 'sample_id')}, sample_id) AS n FROM {{scores}}) AS x WHERE n <= CASE arm WHEN 'view' THEN 50 WHEN 'click' THEN 20 ELSE 0 END")
def g22_query_mix(s, d):
    return G.query_mix(proxy(s, d, "scores"), [], "arm", "sample_id", {"view": 50, "click": 20}).select("arm", "sample_id")


@query("SELECT cloud, round(greatest(0, -min(z - 0.01)), 6) AS penetration, 0.01 AS movement FROM {points} GROUP BY 1")
def g23_settle_checks(s, d):
    p = points(s, d)
    return r6(G.settle_checks(p, p.withColumn("z", F.col("z") - 0.01), ["cloud"], "point_id").select("cloud", "penetration", "movement"))


# distances of each cloud's 9 x 9 x 9 grid nodes to its nearest point
_GRID = "(SELECT cloud AS grid_id, ix, iy, iz, min(sqrt((ix / 4.0 - 1 - x) ** 2 + (iy / 4.0 - 1 - y) ** 2 + (iz / 4.0 - 1 - z) ** 2)) AS udf_m FROM {points}, range(9) AS a(ix), range(9) AS b(iy), range(9) AS c(iz) GROUP BY 1, 2, 3, 4)"


def _grid(s, d) -> DataFrame:
    g = points(s, d).select(F.col("cloud").alias("grid_id")).distinct()
    for a in "xyz":
        g = g.withColumn(f"i{a}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    g = g.withColumns({"node": F.struct("ix", "iy", "iz"), **{a: F.col(f"i{a}") / 4 - 1 for a in "xyz"}})
    near = N.nn_join(g, points(s, d).withColumnRenamed("cloud", "grid_id"), ["grid_id"], "node", "point_id")
    return near.select("grid_id", "node.*", F.col("distance").alias("udf_m"))


@query(f"SELECT a.grid_id, a.ix, a.iy, a.iz FROM {_GRID} AS a JOIN {_GRID} AS b ON a.grid_id = b.grid_id AND b.ix BETWEEN a.ix AND a.ix + 1 AND b.iy BETWEEN a.iy AND a.iy + 1 AND b.iz BETWEEN a.iz AND a.iz + 1 GROUP BY 1, 2, 3, 4 HAVING count(*) = 8 AND bool_or(b.udf_m <= 0.5) AND NOT bool_and(b.udf_m <= 0.5)")
def g24_active_cells(s, d):
    return G.active_cells(_grid(s, d), 0.5)


# ---- statistics, splits, schedules


def _picks(units: str, replicates: int, seed: str) -> str:
    """How often (k) each slot is drawn in each replicate; `units` has a row a slot."""
    draw = f"CAST('0x' || substr(sha256('{seed}/' || replicate || '/0/' || (slot // 8)), 1 + 8 * (slot % 8), 8) AS BIGINT) % units"
    return f"(SELECT replicate, pick, count(*) AS k FROM (SELECT replicate, {draw} AS pick FROM {units}, range({replicates}) AS q(replicate)) AS d GROUP BY 1, 2)"


def _slots(units: str) -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY unit) - 1 AS slot, count(*) OVER () AS units FROM {units})"


def _draw_sql(units: str, num: str, den: str, replicates: int, seed: str) -> str:
    return f"WITH u AS ({units}), n AS {_slots('u')}, m AS (SELECT replicate, sum(k * {num}) / sum(k * {den}) AS m FROM {_picks('n', replicates, seed + '/units')} AS r JOIN n ON r.pick = n.slot GROUP BY 1)"


def _crossed_sql(cells: str, replicates: int, seed: str) -> str:
    slots = ", ".join(f"{x} AS {_slots(f'(SELECT DISTINCT {x} AS unit FROM c)')}" for x in "os")
    picks = f"{_picks('o', replicates, seed + '/units')} AS x JOIN {_picks('s', replicates, seed + '/others')} AS y USING (replicate)"
    means = f"SELECT replicate, sum(x.k * y.k * m) / sum(x.k * y.k) AS m FROM {picks} JOIN o ON o.slot = x.pick JOIN s ON s.slot = y.pick JOIN c ON c.o = o.unit AND c.s = s.unit GROUP BY 1"
    return f"WITH c AS ({cells}), {slots}, m AS ({means}) SELECT round((SELECT avg(m) FROM c), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, (SELECT count(*) FROM o) AS objects, (SELECT count(*) FROM s) AS seeds FROM m"


_DIFF = "(SELECT sample_id, seed, object_id, scene_id, max(CASE WHEN arm = 'view' THEN value END) - max(CASE WHEN arm = 'click' THEN value END) AS difference FROM {pairs} WHERE arm IN ('view', 'click') GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT arm) = 2)"


@query(_draw_sql(f"SELECT object_id AS unit, avg(difference) AS v, count(*) AS c FROM {_DIFF} AS df WHERE difference IS NOT NULL GROUP BY 1", "v", "1.0", 500, "objects") + " SELECT round((SELECT avg(v) FROM u), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, (SELECT count(*) FROM u) AS objects, CAST((SELECT sum(c) FROM u) AS BIGINT) AS observations FROM m")
def t01_bootstrap_objects(s, d):
    return r6(T.bootstrap_objects(_paired(s, d), replicates=500))


@query(_crossed_sql(f"SELECT object_id AS o, seed AS s, avg(difference) AS m FROM {_DIFF} AS df WHERE difference IS NOT NULL GROUP BY 1, 2", 500, "crossed"))
def t02_bootstrap_crossed(s, d):
    return r6(T.bootstrap_crossed(_paired(s, d), replicates=500))


@query(_draw_sql(f"SELECT scene_id AS unit, sum(w * difference) AS num, sum(w) AS den FROM {_DIFF} AS df JOIN (SELECT object_id, 1.0 / count(*) AS w FROM {_DIFF} AS de WHERE difference IS NOT NULL GROUP BY 1) AS p USING (object_id) WHERE difference IS NOT NULL GROUP BY 1", "num", "den", 500, "scenes") + " SELECT round((SELECT sum(num) / sum(den) FROM u), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, (SELECT count(*) FROM u) AS scenes FROM m")
def t03_bootstrap_scenes(s, d):
    return r6(T.bootstrap_scenes(_paired(s, d), replicates=500))


@query(_crossed_sql(f"SELECT o, s, avg(v) AS m FROM (SELECT object_id % 10 AS o, object_id, seed AS s, avg(difference) AS v FROM {_DIFF} AS df GROUP BY 1, 2, 3) AS x WHERE v IS NOT NULL GROUP BY 1, 2", 500, "families"))
def t04_bootstrap_families(s, d):
    rows = _paired(s, d).withColumn("family", F.col("object_id") % 10)
    return r6(T.bootstrap_families(rows, "family", replicates=500))


@query(f"SELECT seed, 'view - click' AS contrast, round(avg(m), 6) AS difference, count(*) AS objects, CAST(sum(n) AS BIGINT) AS samples, count(*) FILTER (m > 0) AS positive, count(*) FILTER (m < 0) AS negative FROM (SELECT seed, object_id, avg(difference) AS m, count(*) AS n FROM {_DIFF} AS df WHERE difference IS NOT NULL GROUP BY 1, 2) AS x GROUP BY 1")
def t05_contrasts(s, d):
    return r6(T.contrasts(proxy(s, d, "pairs"), [("view", "click")], ["seed"], ["sample_id"]))


@query("SELECT a.object_id, round(avg(a.value - b.value), 6) AS effect, count(a.value - b.value) AS defined, count(*) AS samples FROM {pairs} AS a JOIN {pairs} AS b USING (sample_id, seed) WHERE a.arm = 'view' AND b.arm = 'error' GROUP BY 1")
def t06_effects(s, d):
    p = proxy(s, d, "pairs")
    return r6(T.effects(p.where("arm = 'view'"), p.where("arm = 'error'"), ["sample_id", "seed"], "object_id"))


@query("SELECT arm, mean, objects, round(median, 6) AS median, round(p5, 6) AS p5, round(p95, 6) AS p95 FROM (SELECT arm, round(avg(m), 6) AS mean, count(m) AS objects FROM (SELECT arm, object_id, avg(value) AS m FROM {scores} GROUP BY 1, 2) AS x GROUP BY 1) AS a JOIN (SELECT arm, median(value) AS median, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95 FROM {scores} GROUP BY 1) AS b USING (arm)")
def t07_native_changes(s, d):
    return r6(T.native_changes(proxy(s, d, "scores"), ["arm"], "object_id", "value"))


@query("SELECT arm, round(avg(m), 6) AS mean, round(avg(sp), 6) AS spread, count(m) AS objects FROM (SELECT arm, object_id, avg(v) AS m, max(v) - min(v) AS sp FROM (SELECT arm, object_id, seed, avg(value) AS v FROM {scores} GROUP BY 1, 2, 3) AS y GROUP BY 1, 2) AS x GROUP BY 1")
def t08_density_study(s, d):
    return r6(T.density_study(proxy(s, d, "scores"), ["arm"], "object_id", "seed", "value"))


@query("SELECT stratum, arm, round(avg(m), 6) AS mean, count(m) AS objects FROM (SELECT stratum, arm, object_id, avg(value) AS m FROM {scores} JOIN (SELECT event_id AS sample_id, unnest(CASE WHEN event_id % 2 = 0 THEN ['even', 'any'] ELSE ['any'] END) AS stratum FROM events) AS z USING (sample_id) GROUP BY 1, 2, 3) AS x GROUP BY 1, 2")
def t09_strata(s, d):
    sets = proxy(s, d, "events").selectExpr("event_id AS sample_id", "explode(CASE WHEN event_id % 2 = 0 THEN array('even', 'any') ELSE array('any') END) AS stratum")
    return r6(T.strata(proxy(s, d, "scores"), sets, "sample_id", "stratum", ["arm"], "object_id", "value"))


_FREE = "(SELECT * FROM {assets} WHERE name || family NOT IN (SELECT name || family FROM {assets} WHERE pilot))"


@query("WITH free AS (SELECT *, name || family AS fam FROM " + _FREE + " AS z), q AS (" + _APPORTION.replace("{assets}", "free") + "), drawn AS (SELECT DISTINCT fam FROM (SELECT fam, category, row_number() OVER (PARTITION BY category ORDER BY " + _h("split", "asset") + ", asset) AS n FROM free) AS f JOIN q USING (category) WHERE n <= quota), p AS (SELECT asset, CASE WHEN name || family IN (SELECT fam FROM drawn) THEN 'synthetic_validation' ELSE 'train' END AS split_pool FROM {assets}) SELECT asset, split_pool, row_number() OVER (PARTITION BY split_pool ORDER BY " + _h("split", "asset") + ", asset) - 1 AS admission_priority FROM p")
def d01_split_families(s, d):
    rows = proxy(s, d, "assets").withColumn("fam", F.concat("name", "family"))
    out = D.split_families(rows, 146, "split", "fam", "asset", "category")
    return out.select("asset", "split_pool", F.col("admission_priority").cast("long"))


@query("WITH k AS (SELECT asset, category, size > 25 AS base, row_number() OVER (PARTITION BY category, size > 25 ORDER BY " + _h("half", "asset") + ", asset) AS n FROM {assets}), z AS (SELECT category, least(count(*) FILTER (size > 25), count(*) FILTER (size <= 25)) // 2 AS half FROM {assets} GROUP BY 1) SELECT asset, base AND n <= 2 * half AS in_base, n <= half AS in_mix FROM k JOIN z USING (category)")
def d02_half_pools(s, d):
    return D.half_pools(proxy(s, d, "assets"), "category", "asset", F.col("size") > 25, "half").select("asset", "in_base", "in_mix")


@query("WITH i AS (SELECT p_partkey AS sample_id, row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal, count(*) OVER () AS n FROM part), e AS (SELECT *, epoch * n + row_number() OVER (PARTITION BY epoch ORDER BY " + _h("classic/order", "3 || '/' || epoch || '/' || sample_id") + ", sample_id) AS step FROM i, range(4) AS r(epoch)) SELECT step, CAST(epoch AS INT) AS epoch, ordinal, sample_id, (epoch + ordinal) % 2 = 1 AS augmentation_attempt, (epoch + ordinal) % 2 = 1 AND sample_id % 3 = 0 AS effective_augmentation, CAST(CAST('0x' || substr(" + _h("classic", "3 || '/' || step") + ", 1, 16) AS UHUGEINT) AS DECIMAL(20, 0)) AS augmentation_seed FROM e")
def d03_exposure_schedule(s, d):
    ids = proxy(s, d, "part").select(F.col("p_partkey").alias("sample_id"))
    out = D.exposure_schedule(ids, ids.where("sample_id % 3 = 0"), 3)
    return out.select(F.col("step").cast("long"), "epoch", F.col("ordinal").cast("long"), "sample_id", "augmentation_attempt", "effective_augmentation", "augmentation_seed")


@query("WITH c AS (SELECT p_brand AS category, count(*) AS size FROM part GROUP BY 1), y AS (SELECT *, cycle * count(*) OVER (PARTITION BY cycle) + row_number() OVER (PARTITION BY cycle ORDER BY " + _h("balanced/5/cycle", "cycle || '/' || category") + ", category) AS step, cycle // size AS round, cycle % size AS slot FROM c, range(200) AS r(cycle)), a AS (SELECT p_brand AS category, p_partkey AS asset, round, row_number() OVER (PARTITION BY p_brand, round ORDER BY " + _h("balanced/5/round", "p_brand || '/' || round || '/' || p_partkey") + ", p_partkey) - 1 AS slot FROM part, (SELECT DISTINCT round FROM y) AS rr) SELECT step, category, asset FROM y JOIN a USING (category, round, slot)")
def d04_balanced_schedule(s, d):
    pools = proxy(s, d, "part").selectExpr("p_brand AS category", "p_partkey AS asset")
    return D.balanced_schedule(pools, s, 5, 200).select(F.col("step").cast("long"), "category", "asset")


@query("SELECT 4 AS least, 4 AS most, count(*) AS samples, 4 * count(*) AS steps, true AS steps_complete FROM part")
def d05_check_schedule(s, d):
    ids = proxy(s, d, "part").select(F.col("p_partkey").alias("sample_id"))
    return D.check_schedule(D.exposure_schedule(ids, ids, 1), "sample_id")


@query("SELECT seed, arm, count(*) AS steps, count(*) FILTER (arm <> 'base' AND (epoch + ordinal) % 2 = 1 AND sample_id % 3 = 0) AS effective FROM (SELECT p_partkey AS sample_id, row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal FROM part) AS i, range(4) AS r(epoch), (SELECT unnest([1, 2]) AS seed) AS s, (SELECT unnest(['base', 'classic', 'photo']) AS arm) AS a GROUP BY 1, 2")
def d06_training_plans(s, d):
    rows = proxy(s, d, "part").selectExpr("p_partkey AS sample_id", "p_partkey % 3 = 0 AS accepted")
    return D.training_plans(rows, [1, 2], ["base", "classic", "photo"]).groupBy("seed", "arm").agg(F.count("*").alias("steps"), F.count_if("effective_augmentation").alias("effective"))


@query("WITH u AS (SELECT * FROM (SELECT category, asset, row_number() OVER (PARTITION BY name || size ORDER BY category, " + _h("audit", "asset") + ", asset) AS n FROM {assets}) AS x WHERE n = 1) SELECT category, asset, CASE WHEN k <= 3 THEN 'dev' ELSE 'sentinel' END AS role FROM (SELECT category, asset, row_number() OVER (PARTITION BY category ORDER BY " + _h("audit", "asset") + ", asset) AS k FROM u) AS y WHERE k <= 4")
def d07_audit_buckets(s, d):
    rows = proxy(s, d, "assets").withColumn("geometry", F.concat("name", F.col("size").cast("string")))
    return D.audit_buckets(rows, "category", "asset", "geometry", "audit").select("category", "asset", "role")


# ---- more checks on pixels, meshes and streams


@query("SELECT sample_id, arm, seed, value >= 0.999 AND value / 1000000 <= 0.00001 AS reproduced FROM {pairs}")
def p22_reproduction_gate(s, d):
    rows = proxy(s, d, "pairs").selectExpr("sample_id", "arm", "seed", "value AS iou", "value / 1000000 AS depth_p95")
    return P.reproduction_gate(rows).select("sample_id", "arm", "seed", "reproduced")


@query("SELECT doc_id AS sample_id, problem FROM (SELECT doc_id, unnest([x FOR x IN [CASE WHEN decision IS NULL THEN 'no review' END, CASE WHEN decision = 'pass' AND n_chars % 2 = 0 AND n_chars % 3 = 0 THEN 'mask changed' END, CASE WHEN decision = 'pass' AND n_chars % 2 = 1 THEN 'accepted edit equals source' END, CASE WHEN decision <> 'pass' AND n_chars % 2 = 0 THEN 'fallback differs from source' END] IF x IS NOT NULL]) AS problem FROM documents LEFT JOIN {reviews} AS r ON r.sample_id = doc_id) AS y")
def p15_check_reviews(s, d):
    docs = proxy(s, d, "documents").select(F.col("doc_id").alias("sample_id"), F.lit(0).alias("variant"), "n_chars")
    px = docs.selectExpr("sample_id", "variant", "0 AS v", "0 AS u", "n_chars % 3 = 0 AS mask", "n_chars AS source", "n_chars + CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END AS edited")
    reviews = proxy(s, d, "reviews").withColumn("variant", F.lit(0))
    return P.check_reviews(docs.select("sample_id", "variant"), reviews, px).select("sample_id", "problem")


_PATCH = "(SELECT q.sample_id, q.point_id, -q.z AS zc, count(*) FILTER (p.depth > 0.1 AND p.depth <= 10) = 9 AND max(p.depth) - min(p.depth) <= 0.01 AS ok, median(p.depth) AS ref FROM (SELECT *, 11.5 + 20 * x / -z AS pu, 14.5 - 20 * y / -z AS pv FROM %s AS t) AS q LEFT JOIN {px} AS p ON p.sample_id = q.sample_id AND pu >= 0.5 AND pu < 22.5 AND pv >= 0.5 AND pv < 28.5 AND abs(p.v - floor(pv + 0.5)) <= 1 AND abs(p.u - floor(pu + 0.5)) <= 1 GROUP BY 1, 2, 3)" % _CAM_PTS


@query("SELECT sample_id, count(*) FILTER (ok AND abs(zc - ref) <= 0.005) AS visible, count(*) FILTER (ok AND zc - ref > 0.005) AS occluded, count(*) - count(*) FILTER (ok AND zc - ref >= -0.005) AS uncertain, count(*) FILTER (ok AND zc - ref < -0.005) AS known_free, count(*) FILTER (ok) AS supported FROM " + _PATCH + " AS n GROUP BY 1")
def g09_visibility(s, d):
    return V.visibility(_cam_points(s, d), proxy(s, d, "px"), _cams(s, d)).groupBy("sample_id").agg(*[F.count_if(c).alias(c) for c in ("visible", "occluded", "uncertain", "known_free", "supported")])


@query("SELECT sample_id, round(avg(CASE WHEN ok AND zc - ref < -0.005 THEN 1.0 ELSE 0 END), 6) AS rate_all, count(*) FILTER (ok AND zc - ref < -0.005) AS violations FROM " + _PATCH + " AS n GROUP BY 1")
def g17_free_violations(s, d):
    flags = V.visibility(_cam_points(s, d), proxy(s, d, "px"), _cams(s, d))
    return r6(V.free_violations(flags, ["sample_id"]).select("sample_id", "rate_all", "violations"))


@query("SELECT sample_id, count(*) FILTER (coalesce(zc < lo - 0.005, false)) AS certain_free, count(*) FILTER (point_id % 2 = 0 AND (hi IS NULL OR zc > hi + 0.005)) AS hidden_surface FROM " + _NEAR + " AS n GROUP BY 1")
def g12_query_flags(s, d):
    q = _cam_points(s, d).withColumn("udf_m", F.when(F.col("point_id") % 2 == 0, 0.001).otherwise(1.0))
    out = V.query_flags(q, proxy(s, d, "px"), _cams(s, d))
    return out.groupBy("sample_id").agg(F.count_if("certain_free").alias("certain_free"), F.count_if("hidden_surface").alias("hidden_surface"))


def _to_edge(s: str, e: str) -> str:
    """Distance from (x, y, z) to the edge between corners s and e, as SQL."""
    d, w = [f"({e}_{k} - {s}_{k})" for k in "xyz"], [f"(p.{k} - {s}_{k})" for k in "xyz"]
    dot = lambda a, b: "(" + " + ".join(f"{i} * {j}" for i, j in zip(a, b)) + ")"
    t = f"CASE WHEN {dot(d, d)} > 0 THEN least(greatest({dot(w, d)} / {dot(d, d)}, 0.0), 1.0) ELSE 0.0 END"
    return "sqrt(" + " + ".join(f"pow({w[k]} - ({t}) * {d[k]}, 2)" for k in range(3)) + ")"


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def _same_side(s: str, e: str) -> str:
    side = _cross([f"({e}_{k} - {s}_{k})" for k in "xyz"], [f"(p.{k} - {s}_{k})" for k in "xyz"])
    return "(" + " + ".join(f"{a} * n{k}" for a, k in zip(side, "xyz")) + " >= 0)"


_SPAN = [[f"({c}_{k} - a_{k})" for k in "xyz"] for c in "bc"]
_CORNERS = "SELECT f.mesh_id, f.fid, " + ", ".join(f"v{c}.{k} AS {c}_{k}" for c in "abc" for k in "xyz") + " FROM {faces} AS f " + " ".join(f"JOIN {{vertices}} AS v{c} ON v{c}.vid = f.{c}" for c in "abc")
_PLANES = "SELECT *, " + ", ".join(f"{e} AS n{k}" for e, k in zip(_cross(*_SPAN), "xyz")) + f" FROM ({_CORNERS}) AS corners"
_HEIGHT = "abs(" + " + ".join(f"(p.{k} - a_{k}) * n{k}" for k in "xyz") + ") / nn"
_BOXED = " AND ".join(f"p.{k} BETWEEN least(a_{k}, b_{k}, c_{k}) - 0.25 AND greatest(a_{k}, b_{k}, c_{k}) + 0.25" for k in "xyz")
# every point with every triangle of the mesh whose box is near enough
_DISTANCES = (
    "WITH p AS (SELECT mesh_id, vid AS point_id, x + 0.05 AS x, y, z FROM {vertices}), t AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS nn FROM (" + _PLANES + ") AS planes), "
    "m AS (SELECT p.point_id, CASE WHEN nn > 1e-14 AND " + " AND ".join(_same_side(*e) for e in ("ab", "bc", "ca")) + f" THEN {_HEIGHT} ELSE least(" + ", ".join(_to_edge(*e) for e in ("ab", "bc", "ca")) + ") END AS distance "
    "FROM p JOIN t ON p.mesh_id = t.mesh_id AND " + _BOXED + "), near AS (SELECT point_id, min(distance) AS distance FROM m WHERE distance <= 0.25 GROUP BY 1) "
    "SELECT p.mesh_id, p.point_id, near.distance FROM p LEFT JOIN near USING (point_id)"
)


@query("SELECT mesh_id, point_id, round(distance, 6) + 0.0 AS distance FROM (" + _DISTANCES + ") AS x")
def j08_point_mesh_distance(s, d):
    tri = _tri(s, d)
    pts = proxy(s, d, "vertices").selectExpr("mesh_id", "vid AS point_id", "x + 0.05 AS x", "y", "z")
    return r6(J.point_mesh_distance(pts, tri, ["mesh_id"], "point_id", 0.25))


@query("SELECT mesh_id, round(quantile_cont(coalesce(distance, 0.25), 0.5), 6) + 0.0 AS median, round(quantile_cont(coalesce(distance, 0.25), 0.95), 6) + 0.0 AS p95, count(*) AS points FROM (" + _DISTANCES + ") AS x GROUP BY 1")
def g19_registration(s, d):
    pts = proxy(s, d, "vertices").selectExpr("mesh_id", "vid AS point_id", "x + 0.05 AS x", "y", "z")
    return r6(G.registration(pts, _tri(s, d), ["mesh_id"], "point_id", 0.25))


@query("SELECT sample_id, greatest(0, least(floor((u0 + u1 + 1 - w) / 2), 24 - w)) AS \"left\", greatest(0, least(floor((v0 + v1 + 1 - h) / 2), 30 - h)) AS top, greatest(0, least(floor((u0 + u1 + 1 - w) / 2), 24 - w)) + w AS \"right\", greatest(0, least(floor((v0 + v1 + 1 - h) / 2), 30 - h)) + h AS bottom FROM (SELECT *, floor(w * 3 / 4) AS h FROM (SELECT sample_id, min(v) AS v0, max(v) AS v1, min(u) AS u0, max(u) AS u1, least(24, 4 * ceil(greatest((max(u) - min(u) + 1) * 1.4, (max(v) - min(v) + 1) * 1.4 * 4 / 3) / 4)) AS w FROM {px} WHERE mask GROUP BY 1) AS y) AS x")
def f12_crop_box(s, d):
    return R.crop_box(proxy(s, d, "px"), 30, 24)


@query()
def f16_mask_prompt(s, d):
    return r6(R.mask_prompt(proxy(s, d, "px"), 30, 24))


@query()
def f19_photometric(s, d):
    return R.photometric(proxy(s, d, "px"), "photo").select("sample_id", "v", "u", "r", "g", "b")


@query()
def g06_near_duplicates(s, d):
    p = points(s, d)
    box = A.extents(p, ["cloud"]).select("cloud", "size_x", "size_y", "size_z")
    return r6(G.near_duplicates(box, p, "cloud", ["size_x", "size_y", "size_z"], 0.5, 1.0, 1.0, 4, 2.0, True))


@query()
def r04_depth_noise(s, d):
    return r6(R.depth_noise(proxy(s, d, "px"), 1, 1, 10.0))


def _event_stream(s, d):
    schema = proxy(s, d, "events").schema
    return s.readStream.schema(schema).parquet(f"{d}/events.parque[t]")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def x01_stream_progress(s, d):
    from reconlake.plans.lineage import scratch_path
    from reconlake.streaming.views import stream_progress

    out = scratch_path(s, "progress")
    q = stream_progress(_event_stream(s, d).withColumnRenamed("event_type", "status"))
    last = lambda df, k: df.write.mode("overwrite").parquet(out)
    q.writeStream.outputMode("complete").foreachBatch(last).option("checkpointLocation", scratch_path(s, "state")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out)


@query("SELECT event_id AS record, event_type AS binding FROM events")
def x02_stream_commit(s, d):
    from reconlake.plans.lineage import scratch_path
    from reconlake.streaming.views import committed, stream_commit

    out = scratch_path(s, "committed")
    rows = _event_stream(s, d).select(F.col("event_id").alias("record"), F.col("event_type").alias("binding"))
    for k in range(2):  # the second run meets every record again
        stream_commit(rows, out, scratch_path(s, f"state{k}"), "record", "binding").awaitTermination()
    return committed(s, out).select("record", "binding")


@query("SELECT event_type AS run, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS steps, round(avg(value), 6) AS loss, max(value) AS longest FROM events GROUP BY 1, 2")
def x03_stream_steps(s, d):
    from reconlake.plans.lineage import scratch_path
    from reconlake.streaming.views import stream_steps

    out = scratch_path(s, "steps")
    rows = _event_stream(s, d).selectExpr("event_type AS run", "event_id AS step", "value AS loss", "value AS seconds", "CAST(ts AS timestamp) AS at")
    q = stream_steps(rows, "at", window="1 day", delay="40 days")
    keep = lambda df, k: df.select("run", F.col("w.start").cast("timestamp_ntz").alias("start"), "steps", "loss", "longest").write.mode("append").parquet(out)
    q.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch_path(s, "state")).trigger(availableNow=True).start().awaitTermination()
    rows = s.read.schema("run string, start timestamp_ntz, steps long, loss double, longest double").parquet(out)
    last = rows.groupBy("run", "start").agg(F.max(F.struct("steps", "loss", "longest")).alias("m"))
    return r6(last.select("run", "start", "m.*"))


@query("SELECT doc_id, n_chars, quality FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) AS l USING (doc_id)")
def j02_with_reviews(s, d):
    return J.with_reviews(proxy(s, d, "documents").select("doc_id", "n_chars"), proxy(s, d, "labels").select("doc_id", "quality").distinct(), "doc_id")


@query("SELECT o_orderkey, 'excluded' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) UNION ALL SELECT o_orderkey, 'kept' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def j03_exclude_and_keep(s, d):
    o = proxy(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    ids = proxy(s, d, "customer").where("c_acctbal > 5000")
    side = lambda df, k: df.select("o_orderkey", F.lit(k).alias("side"))
    return side(J.exclude(o, ids, "c_custkey"), "excluded").unionByName(side(J.keep(o, ids, "c_custkey"), "kept"))


@query("SELECT sample_id, v, u, 20.0 AS fx FROM {px} WHERE depth > 0")
def j04_with_camera(s, d):
    return J.with_camera(proxy(s, d, "px").where("depth > 0"), _cams(s, d)).select("sample_id", "v", "u", "fx")


@query("SELECT cloud, point_id, n = 1 AS one_to_one FROM (SELECT *, count(*) OVER (PARTITION BY cloud, o) AS n FROM (SELECT a.cloud, a.point_id, arg_min(b.point_id, (sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), b.point_id)) AS o, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS dd FROM {even} AS a JOIN {odd} AS b USING (cloud) GROUP BY 1, 2) AS y WHERE dd <= 0.06) AS x")
def j11_match_poses(s, d):
    b = points(s, d, 1).withColumnRenamed("point_id", "other")
    return J.match_poses(points(s, d, 0), b, ["cloud"], "point_id", "other", 0.06).select("cloud", "point_id", "one_to_one")


# every ray with every triangle's plane (its corners' z turned to -z - 1), and whether the point met lies on the inner side of all edges
_HIT = "(a_x * nx + a_y * ny + a_z * nz) / (dx * nx + dy * ny - nz)"
_WITHIN = " AND ".join(
    "(" + " + ".join(f"{a} * n{k}" for a, k in zip(_cross([f"({e}_{k} - {s}_{k})" for k in "xyz"], [f"(t * dx - {s}_x)", f"(t * dy - {s}_y)", f"(-t - {s}_z)"]), "xyz")) + " >= 0)"
    for s, e in ("ab", "bc", "ca")
)
_FIRST_HITS = (
    "WITH c AS (SELECT mesh_id, " + ", ".join(f"{c}_{k}" if k != "z" else f"-{c}_z - 1 AS {c}_z" for c in "abc" for k in "xyz") + " FROM (" + _CORNERS + ") AS corners), "
    "n AS (SELECT *, " + ", ".join(f"{e} AS n{k}" for e, k in zip(_cross(*_SPAN), "xyz")) + " FROM c WHERE greatest(a_z, b_z, c_z) < 0), "
    "r AS (SELECT p_partkey AS ray, p_size / CAST(30 AS DOUBLE) AS dx, CAST(p_retailprice AS DOUBLE) / 2000 AS dy FROM part), "
    f"h AS (SELECT * FROM (SELECT r.*, n.*, {_HIT} AS t FROM r, n WHERE abs(dx * nx + dy * ny - nz) > 1e-14) AS x WHERE t > 0 AND {_WITHIN}) "
    "SELECT CAST('all' AS STRING) AS mesh_id, r.ray, round(min(h.t), 6) AS depth FROM r LEFT JOIN h USING (ray) GROUP BY 2"
)


@query(_FIRST_HITS)
def j13_first_hits(s, d):
    tri = _tri(s, d).withColumns({f"{k}z": -F.col(f"{k}z") - 1 for k in "abc"})
    rays = proxy(s, d, "part").selectExpr("CAST('all' AS STRING) AS mesh_id", "p_partkey AS ray", "p_size / 30.0D AS dx", "p_retailprice / 2000 AS dy")
    return r6(J.first_hits(rays, tri, ["mesh_id"], "ray", 0.25))


@query("SELECT p_partkey, round(0.0000005 * (p_partkey % 7), 9) AS correction FROM part")
def f10_rotation_correction(s, d):
    e = F.col("p_partkey") % 7 * 1e-6
    m = [F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)]
    m[1] = e
    return proxy(s, d, "part").select("p_partkey", F.round(X.rotation_correction(m), 9).alias("correction"))


@query("SELECT sample_id, v, u, CAST(floor(5 + (v + 0.5) * 10 / 30) AS BIGINT) AS source_v, CAST(floor(4 + (u + 0.5) * 12 / 24) AS BIGINT) AS source_u FROM {px}")
def f12_nearest_map(s, d):
    boxes = _cams(s, d).selectExpr("sample_id", "4 AS left", "5 AS top", "16 AS right", "15 AS bottom")
    return R.nearest_map(proxy(s, d, "px"), boxes, 24, 30)


@query("SELECT event_id, 320.0 * value AS fx, 240.0 * value AS fy, 319.5 AS cx, 239.5 AS cy FROM events")
def f23_camera_from_projection(s, d):
    cam = X.camera_from_projection("value", "value", F.lit(0.0), F.lit(0.0), F.lit(640), F.lit(480))
    return proxy(s, d, "events").select("event_id", cam.alias("c")).select("event_id", "c.*")


@query(f"SELECT grid_id, round(avg(CASE WHEN udf_m <= 0.8 THEN 1.0 ELSE 0 END), 6) AS contact FROM {_GRID} AS g WHERE ix IN (0, 8) OR iy IN (0, 8) OR iz IN (0, 8) GROUP BY 1")
def g24_boundary_contact(s, d):
    return r6(G.boundary_contact(_grid(s, d), 0.8))


@query()
def g25_residual_labels(s, d):
    tri = _tri(s, d).select(F.lit("view").alias("mesh_id"), "fid", *[(0.05 * F.col(f"{k}{a}") - (1.0 if a == "z" else 0.1)).alias(f"{k}{a}") for k in "abc" for a in "xyz"])
    return G.residual_labels(tri, proxy(s, d, "px"), _cams(s, d), 500)


@query()
def g07_mask_components(s, d):
    return R.mask_components(proxy(s, d, "px")).groupBy("sample_id").agg(F.count("*").alias("parts"), F.sum("pixels").alias("pixels"))


# ---- inputs of several queries


def _paired(s, d) -> DataFrame:
    return T.paired(proxy(s, d, "pairs"), "view", "click", ["sample_id", "seed", "object_id", "scene_id"])


def _tri(s, d) -> DataFrame:
    return G.triangles(proxy(s, d, "vertices"), proxy(s, d, "faces"))


def _cams(s, d) -> DataFrame:
    return proxy(s, d, "events").select(F.col("event_type").alias("sample_id")).distinct().selectExpr("sample_id", "24 AS width", "30 AS height", "20.0D AS fx", "20.0D AS fy", "11.5D AS cx", "14.5D AS cy")


def _cam_points(s, d) -> DataFrame:
    axis: list[Column] = [0.4 * F.col("x"), 0.4 * F.col("y"), -1.01 + 0.01 * F.col("z")]
    return points(s, d).select(F.lit("view").alias("sample_id"), "point_id", *[c.alias(a) for c, a in zip(axis, "xyz")])


# ---- sources that are written under the shared folder first and read back; functions that users bring


@query("SELECT doc_id, lang, n_chars FROM documents")
def s01_read_manifest(s, d):
    row = F.struct("doc_id", "lang", "n_chars")
    manifests = proxy(s, d, "documents").groupBy(F.floor(F.col("doc_id") / 500).alias("part")).agg(F.collect_list(row).alias("rows"))
    out = scratch_path(s, "manifests")
    manifests.withColumn("status", F.lit("frozen")).repartition("part").write.partitionBy("part").json(out)
    return S.read_manifest(s, out, "doc_id long, lang string, n_chars long", "frozen").select("doc_id", "lang", "n_chars")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def s02_read_jsonl(s, d):
    out = scratch_path(s, "lines")
    proxy(s, d, "events").select("event_id", "user_id", "event_type", "value").write.json(out)
    return S.read_jsonl(s, out, "event_id long, user_id long, event_type string, value double", F.col("event_type") == "click").drop("event_type")


@query("SELECT event_id // 2000 AS scene_id, event_id // 4 AS image_id, CAST(row_number() OVER (PARTITION BY event_id // 4 ORDER BY event_id) - 1 AS INT) AS gt_id, CAST(user_id AS INT) AS obj_id, event_id AS px_count_visib, value AS visib_fract, CAST(event_id // 4 AS DOUBLE) AS fx, CAST(0.1 AS DOUBLE) AS depth_scale FROM events")
def s03_read_annotations(s, d):
    e = proxy(s, d, "events").withColumns({"scene": F.expr("event_id div 2000"), "image": F.expr("event_id div 4")})
    images = e.groupBy("scene", "image").agg(F.array_sort(F.collect_list(F.struct("event_id", "user_id", "value"))).alias("xs"))
    no = F.array().cast("array<double>")
    kinds = {
        "gt": F.transform("xs", lambda x: F.struct(x["user_id"].cast("int").alias("obj_id"), no.alias("cam_R_m2c"), no.alias("cam_t_m2c"))),
        "info": F.transform("xs", lambda x: F.struct(x["event_id"].alias("px_count_visib"), x["value"].alias("visib_fract"))),
        "camera": F.struct(F.array(F.col("image").cast("double")).alias("cam_K"), F.lit(0.1).alias("depth_scale")),
    }
    paths = []
    for kind, value in kinds.items():
        maps = images.groupBy("scene").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("image").cast("string"), value.alias("v"))))).alias("value"))
        paths.append(scratch_path(s, kind))
        maps.repartition("scene").write.partitionBy("scene").text(paths[-1])
    rows = S.read_annotations(s, *paths)
    return rows.select("scene_id", "image_id", "gt_id", "obj_id", "px_count_visib", "visib_fract", F.get("cam_K", F.lit(0)).alias("fx"), "depth_scale")


_OBJ = "(SELECT p_partkey // 500 AS mesh, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - 1 AS vid, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(length(p_name) AS DOUBLE) AS z FROM part)"


def _obj_lines(s, d) -> DataFrame:
    """A mesh of every 500 parts as OBJ text: a vertex a part and a strip of triangles."""
    p = proxy(s, d, "part").select(F.expr("p_partkey div 500").alias("mesh"), F.struct("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.length("p_name").cast("double").alias("z")).alias("v"))
    m = p.groupBy("mesh").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    v = F.transform("vs", lambda x: F.concat_ws(" ", F.lit("v"), x["x"], x["y"], x["z"]))
    f = F.when(F.size("vs") > 2, F.transform(F.sequence(F.lit(1), F.size("vs") - 2), lambda i: F.concat_ws(" ", F.lit("f"), i, F.concat(i + 1, F.lit("/1")), F.lit(2) + i)))
    out = scratch_path(s, "obj")
    m.select("mesh", F.concat_ws("\n", v, f).alias("value")).repartition("mesh").write.partitionBy("mesh").text(out)
    return S.text_lines(s, out, F.col("mesh").cast("long"))


@query("SELECT mesh AS mesh_id, vid, x, y, z FROM " + _OBJ + " AS o")
def s05_obj_vertices(s, d):
    return S.read_obj_text(_obj_lines(s, d))[0].withColumn("vid", F.col("vid").cast("long"))


@query("SELECT mesh AS mesh_id, vid AS a, vid + 1 AS b, vid + 2 AS c FROM (SELECT *, max(vid) OVER (PARTITION BY mesh) AS last FROM " + _OBJ + " AS o) AS y WHERE vid + 2 <= last")
def s05_obj_faces(s, d):
    return S.read_obj_text(_obj_lines(s, d))[1].select("mesh_id", "a", "b", "c")


@query("SELECT DISTINCT p_partkey // 500 AS mesh_id, 'textures/' || p_size || '.png' AS path, p_size % 3 <> 0 AS exists_inside_dataset FROM part")
def s06_material_refs(s, d):
    p = proxy(s, d, "part")
    line = F.concat(F.lit("newmtl m\nmap_Kd ./textures\\"), F.col("p_size").cast("string"), F.lit(".png"))
    out = scratch_path(s, "mtl")
    p.groupBy(F.expr("p_partkey div 500").alias("mesh")).agg(F.concat_ws("\n", F.collect_list(line)).alias("value")).repartition("mesh").write.partitionBy("mesh").text(out)
    files = p.where("p_size % 3 <> 0").select(F.concat(F.lit("textures/"), F.col("p_size").cast("string"), F.lit(".png")).alias("path"))
    return S.read_material_refs(S.text_lines(s, out, F.col("mesh").cast("long")), files)


@query("SELECT doc_id // 100 AS part, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id, text) || chr(10)) AS sha256, count(text) * 65 AS size_bytes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def s08_file_inventory(s, d):
    rows = proxy(s, d, "documents").where("text IS NOT NULL").select(F.expr("doc_id div 100").alias("part"), F.struct("doc_id", "text").alias("d"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("d.doc_id", F.sha2("d.text", 256).alias("h")))), lambda x: x["h"])
    out = scratch_path(s, "files")
    rows.groupBy("part").agg(F.array_join(listed, "\n").alias("value")).repartition("part").write.partitionBy("part").text(out)
    return S.file_inventory(s, out).select(F.regexp_extract("path", r"part=([0-9]+)/", 1).cast("long").alias("part"), "sha256", "size_bytes")


_FOLDER = "'assets/' || (p_partkey % 2) || '/' || p_brand || ' ' || (p_partkey // 20)"


@query(
    "SELECT *, count(*) OVER (PARTITION BY asset_id) > 1 AS duplicate_id FROM (SELECT " + _FOLDER + " AS folder, regexp_replace(p_brand || ' ' || (p_partkey // 20), '[^A-Za-z0-9_.-]+', '_', 'g') AS asset_id, bool_or(p_size % 4 = 0) AS mesh, "
    "bool_or(p_size % 4 = 1) AS material, bool_or(p_size % 4 = 2) AS texture, count(*) AS files FROM part GROUP BY 1, 2) AS x"
)
def s09_scan_assets(s, d):
    end = F.get(F.array(F.lit(".OBJ"), F.lit(".mtl"), F.lit(".jpeg"), F.lit(".txt")), F.col("p_size") % 4)
    path = F.concat(F.lit("assets/"), F.expr("CAST(p_partkey % 2 AS STRING)"), F.lit("/"), F.col("p_brand"), F.lit(" "), F.expr("CAST(p_partkey div 20 AS STRING)"), F.lit("/"), F.col("p_partkey").cast("string"), end)
    return S.scan_assets(proxy(s, d, "part").select(path.alias("path")))


@query("SELECT o_orderkey, o_custkey FROM orders")
def s10_publish(s, d):
    out = scratch_path(s, "published")
    S.publish(proxy(s, d, "orders").select("o_orderkey", "o_custkey"), out)
    try:
        S.publish(proxy(s, d, "orders").select("o_orderkey"), out)
    except AnalysisException:  # the earlier freeze stays
        return s.read.parquet(out)
    raise AssertionError("an earlier freeze was overwritten")


@query("SELECT point_id, round(sqrt(x * x + y * y + z * z), 6) AS udf_m, round(x - y, 6) + 0.0 AS logit FROM {points}")
def e01_apply_field(s, d):
    def radial(p):
        return (p * p).sum(axis=1) ** 0.5, p[:, 0] - p[:, 1]

    return r6(U.apply_field(points(s, d), radial).select("point_id", "udf_m", "logit"))


@query("SELECT event_id, 'root' AS metric, round(sqrt(value), 6) AS value FROM events UNION ALL SELECT event_id, 'halved', round(value / 2, 6) FROM events")
def e02_metric_values(s, d):
    for name, of in (("root", lambda: F.sqrt("value")), ("halved", lambda: F.col("value") / 2)):
        if name not in U.METRICS:
            U.register_metric(name, of)
    return r6(U.metric_values(proxy(s, d, "events"), ["event_id"], ["root", "halved"]))


@query("SELECT p_partkey, CAST(k AS BIGINT) AS fid, CAST(p_size + k AS DOUBLE) AS ax, CAST(p_size AS DOUBLE) AS by, CAST(1 AS DOUBLE) AS cz FROM part, range(2) AS r(k)")
def e03_register_source(s, d):
    def corners(text):
        for k in range(2):
            size = float(text)
            yield k, size + k, 0.0, 0.0, 0.0, size, 0.0, 0.0, 0.0, 1.0

    U.register_source(s, "corner_triangles", corners)
    return s.sql("SELECT p_partkey, t.fid, t.ax, t.by, t.cz FROM {part} AS p, LATERAL corner_triangles(CAST(p.p_size AS STRING)) AS t", part=proxy(s, d, "part"))


@query("SELECT p_partkey, CAST(CAST('0x' || substr(" + _h("train", "p_partkey") + ", 1, 16) AS UBIGINT) AS DECIMAL(20, 0)) AS seed FROM part")
def f02_stable_seed(s, d):
    return proxy(s, d, "part").select("p_partkey", X.stable_seed("train", "p_partkey").alias("seed"))


@query("SELECT p_partkey, round(" + _u("draw", "p_partkey") + ", 6) AS draw, round(p_size * (0.8 + 0.4 * " + _u("prior", "p_partkey") + "), 6) AS prior FROM part")
def f03_hash_uniform(s, d):
    return r6(proxy(s, d, "part").select("p_partkey", X.hash_uniform("draw", "p_partkey").alias("draw"), X.metric_prior("prior", "p_partkey", "p_size").alias("prior")))


@query("SELECT p_partkey, sha256(p_brand || chr(0) || p_partkey || chr(0) || p_size) AS digest FROM part")
def f04_selection_digest(s, d):
    return proxy(s, d, "part").select("p_partkey", X.selection_digest("p_brand", "p_partkey", "p_size").alias("digest"))


@query("SELECT sample_id, coalesce(printf('%.2f', value * 100), 'N/D') AS percent, coalesce(printf('%.3f', value * 1000), 'N/D') AS mm FROM {scores}")
def f22_fmt(s, d):
    return proxy(s, d, "scores").select("sample_id", X.fmt("value").alias("percent"), X.fmt("value", "mm").alias("mm"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, " + _h("order", "p_partkey") + ", p_partkey) - 1 AS place FROM part")
def o01_stable_order(s, d):
    rows = stored(W.stable_order(proxy(s, d, "part").select("p_partkey", "p_size"), ["p_size"], "order", "p_partkey").select("p_partkey", F.monotonically_increasing_id().alias("at")), "ordered")
    part = F.shiftright("at", 33).alias("part")
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))  # a row a task
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.withColumn("part", part).join(before, "part").select("p_partkey", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


# ---- SQL of greedy choices, draws on surfaces and masks; kept apart, since it is long


def _surface_sql(tri: str, n: int, seed: str) -> str:
    """CTEs down to surf(mesh_id, point_id, fid, x, y, z): faces of `tri` by running area in order of fid, one draw a point."""
    draw = lambda k: _u(f"{seed}/{k}", "mesh_id || '/' || point_id")
    area = "sqrt(" + " + ".join(f"({e}) * ({e})" for e in _cross(*_SPAN)) + ")"
    at = ", ".join(f"(1 - root) * a_{k} + root * (1 - second) * b_{k} + root * second * c_{k} AS {k}" for k in "xyz")
    return (
        f"t AS ({tri}), runs AS (SELECT *, sum(area) OVER (PARTITION BY mesh_id ORDER BY fid) AS hi FROM (SELECT *, {area} AS area FROM t) AS x WHERE area > 1e-14), "
        f"draws AS (SELECT mesh_id, point_id, {draw('face')} * total AS at, sqrt({draw('u')}) AS root, {draw('v')} AS second FROM (SELECT mesh_id, max(hi) AS total FROM runs GROUP BY 1) AS x, range({n}) AS q(point_id)), "
        f"surf AS (SELECT d.mesh_id, d.point_id, r.fid, {at} FROM draws AS d JOIN runs AS r ON r.mesh_id = d.mesh_id AND d.at >= r.hi - r.area AND d.at < r.hi)"
    )


_ROUNDED = "round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z"
_SIZE = "sqrt(" + " + ".join(f"({e}) * ({e})" for e in _cross(*_SPAN)) + ")"
_OFFSET = ", ".join(f"s.{k} + 0.02 * {_normal('queries/offset', 's.mesh_id || ' + chr(39) + '/' + chr(39) + ' || s.point_id')} * ({e}) / {_SIZE} AS {k}" for k, e in zip("xyz", _cross(*_SPAN)))
_ROI = "(SELECT mesh_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, greatest(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2 * 1.1, 0.05) AS half FROM {vertices} GROUP BY 1)"
_FREE = ", ".join(f"c{k} + half * (2 * {_u('queries/' + k, 'mesh_id || ' + chr(39) + '/' + chr(39) + ' || point_id')} - 1) AS {k}" for k in "xyz")
_POSED = "SELECT 'view' AS mesh_id, fid, " + ", ".join(f"0.05 * {c}_{k} - {1.0 if k == 'z' else 0.1} AS {c}_{k}" for c in "abc" for k in "xyz") + " FROM (" + _CORNERS + ") AS corners"
_TAKEN = "STRUCT(s BIGINT, f BIGINT, b VARCHAR, r VARCHAR)[]"
_FOUR = "abs(a.v - b.v) + abs(a.u - b.u)"


def _toned(inner: str) -> str:
    clip = lambda e: f"least(greatest({e}, 0.0), 255.0)"
    draw = lambda k, low, high: f"({low} + {high - low!r} * {_u('photo/' + k, 'sample_id')})"
    grey = "(0.299 * r + 0.587 * g + 0.114 * b)"
    each = lambda f: ", ".join(f"{f(c)} AS {c}" for c in "rgb")
    one = f"SELECT sample_id, v, u, {each(lambda c: clip(f'{c} * ' + draw('brightness', 0.8, 1.2)))} FROM {inner} AS q"
    two = f"SELECT sample_id, v, u, {each(lambda c: clip(f'm + ({c} - m) * ' + draw('contrast', 0.8, 1.2)))} FROM (SELECT *, avg({grey}) OVER (PARTITION BY sample_id) AS m FROM ({one}) AS w) AS x"
    three = f"SELECT sample_id, v, u, {each(lambda c: clip(f'm + ({c} - m) * ' + draw('saturation', 0.8, 1.2)))} FROM (SELECT *, {grey} AS m FROM ({two}) AS y) AS z"
    tone = each(lambda c: f"CAST(round_even(255 * pow({c} / 255, {draw('gamma', 0.9, 1.1)}), 0) AS INT)")
    return f"SELECT sample_id, v, u, {tone} FROM ({three}) AS k"


_VARIANTS = [([p, q, "z"], [i, j, 1]) for p, q in ("xy", "yx") for i in (1, -1) for j in (1, -1)]
_TURNED = " UNION ALL ".join("SELECT cloud, point_id, " + str(k) + " AS variant, " + ", ".join(f"{f} * {src} AS {to}" for f, src, to in zip(sign, axes, "xyz")) + " FROM {points}" for k, (axes, sign) in enumerate(_VARIANTS))
_GAP = "sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2)"

_LONG = {
    "w02_spaced_select": (
        "WITH RECURSIVE o AS (SELECT object_id, scene_id AS s, image_id AS f, CASE WHEN vis < 0.4 THEN 'low' WHEN vis < 0.7 THEN 'medium' ELSE 'high' END AS b, sha256('spaced/' || scene_id || '/' || image_id || '/' || sample_id || '/' || object_id) AS r FROM {obs} WHERE pixels >= 512 AND vis >= 0.1), "
        "i AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY phase, r) AS step FROM (SELECT *, CASE b WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS phase FROM o UNION ALL SELECT *, 3 FROM o) AS x), "
        f"g AS (SELECT DISTINCT object_id, CAST(0 AS BIGINT) AS step, CAST([] AS {_TAKEN}) AS taken FROM o UNION ALL "
        "SELECT g.object_id, i.step, CASE WHEN len(list_filter(g.taken, lambda x: x.s = i.s AND abs(x.f - i.f) < 15)) = 0 AND CASE WHEN i.phase < 3 THEN len(list_filter(g.taken, lambda x: x.b = i.b)) < 2 ELSE len(g.taken) < 6 END "
        "THEN list_append(g.taken, {'s': CAST(i.s AS BIGINT), 'f': CAST(i.f AS BIGINT), 'b': i.b, 'r': i.r}) ELSE g.taken END FROM g JOIN i ON i.object_id = g.object_id AND i.step = g.step + 1), "
        "e AS (SELECT object_id, arg_max(taken, step) AS taken FROM g GROUP BY 1), k AS (SELECT object_id, taken, unnest(range(1, len(taken) + 1)) AS pick FROM e) "
        "SELECT object_id, CAST(pick AS INT) AS pick, taken[pick].s AS scene_id, taken[pick].f AS image_id, taken[pick].b AS visibility_bin, taken[pick].r AS rank FROM k"
    ),
    "f16_mask_prompt": (
        "WITH px AS (SELECT * FROM {px} AS raw), box AS (SELECT sample_id, min(v) AS v0, max(v) AS v1, min(u) AS u0, max(u) AS u1 FROM px WHERE mask GROUP BY 1), "
        "d AS (SELECT a.sample_id, a.v, a.u, min(sqrt((a.v - b.v) ** 2 + (a.u - b.u) ** 2)) AS d FROM px AS a LEFT JOIN px AS b ON b.sample_id = a.sample_id AND NOT b.mask WHERE a.mask GROUP BY 1, 2, 3), "
        "far AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY d DESC NULLS LAST, v, u) = 1) "
        "SELECT sample_id, CAST(round(greatest(v0 - 0.1 * (v1 - v0 + 1), 0.0), 6) AS DOUBLE) AS top, CAST(round(least(v1 + 0.1 * (v1 - v0 + 1), 29.0), 6) AS DOUBLE) AS bottom, CAST(round(greatest(u0 - 0.1 * (u1 - u0 + 1), 0.0), 6) AS DOUBLE) AS \"left\", CAST(round(least(u1 + 0.1 * (u1 - u0 + 1), 23.0), 6) AS DOUBLE) AS \"right\", v, u FROM box JOIN far USING (sample_id)"
    ),
    "f19_photometric": _toned("{px}"),
    "r04_depth_noise": (
        "WITH px AS (SELECT * FROM {px} AS raw), base AS (SELECT p.* FROM px AS p JOIN (" + _INNER + ") AS i ON i.sample_id = p.sample_id AND i.v = p.v AND i.u = p.u WHERE p.depth > 0), "
        f"smooth AS (SELECT a.sample_id, a.v, a.u FROM base AS a JOIN base AS b ON a.sample_id = b.sample_id AND {_FOUR} <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 5), "
        "span AS (SELECT a.sample_id, a.v, a.u FROM px AS a JOIN px AS b ON a.sample_id = b.sample_id AND abs(a.v - b.v) <= 2 AND abs(a.u - b.u) <= 2 GROUP BY 1, 2, 3 HAVING max(coalesce(b.depth, 0)) - min(coalesce(b.depth, 0)) < 10), "
        "inv AS (SELECT sample_id, v, u, CASE WHEN depth > 0 THEN 1 / depth ELSE 0 END AS x FROM px), "
        f"bend AS (SELECT a.sample_id, a.v, a.u, sum(b.x) - 4 * any_value(a.x) AS r FROM inv AS a JOIN inv AS b ON a.sample_id = b.sample_id AND {_FOUR} = 1 GROUP BY 1, 2, 3 HAVING count(*) = 4), "
        "res AS (SELECT sample_id, r FROM bend SEMI JOIN smooth USING (sample_id, v, u) SEMI JOIN span USING (sample_id, v, u)), mid AS (SELECT sample_id, median(r) AS m FROM res GROUP BY 1) "
        "SELECT sample_id, round(median(abs(r - m)) / (0.6744897501960817 * sqrt(20)), 6) AS sigma_inverse, count(*) AS pixels FROM res JOIN mid USING (sample_id) GROUP BY 1"
    ),
    "g01_sample_surface": f"WITH {_surface_sql(_CORNERS, 2000, 'surface')} SELECT mesh_id, CAST(point_id AS INT) AS point_id, fid, {_ROUNDED} FROM surf",
    "g06_near_duplicates": (
        "WITH p AS (SELECT * FROM {points} AS raw), box AS (SELECT cloud, list_sort([max(x) - min(x), max(y) - min(y), max(z) - min(z)]) AS e FROM p GROUP BY 1), "
        "c AS (SELECT a.cloud AS a, b.cloud AS b FROM box AS a JOIN box AS b ON a.cloud < b.cloud AND abs(a.e[1] - b.e[1]) <= 0.5 AND abs(a.e[2] - b.e[2]) <= 0.5 AND abs(a.e[3] - b.e[3]) <= 0.5), "
        f"w AS ({_TURNED}), d AS (SELECT c.a, c.b, l.variant, l.point_id AS p, r.point_id AS q, {_GAP} AS d FROM c JOIN w AS l ON l.cloud = c.a JOIN p AS r ON r.cloud = c.b), "
        "f AS (SELECT a, b, variant, p, min(d) AS d FROM d GROUP BY 1, 2, 3, 4), k AS (SELECT a, b, variant, q, min(d) AS d FROM d GROUP BY 1, 2, 3, 4), "
        "s AS (SELECT a, b, variant FROM f WHERE p % 4 = 0 GROUP BY 1, 2, 3 HAVING avg(d) <= 2.0), "
        "m AS (SELECT a, b, variant, avg(d) AS mean, quantile_cont(d, 0.95) AS p95 FROM (SELECT a, b, variant, d FROM f UNION ALL SELECT a, b, variant, d FROM k) AS x SEMI JOIN s USING (a, b, variant) GROUP BY 1, 2, 3) "
        "SELECT a, b, variant, round(mean, 6) AS mean, round(p95, 6) AS p95 FROM m WHERE mean <= 1.0 AND p95 <= 1.0 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY m.mean, variant) = 1"
    ),
    "g07_mask_components": (
        "WITH RECURSIVE m AS (SELECT sample_id, v, u, v * 1000 + u AS id FROM {px} WHERE mask), e AS (SELECT a.sample_id, a.id AS x, b.id AS y FROM m AS a JOIN m AS b ON a.sample_id = b.sample_id AND " + _FOUR + " = 1), "
        "r AS (SELECT sample_id, id AS x, id AS reach FROM m UNION SELECT r.sample_id, r.x, e.y FROM r JOIN e ON e.sample_id = r.sample_id AND e.x = r.reach) "
        "SELECT sample_id, count(DISTINCT part) AS parts, count(*) AS pixels FROM (SELECT sample_id, x, min(reach) AS part FROM r GROUP BY 1, 2) AS y GROUP BY 1"
    ),
    "g21_sample_queries": (
        f"WITH {_surface_sql(_CORNERS, 500, 'queries/near')}, roi AS {_ROI}, moved AS (SELECT s.mesh_id, s.point_id, {_OFFSET} FROM surf AS s JOIN t USING (mesh_id, fid)), "
        "every AS (SELECT mesh_id, point_id, x, y, z, true AS near_surface FROM moved JOIN roi USING (mesh_id) WHERE greatest(abs(x - cx), abs(y - cy), abs(z - cz)) <= half "
        f"UNION ALL SELECT mesh_id, point_id, {_FREE}, false FROM roi, range(500) AS q(point_id)) "
        f"SELECT mesh_id, {_ROUNDED}, near_surface, row_number() OVER (PARTITION BY mesh_id ORDER BY sha256('queries/order/' || mesh_id || '/' || near_surface || '/' || point_id)) - 1 AS qid FROM every"
    ),
    "g25_residual_labels": (
        f"WITH {_surface_sql(_POSED, 500, 'residual')}, near AS {_NEAR.replace(_CAM_PTS, '(SELECT mesh_id AS sample_id, point_id, x, y, z FROM surf)')} "
        "SELECT sample_id, count(*) FILTER (hi IS NULL) AS unknown, count(*) FILTER (zc <= hi + 0.005) AS supported, count(*) FILTER (zc > hi + 0.005) AS hidden, count(*) AS points FROM near GROUP BY 1"
    ),
}
SQL.update({name: duck(text) for name, text in _LONG.items()})
