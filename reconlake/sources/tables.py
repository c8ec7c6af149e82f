"""Scans and sinks: manifests, annotation maps, meshes as text, inventories, exclusive publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_manifest(spark: SparkSession, path: str, row_schema: str, status: str | None = None) -> DataFrame:
    """The rows of JSON manifests {..., "rows": [...]}. With status, a manifest of another status fails the query when read."""
    schema = T.StructType([T.StructField("status", T.StringType()), T.StructField("rows", T.ArrayType(T._parse_datatype_string(row_schema)))])
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    if status is not None:
        df = df.where(F.when(F.col("status") == status, F.lit(True)).otherwise(F.raise_error("a manifest doesn't have the required status").cast("boolean")))
    return df.select(F.inline("rows"))


def read_jsonl(spark: SparkSession, path: str, schema: str, keep: Column | None = None) -> DataFrame:
    """Typed rows of JSON lines, optionally filtered. Check ids with duplicates()."""
    df = spark.read.schema(schema).json(path)
    return df.where(keep) if keep is not None else df


def read_annotations(spark: SparkSession, gt_paths: str, info_paths: str, camera_paths: str) -> DataFrame:
    """One row an instance from maps image id -> instances, zipped by position with their info and joined to the cameras.

    Files lie in a folder a scene, whose name is the scene's id.
    """
    scene = F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]+)/[^/]+$", 1).cast("long").alias("scene_id")
    read = lambda path, value: spark.read.option("wholetext", True).text(path).select(scene, F.explode(F.from_json("value", f"map<string,{value}>")).alias("image", "v")).withColumn("image_id", F.col("image").cast("long"))
    gt = read(gt_paths, "array<struct<obj_id:int,cam_R_m2c:array<double>,cam_t_m2c:array<double>>>").select("scene_id", "image_id", F.posexplode("v").alias("gt_id", "g")).select("scene_id", "image_id", "gt_id", "g.*")
    info = read(info_paths, "array<struct<px_count_visib:long,visib_fract:double>>").select("scene_id", "image_id", F.posexplode("v").alias("gt_id", "i")).select("scene_id", "image_id", "gt_id", "i.*")
    cams = read(camera_paths, "struct<cam_K:array<double>,depth_scale:double>").select("scene_id", "image_id", "v.*")
    return gt.join(info, ["scene_id", "image_id", "gt_id"]).join(cams, ["scene_id", "image_id"])


def read_catalog(pages: DataFrame, owner: str) -> DataFrame:
    """Records of catalogue pages (page, records array) before the first empty page, of one owner, last record of a name."""
    end = pages.where(F.size("records") == 0).agg(F.min("page").alias("_end"), F.lit(0).alias("_k"))
    rows = pages.withColumn("_k", F.lit(0)).join(end, "_k").where("_end is null or page < _end").select("page", F.posexplode("records").alias("pos", "r")).select("page", "pos", "r.*").where(F.col("owner") == owner)
    rest = [c for c in rows.columns if c not in ("name", "page", "pos")]
    last = rows.groupBy("name").agg(F.max(F.struct("page", "pos", *rest)).alias("_m"))
    return last.select("name", *[F.col(f"_m.{c}").alias(c) for c in rest])


def read_obj_text(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, faces and flags of OBJ lines (mesh_id, line_no, value). Faces of more corners become fans; negative indices count back.

    Vertices are numbered in line order within their mesh.
    """
    part = F.split(F.trim("value"), r"\s+")
    v = lines.where(F.col("value").startswith("v ")).withColumn("vid", F.row_number().over(Window.partitionBy("mesh_id").orderBy("line_no")) - 1)
    vertices = v.select("mesh_id", "vid", *[F.get(part, F.lit(k + 1)).try_cast("double").alias(a) for k, a in enumerate("xyz")])
    seen = F.sum(F.col("value").startswith("v ").cast("int")).over(Window.partitionBy("mesh_id").orderBy("line_no"))
    f = lines.where(F.col("value").startswith("v ") | F.col("value").startswith("f ")).withColumn("_seen", seen).where(F.col("value").startswith("f "))
    corner = F.transform(F.slice(part, 2, 1 << 20), lambda c: F.substring_index(c, "/", 1).try_cast("int"))
    f = f.withColumn("_c", F.transform(corner, lambda i: F.when(i < 0, F.col("_seen") + i).otherwise(i - 1))).where(F.size("_c") >= 3)
    f = f.select("mesh_id", "line_no", "_c", F.explode(F.sequence(F.lit(1), F.size("_c") - 2)).alias("_k"))
    faces = f.select("mesh_id", (F.col("line_no") * 1000 + F.col("_k")).alias("fid"), F.get("_c", F.lit(0)).cast("long").alias("a"), F.get("_c", F.col("_k")).cast("long").alias("b"), F.get("_c", F.col("_k") + 1).cast("long").alias("c"))
    flags = lines.groupBy("mesh_id").agg(F.bool_or(F.col("value").startswith("vt ")).alias("has_uv"), F.bool_or(F.col("value").startswith("mtllib ")).alias("has_material"))
    return vertices, faces, flags


def text_lines(spark: SparkSession, paths: str, name: Column | None = None) -> DataFrame:
    """Lines of whole text files: mesh_id (name; by default the file's name without ending), line_no, value."""
    if name is None:
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.[^./]*$", 1)
    return spark.read.option("wholetext", True).text(paths).select(name.alias("mesh_id"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def read_material_refs(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Textures that material lines name, with whether the inventory (path) holds them."""
    ref = F.regexp_extract(F.trim("value"), r"^(?:map_\w+|bump|disp)\s+(?:-\S+\s+\S+\s+)*(\S+)$", 1)
    rows = lines.select("mesh_id", F.regexp_replace(F.regexp_replace(ref, r"\\", "/"), r"^\./", "").alias("path")).where("path <> ''").distinct()
    return rows.join(files.select("path").distinct().withColumn("_in", F.lit(True)), "path", "left").select("mesh_id", "path", F.coalesce("_in", F.lit(False)).alias("exists_inside_dataset"))


def archive_inventory(members: DataFrame) -> DataFrame:
    """Per archive its members by kind: annotations (json), rgb, depth and masks by folder."""
    m = F.lower("member")
    return members.groupBy("archive").agg(F.count_if(m.endswith(".json")).alias("annotations"), F.count_if(m.rlike("(^|/)rgb/")).alias("rgb"), F.count_if(m.rlike("(^|/)depth/")).alias("depth"), F.count_if(m.rlike("(^|/)mask[^/]*/")).alias("masks"), F.count("*").alias("members"))


def file_inventory(spark: SparkSession, paths: str) -> DataFrame:
    """Path, sha256 and size of files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size_bytes"))


def scan_assets(files: DataFrame) -> DataFrame:
    """One row a folder of files (path): its id, whether it has a mesh, a material and textures. Ids that two folders share are doubtful."""
    from reconlake.functions.expr import sanitize_id

    folder, name = F.regexp_extract("path", r"^(.*)/[^/]+$", 1), F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    has = lambda p: F.bool_or(name.rlike(p))
    out = files.groupBy(folder.alias("folder")).agg(has(r"\.(obj|ply|glb)$").alias("mesh"), has(r"\.mtl$").alias("material"), has(r"\.(png|jpe?g)$").alias("texture"), F.count("*").alias("files"))
    out = out.withColumn("asset_id", sanitize_id(F.regexp_extract("folder", r"([^/]+)$", 1)))
    twice = out.groupBy("asset_id").agg((F.count("*") > 1).alias("duplicate_id"))
    return out.join(twice, "asset_id")


def publish(df: DataFrame, path: str) -> None:
    """Writes a table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def metric_rows(scores: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Long form: a row a metric, as id columns, metric and value; undefined metrics keep their row with a null value."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return scores.select(*ids, F.explode(pairs).alias("_m")).select(*ids, "_m.metric", "_m.value")


def export_metrics(scores: DataFrame, path: str, ids: list[str], metrics: list[str]) -> None:
    """The long form as CSV with a header."""
    metric_rows(scores, ids, metrics).write.mode("errorifexists").option("header", True).csv(path)


def split_export(df: DataFrame, key: str, public: list[str], truth: list[str]) -> tuple[DataFrame, DataFrame]:
    """Inference inputs without truth and the evaluator's table with it, over the same ids."""
    if set(public) & set(truth):
        raise ValueError("a column can't be public and truth")
    return df.select(key, *public), df.select(key, *truth)
