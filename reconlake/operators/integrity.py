"""Integrity, provenance and contract checks. A check returns what is wrong; an empty result means that all is well."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_bindings(refs: DataFrame, inventory: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """Refs with status ok, changed or missing against the digests of an inventory with one row a path."""
    actual = inventory.select(F.col(path).alias("_p"), F.col(digest).alias("_d"))
    status = F.when(F.col("_p").isNull(), "missing").when(F.col(digest).eqNullSafe(F.col("_d")), "ok").otherwise("changed")
    return refs.join(actual, F.col(path) == F.col("_p"), "left").withColumn("status", status).drop("_p", "_d")


def check_binding_chain(refs: DataFrame, inventory: DataFrame, roots: DataFrame, depth: int, parent: str = "parent", path: str = "path", digest: str = "sha256") -> DataFrame:
    """Bindings reached from the roots over at most `depth` levels, each with its level and status."""
    checked = check_bindings(refs, inventory, path, digest)
    level = checked.join(roots.select(F.col(path).alias(parent)).distinct(), parent, "left_semi").withColumn("level", F.lit(1))
    out = level
    for k in range(2, depth + 1):
        level = checked.join(level.select(F.col(path).alias(parent)).distinct(), parent, "left_semi").withColumn("level", F.lit(k))
        out = out.unionByName(level)
    return out


def canonical_digest(df: DataFrame, cols: list[str]) -> DataFrame:
    """Df with row_digest, the hash of its named columns as JSON with sorted keys. Canonical within this library only."""
    return df.withColumn("row_digest", F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256))


def ordered_digest(df: DataFrame, by: list[str], order: list[str], line: Column, between: bytes, digest: str, count: str) -> DataFrame:
    """(by, digest, count): SHA-256 of each group's lines in order, and its rows.

    Groups are brought together and sorted by Spark, which spills; a task reads them as one stream and holds one running hash, so a
    group of any size needs no more memory than a small one. Null lines add nothing to the hash; null keys are a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashed, n, begun = None, hashlib.sha256(), 0, False

        def row() -> pa.RecordBatch:
            columns = [pa.array([v], t) for v, t in zip(key, types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([hashed.hexdigest()]), pa.array([n], pa.int64())], names=[*by, digest, count])

        types = []
        for b in batches:
            types = [c.type for c in b.columns[:-1]]
            keys = zip(*[c.to_pylist() for c in b.columns[:-1]]) if by else repeat((), len(b))
            for k, text in zip(keys, b.columns[-1].to_pylist()):
                if k != key:
                    if key is not None:
                        yield row()
                    key, hashed, n, begun = k, hashlib.sha256(), 0, False
                n += 1
                if text is not None:
                    hashed.update(between + text.encode() if begun else text.encode())
                    begun = True
        if key is not None:
            yield row()

    rows = df.select(*by, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], line.alias("_line"))
    rows = (rows.repartition(*by) if by else rows.coalesce(1)).sortWithinPartitions(*by, *[f"_o{k}" for k in range(len(order))])
    kinds = dict(df.dtypes)
    return rows.select(*by, "_line").mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"`{digest}` string", f"`{count}` long"]))


def rowset_digest(df: DataFrame, by: list[str], digest: str) -> DataFrame:
    """Hash of each group's sorted row digests, joined by line feeds, and its rows; rows without a digest count only there."""
    return ordered_digest(df, by, [digest], F.col(digest), b"\n", "digest", "n")


def bundle_digest(df: DataFrame, by: list[str], path: str, digest: str) -> DataFrame:
    """Hash of a bundle's files as ordered path, NUL, digest, newline; files without a path or digest only count."""
    p = F.col(path).cast("string")
    return ordered_digest(df.withColumn("_p", p), by, ["_p", digest], F.concat("_p", F.lit("\0"), F.col(digest), F.lit("\n")), b"", "bundle_sha256", "files")


def array_digest(dtype: Column, shape: Column, content: Column) -> Column:
    """Hash of an array's type, shape (as JSON) and bytes."""
    return F.sha2(F.concat(F.encode(dtype, "UTF-8"), F.encode(F.to_json(shape), "UTF-8"), content), 256)


def check_paths(df: DataFrame, path: str) -> DataFrame:
    """Rows whose path is empty, absolute, or leaves its root on the way."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(s == "..", -1).otherwise(1)).alias("low")))
    bad = F.coalesce(F.trim(path), F.lit("")).eqNullSafe(F.lit("")) | F.col(path).startswith("/") | (depth["low"] < 0)
    return df.where(F.coalesce(bad, F.lit(True)))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, violation): a row for each rule that a record breaks. A rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return df.select(key, F.explode(broken).alias("violation"))


def validate_assets(df: DataFrame) -> DataFrame:
    """Violations of asset records: text fields, digests, sizes, and provenance where an asset is derived."""
    text = lambda c: F.length(F.trim(c)) > 0
    rules = {f"{c} is required": text(c) for c in ("asset_id", "uri", "family", "license")}
    rules["sha256 is malformed"] = F.col("sha256").rlike("^[0-9a-f]{64}$")
    rules["size_bytes is not positive"] = F.col("size_bytes") > 0
    rules["derived assets need lineage_root"] = ~F.col("derived") | F.coalesce(text("lineage_root"), F.lit(False))
    return violations(df, "asset_id", rules)


def check_copied(left: DataFrame, right: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, field) wherever a copied field differs from its source; a missing source differs in every field."""
    src = right.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in cols])
    joined = left.join(src, F.col(key) == F.col("_k"), "left")
    diff = F.array_compact(F.array(*[F.when(F.col("_k").isNull() | ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in cols]))
    return joined.select(key, F.explode(diff).alias("field"))


def check_order(a: DataFrame, b: DataFrame, by: str, position: str, key: str) -> DataFrame:
    """Positions at which two ordered lists differ, ends included."""
    x = a.select(by, position, F.col(key).alias("left_id"))
    y = b.select(by, position, F.col(key).alias("right_id"))
    return x.join(y, [by, position], "full_outer").where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def check_file_sets(df: DataFrame, sample: str, name: str, allowed: list[str]) -> DataFrame:
    """Samples whose files aren't just the allowed ones, with what is missing and what is extra."""
    want = F.array(*[F.lit(x) for x in sorted(allowed)])
    sets = df.groupBy(sample).agg(F.collect_set(name).alias("_s"))
    out = sets.select(sample, F.array_join(F.array_sort(F.array_except(want, "_s")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("_s", want)), ",").alias("extra"))
    return out.where("missing <> '' or extra <> ''")


def check_parity(new: DataFrame, old: DataFrame, key: list[str], value: str, tol: float) -> DataFrame:
    """Keys whose recomputed value is off by more than tol, or defined on one side only."""
    x, y = new.select(*key, F.col(value).alias("new_value")), old.select(*key, F.col(value).alias("old_value"))
    close = (F.abs(F.col("new_value") - F.col("old_value")) <= tol) | (F.col("new_value").isNull() & F.col("old_value").isNull())
    return x.join(y, key, "full_outer").where(~F.coalesce(close, F.lit(False)))


def check_step_log(log: DataFrame, run: str, step: str, start: int = 1) -> DataFrame:
    """Per run: steps, distinct ones, the first gap (null if none), and whether they go from `start` on without gap or repeat."""
    one = log.select(run, step).distinct()
    before = F.lag(step, 1).over(Window.partitionBy(run).orderBy(step))
    gap = F.when(F.coalesce(before, F.lit(start - 1)) + 1 != F.col(step), F.coalesce(before, F.lit(start - 1)) + 1)
    gaps = one.withColumn("_g", gap).groupBy(run).agg(F.min("_g").alias("first_gap"), F.count("*").alias("distinct_steps"))
    n = log.groupBy(run).agg(F.count("*").alias("steps"))
    return n.join(gaps, run).withColumn("continuous", F.col("first_gap").isNull() & (F.col("steps") == F.col("distinct_steps")))


def drop_stale_tail(log: DataFrame, run: str, step: str, attempt: str) -> DataFrame:
    """After a resume, steps of earlier attempts from the later attempt's first step on are dropped."""
    starts = log.groupBy(run, F.col(attempt).alias("_a")).agg(F.min(step).alias("_first"))
    least = F.min("_first").over(Window.partitionBy(run).orderBy(F.col("_a").desc()).rowsBetween(Window.unboundedPreceding, -1))
    cut = starts.select(F.col(run).alias("_r"), "_a", least.alias("_cut"))
    return log.join(cut, (F.col(run) == F.col("_r")) & (F.col(attempt) == F.col("_a"))).where("_cut is null or " + step + " < _cut").drop("_r", "_a", "_cut")


def compare_prefix(a: DataFrame, b: DataFrame, step: str, value: str) -> DataFrame:
    """Over common steps of two curves: how many, largest and mean absolute difference, and whether they are identical."""
    x, y = a.select(step, F.col(value).alias("_x")), b.select(step, F.col(value).alias("_y"))
    d = F.abs(F.col("_x") - F.col("_y"))
    return x.join(y, step).agg(F.count("*").alias("steps"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"), F.coalesce(F.bool_and(F.col("_x").eqNullSafe(F.col("_y"))), F.lit(True)).alias("identical"))


def audit_cache(df: DataFrame, key: str, members: dict[str, tuple[str, int]]) -> DataFrame:
    """Violations of cache entries: members (array columns) missing, of another type or length, not finite or negative."""
    kinds = dict(df.dtypes)
    rules: dict[str, Column] = {}
    for name, (kind, size) in members.items():
        rules[f"{name} has another type"] = F.lit(kinds.get(name) == f"array<{kind}>")
        if name not in kinds:
            rules[f"{name} is missing"] = F.lit(False)
            continue
        rules[f"{name} is missing"] = F.col(name).isNotNull()
        rules[f"{name} has another length"] = F.size(name) == size
        rules[f"{name} is not finite"] = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rules[f"{name} is negative"] = ~F.exists(name, lambda x: x < 0)
    return violations(df, key, rules)


def check_pixels(a: DataFrame, b: DataFrame, sample: str, channels: list[str]) -> DataFrame:
    """Per sample, pixels of either side that are missing on the other or differ in a channel."""
    keys = [sample, "v", "u"]
    x = a.select(*keys, F.struct(*channels).alias("_x"))
    y = b.select(*keys, F.struct(*channels).alias("_y"))
    same = F.coalesce(F.to_json("_x") == F.to_json("_y"), F.lit(False))
    return x.join(y, keys, "full_outer").groupBy(sample).agg(F.count_if(~same).alias("mismatches"), F.count("*").alias("pixels"))


def classify_transform(df: DataFrame, m: list[str], scale: str | None = None, tol: float = 1e-4) -> DataFrame:
    """I16: verdict on 12 coefficients r11 r12 r13 t1 ...: the first that holds of non_finite, singular, reflection, shear,
    non_uniform_scale, scale_drift (against a declared scale) and accepted; and the scale."""
    from reconlake.functions.expr import _gram, determinant

    g, det = _gram(m), determinant(m)
    finite = reduce(lambda p, q: p & q, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in m])
    size = [F.sqrt(g[k][k]) for k in range(3)]
    mean = (size[0] + size[1] + size[2]) / 3
    shear = F.greatest(F.abs(g[0][1]), F.abs(g[0][2]), F.abs(g[1][2])) > tol * mean * mean
    uneven = F.greatest(*size) - F.least(*size) > tol * mean
    verdict = F.when(~finite, "non_finite").when(F.abs(det) < 1e-12, "singular").when(det < 0, "reflection").when(shear, "shear").when(uneven, "non_uniform_scale")
    if scale:
        verdict = verdict.when(F.abs(mean - F.col(scale)) > tol * F.col(scale), "scale_drift")
    return df.withColumn("verdict", verdict.otherwise("accepted")).withColumn("scale_found", F.when(finite, mean))


def disjoint(df: DataFrame, role: str, key: str) -> DataFrame:
    """Keys that have more than one role, with how many."""
    return df.groupBy(key).agg(F.count_distinct(role).alias("roles")).where("roles > 1")


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Rows of different sources in one key space; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, as missing or extra."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    missing = e.join(a, key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(a.join(e, key, "left_anti").withColumn("problem", F.lit("extra")))


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key; maxima are combined before the shuffle."""
    rest = [c for c in df.columns if c not in (key, order)]
    out = df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return out.select(key, *[F.col(f"_r.{c}").alias(c) for c in (order, *rest)])


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
