"""Secret scans: candidate spans in each text, judged by how many repositories and owners share the same value."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.plans.lineage import stored

#: Base kinds first; the others are reported only where their value is owner-specific and looks live.
KINDS = ("assign", "access", "hex", "jwt", "vendor", "private")
BASE = 3
#: A value is widely copied if more than MAX_OWNERS owners hold it, or several owners in more than MAX_REPOS repositories. One
#: owner's value stays owner-specific in any number of repositories, and so does one that a few owners share.
MAX_OWNERS, MAX_REPOS = 3, 10
#: Least entropy of a live-looking value, in bits a character.
MIN_BITS = 2.5
#: Parts of values that are placeholders.
PLACEHOLDERS = ("example", "changeme", "placeholder", "xxxx", "dummy", "your_", "redacted")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
_VENDOR = re.compile(r"(?:ghp|gho|ghs|xoxb|xoxp|sk_live|rk_live|glpat)[_-][A-Za-z0-9_-]{16,}")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}?-----END (?:[A-Z]+ )?PRIVATE KEY-----")
#: What a text with any candidate matches, for Spark's rlike.
MAY_HOLD = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|eyJ|ghp|gho|ghs|xoxb|xoxp|sk_live|rk_live|glpat|PRIVATE KEY"


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value), ordered; ends are exclusive, in code points."""
    out = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    for kind, pattern in enumerate((_ACCESS, _HEX, _JWT, _VENDOR, _PRIVATE), 1):
        out += [(m.start(), kind, m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(out)


def looks_live(value: str) -> bool:
    """No placeholder, and characters that vary enough."""
    low = value.lower()
    if any(x in low for x in PLACEHOLDERS):
        return False
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values()) >= MIN_BITS


_FOUND = "array<struct<start:int,kind:int,end:int,digest:string,lively:boolean>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None) -> DataFrame:
    """(id, repo, owner, n_assign, n_access, n_hex, base_sha256, text_key, found): one row per input row.

    The owner is owner_col, or the part of the repository's name before a slash (all of it without one).
    text_key, the digest of the text, is null where nothing was found. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("repo", pa.string()), ("owner", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("text_key", pa.string()), ("found", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("digest", pa.string()), ("lively", pa.bool_())])))])
        for b in batches:
            rows = []
            for t in b.column(3):
                text = t.as_py() or ""
                found = candidates(text)
                n = Counter(k for _, k, _, _ in found)
                base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found if k < BASE)
                full = [{"start": s, "kind": k, "end": e, "digest": hashlib.sha256(v.encode()).hexdigest()[:32], "lively": looks_live(v)} for s, k, e, v in found]
                key = hashlib.sha256(text.encode()).hexdigest() if found else None
                rows.append((n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), key, full))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[3:]))], schema=schema)

    owner = F.col(owner_col) if owner_col else F.substring_index(F.col(repo_col).cast("string"), "/", 1)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(repo_col).cast("string").alias("repo"), owner.cast("string").alias("owner"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, text_key string, found {_FOUND}")


def ownership(scanned: DataFrame) -> DataFrame:
    """(digest, n_repos, n_owners) of every candidate value in the corpus; null repositories and owners count as one."""
    rows = scanned.where("text_key is not null").select(F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"), F.explode("found.digest").alias("digest"))
    pairs = rows.distinct().groupBy("digest", "owner").agg(F.count("*").alias("n"))
    return pairs.groupBy("digest").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def verdicts(scanned: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(text_key, judged): for each distinct text, its spans by start and kind, each with live and copied."""
    texts = scanned.where("text_key is not null").select("text_key", "found").dropDuplicates(["text_key"])
    rows = texts.select("text_key", F.explode("found").alias("f")).select("text_key", "f.*").join(ownership(scanned), "digest")
    copied = (F.col("n_owners") > max_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") > max_repos))
    rows = rows.select("text_key", F.struct("start", "kind", "end", (~copied & F.col("lively")).alias("live"), copied.alias("copied")).alias("s"))
    return rows.groupBy("text_key").agg(F.array_sort(F.collect_list("s")).alias("judged"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied): one row per input row.

    spans holds every base span, and spans of the further kinds whose value is owner-specific and looks live.
    n_live counts all such spans, n_copied those whose value is widely copied (verdicts). Null and empty texts
    have no spans; repeated rows stay repeated; an empty table gives an empty table. Other columns are not read.
    """
    rows = stored(scan(docs, id_col, text_col, repo_col, owner_col), "scanned")
    cols = ["id", "n_assign", "n_access", "n_hex", "base_sha256"]
    spans = F.filter("judged", lambda s: (s["kind"] < BASE) | s["live"])
    with_spans = rows.where("text_key is not null").select(*cols, "text_key").join(verdicts(rows, max_owners, max_repos), "text_key").select(
        *cols, _listed(spans).alias("spans"), F.size(F.filter("judged", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("judged", lambda s: s["copied"])).cast("long").alias("n_copied")
    )
    none = rows.where("text_key is null").select(*cols, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    return with_spans.unionByName(none).withColumnRenamed("id", "doc_id")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, mark: str = "[secret]", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """docs with every live span of the text replaced by mark; widely copied examples stay. Same columns and rows.

    Overlapping live spans get one mark. Null texts stay null. Each row is carried as one column, so columns of any name are
    kept as they are. An empty table gives an empty table.
    """
    rows = stored(scan(docs, id_col, text_col, repo_col, owner_col), "scanned")
    live = verdicts(rows, max_owners, max_repos).select("text_key", F.filter("judged", lambda s: s["live"]).alias("spans")).where(F.size("spans") > 0)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("body"))
    holds = F.coalesce(F.col("body").rlike(MAY_HOLD), F.lit(False))
    maybe = given.where(holds).withColumn("key", F.sha2("body", 256)).join(live, F.col("key") == F.col("text_key"), "left")
    text = F.col("body")
    # pieces between spans, in code points; overlapping spans are merged by the running end
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        a, b = s["start"], s["end"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(a - acc["at"], F.lit(0))), F.when(a >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(more.alias("out"), F.greatest(acc["at"], b).alias("at"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    maybe = maybe.select("row", F.when(F.col("spans").isNotNull(), done).otherwise(text).alias("body"))
    both = maybe.unionByName(given.where(~holds))
    return both.select(*[(F.col("body") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
