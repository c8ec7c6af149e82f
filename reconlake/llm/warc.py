"""Deterministic sharded WARC writer and reader.

Records are range-sorted into shards of about equal payload, each shard is written as files rolled by compressed size, and
files become visible only when the driver renames them and writes the manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.plans.lineage import scratch_path, stored

#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 1000
#: Payload bytes of a shard: a 256th of all, within these bounds. Compressed bytes after which a file is closed.
SHARD_BYTES, ROLL_BYTES = (256 << 10, 256 << 20), 32 << 20
#: Ranges of page_id that shards are put together from, about: as many ids are sampled, and as many sums reach the driver.
RANGES = 1 << 16
#: The date of records, fixed so that the same pages give the same bytes.
DATE = "2020-01-01T00:00:00Z"


def _store(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url if "://" in url else "file://" + url.removeprefix("file:"))


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, its headers made anew from the payload: a response, or a revisit without a body."""
    warc_digest = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    body = b"" if refers_to is not None else payload
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + body
    named = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{k}')}>"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", named(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(url.split()) or "about:blank"),
        ("WARC-Payload-Digest", warc_digest),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", named(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _payloads(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, size, digest): nulls as empty texts, with the payload's bytes and SHA-1."""
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), text.alias("html"))
    return rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))


def _edges(slim: DataFrame) -> np.ndarray:
    """Ids that part the pages into ranges of about equally many: every id of a hash sample of about RANGES ids, rising, distinct.

    The sample follows from the ids alone. Of up to RANGES pages all ids are edges.
    """
    n = slim.count()
    some = slim.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(max(n, 1))) < RANGES)).select("page_id").distinct()
    return np.unique(some.toArrow()["page_id"].to_numpy())


def _spread(slim: DataFrame, at: Column, ranges: int, shard_bytes: int | None) -> tuple[list[int], int]:
    """The shard of each range (consecutive ranges are put together up to shard_bytes), and how many shards there are."""
    got = slim.groupBy(at.alias("at")).agg(F.sum("size").alias("b")).toArrow()
    sizes = dict(zip(got["at"].to_pylist(), got["b"].to_pylist()))
    shard_bytes = shard_bytes or min(max(sum(sizes.values()) // 256, SHARD_BYTES[0]), SHARD_BYTES[1])
    shard, held, out = 0, 0, []
    for k in range(ranges):
        b = sizes.get(k, 0)
        if held and held + b > shard_bytes:
            shard, held = shard + 1, 0
        out.append(shard)
        held += b
        if held > shard_bytes:  # a range of its own, over as many parts as it needs
            shard, held = shard + -(-held // shard_bytes), 0
    return out, shard + bool(held)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int | None = None, roll_bytes: int = ROLL_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes every row of pages as a record under path and returns the manifest: file, shard, records, bytes, sha256.

    Of equal payloads of `least` bytes or more, the largest page_id is a response and the others revisit it. Rows of
    that page_id are responses all. Null html and urls count as empty; null page_ids come first and are never referred to,
    unless all equal payloads have null ids: then all are responses. Files have names by shard and part, so the same pages
    give the same files; shards follow ranges of page_id, and only a range that is larger than a shard is dealt over several. Tasks write under temporary names, one for each attempt; the driver renames the files of finished tasks and
    then writes manifest.json, whose presence means that the archive is complete. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = _payloads(pages, id_col, url_col, html_col)
    slim = stored(rows.select("page_id", "size", "digest"), "digests")
    edges = _edges(slim)

    @F.pandas_udf("int")
    def ranged(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), "right").astype(np.int32))

    # null ids come first, with what is below the first edge
    at = ranged(F.coalesce("page_id", F.lit(-(1 << 63))))
    shards, last = _spread(slim, at, len(edges) + 1, shard_bytes)
    first = slim.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = slim.join(first, "digest").where(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first"))))
    again = again.select("page_id", F.col("digest").alias("d"), "first").distinct()
    listed = lambda x: F.split(F.lit(",".join(map(str, x or [0]))), ",").cast("array<int>")
    # a range larger than a shard is dealt over the shard numbers that are free up to the next range's
    free = [b - a for a, b in zip(shards, [*shards[1:], last])]
    parts = F.greatest(F.get(listed(free), F.col("at")), F.lit(1))
    dealt = F.get(listed(shards), F.col("at")) + F.pmod(F.xxhash64("page_id", "digest"), parts)
    shard = dealt.cast("int").alias("shard")
    nulls = lambda **kinds: [F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    told = again.withColumnRenamed("d", "digest").withColumn("at", at).select(shard, "page_id", "digest", F.lit(0).alias("kind"), "first", *nulls(url="string", html="string"))
    full = rows.withColumn("at", at).select(shard, "page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "html")
    both = told.unionByName(full).repartition(max(1, last), "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    root = path.rstrip("/")
    names = ["temporary", "file", "shard", "records", "bytes", "sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _store(root)
        fs.create_dir(f"{top}/_temporary", recursive=True)
        open_: dict = {}
        refers: dict = {}

        def close() -> Iterator[pa.RecordBatch]:
            if open_:
                open_["out"].close()
                row = [open_["temporary"], open_["file"], open_["shard"], open_["records"], open_["bytes"], open_["sha"].hexdigest()]
                open_.clear()
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=names)

        shard_now, part = None, 0
        for b in batches:
            shard_of, ids, digests, kinds, firsts, urls = (b.column(c).to_pylist() for c in ("shard", "page_id", "digest", "kind", "first", "url"))
            html = b.column("html").cast(pa.binary())
            for k in range(b.num_rows):
                if not kinds[k]:
                    refers = {(ids[k], digests[k]): firsts[k]}
                    continue
                if shard_of[k] != shard_now:
                    yield from close()
                    shard_now, part = shard_of[k], 0
                if not open_:
                    temporary = f"_temporary/{uuid.uuid4().hex}"
                    open_.update(out=fs.open_output_stream(f"{top}/{temporary}", compression=None), temporary=temporary, file=f"pages-{shard_now:06d}-{part:04d}.warc.gz", shard=shard_now, records=0, bytes=0, sha=hashlib.sha256())
                    part += 1
                raw = gzip.compress(record(ids[k], urls[k], html[k].as_py(), digests[k], refers.get((ids[k], digests[k]))), 6, mtime=0)
                open_["out"].write(raw)
                open_["sha"].update(raw)
                open_["records"] += 1
                open_["bytes"] += len(raw)
                if open_["bytes"] >= roll_bytes:
                    yield from close()
        yield from close()

    manifest = stored(both.mapInArrow(run, "temporary string, file string, shard long, records long, bytes long, sha256 string"), "manifest")
    fs, top = _store(root)
    files = sorted((r["file"], r["temporary"], r["records"], r["bytes"], r["sha256"]) for r in manifest.collect())
    fs.create_dir(top, recursive=True)
    for name, temporary, *_ in files:
        fs.move(f"{top}/{temporary}", f"{top}/{name}")
    if fs.get_file_info(f"{top}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{top}/_temporary")
    with fs.open_output_stream(f"{top}/manifest.json.part") as out:
        out.write(json.dumps([dict(zip(("file", "records", "bytes", "sha256"), (f, n_, b_, s_))) for f, _, n_, b_, s_ in files]).encode())
    fs.move(f"{top}/manifest.json.part", f"{top}/manifest.json")
    return manifest.drop("temporary")


def members(raw: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, one by one."""
    at = memoryview(raw)
    while len(at):
        d = zlib.decompressobj(wbits=31)
        yield d.decompress(at)
        at = at[len(at) - len(d.unused_data) :]


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record (empty for revisits); its block digest must hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't match its digest")
    return fields, block.partition(b"\r\n\r\n")[2]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload): every record of a complete archive.

    Sizes and digests of responses are taken from the payload that was read. An archive without its manifest, or with
    missing files, is an error.
    """
    fs, top = _store(path.rstrip("/"))
    with fs.open_input_stream(f"{top}/manifest.json") as f:
        manifest = json.loads(f.read())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    if not manifest:
        return spark.createDataFrame([], schema)
    files = [f"{path.rstrip('/')}/{m['file']}" for m in manifest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                out, held = [], 0
                for m in members(raw.as_py()):
                    h, payload = parse(m)
                    number = lambda k: int(h[k]) if h.get(k) else None
                    if h["WARC-Type"] == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    else:
                        size, digest = number("X-Payload-Length"), base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
                    out.append((number("X-Page-Id"), h["WARC-Target-URI"], size, digest, h["WARC-Type"], number("X-Refers-To-Page"), payload))
                    held += len(payload)
                    if held > 4 << 20:
                        yield _batch(out)
                        out, held = [], 0
                if out:
                    yield _batch(out)

    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(names))


def archived(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes pages under path (a new one in the shared folder by default) and reads the archive back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(pages, path, **options)
    return read(spark, path)
