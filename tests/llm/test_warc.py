"""Archives written and read back: exact round trips, revisits, determinism, damage."""

import hashlib
import json
import os

import pytest

from reconlake.llm import warc

SCHEMA = "page_id long, url string, html string, shard int, digest string, kind string, first string"


def rows():
    big, other = "größe " * 300, "x" * 1000
    out = [(k, f"http://a.example/{k}", f"<p>page {k}</p>" * (k % 7)) for k in range(60)]
    out += [(100 + 3 * k, "http://b.example/", big) for k in range(9)] + [(200, "u\r\nWARC-Type: x", other), (90, None, other), (201, "u", "x" * 999), (202, "u", "x" * 999)]
    out += [(300, "u", None), (301, "u", ""), (124, "twice", big), (None, "null id", other), (1 << 40, "far", "y" * 5000)]
    return out


def test_round_trip(spark, tmp_path):
    data = rows()
    pages = spark.createDataFrame([(*r, 1, "d", "k", "f") for r in data], SCHEMA).repartition(3)
    top = {}
    for i, _, h in data:
        if len((h or "").encode()) >= 1000 and i is not None:
            top[h] = max(top.get(h, i), i)
    want = []
    for i, _, h in data:
        raw = (h or "").encode()
        first = top.get(h) if len(raw) >= 1000 else None
        again = first is not None and i != first
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None, b"" if again else raw))
    key = lambda x: tuple((v is None, v) for v in x)
    seen = []
    for n, parts in ((0, 1), (1, 5)):
        path = f"{tmp_path}/w{n}"
        files = warc.write(pages.repartition(parts), path, shard_bytes=4000, roll_bytes=600)
        assert files.count() == len(json.load(open(f"{path}/manifest.json"))) > 4
        assert sorted(x for x in os.listdir(path) if not x.startswith((".", "_"))) == sorted([*(m["file"] for m in json.load(open(f"{path}/manifest.json"))), "manifest.json"])
        got = warc.read(spark, path).drop("url").collect()
        assert sorted((tuple(r)[:5] + (bytes(r["payload"]),) for r in got), key=key) == sorted(want, key=key)
        seen.append(json.load(open(f"{path}/manifest.json")))
    assert seen[0] == seen[1]
    for m in seen[0]:
        raw = open(f"{path}/{m['file']}", "rb").read()
        assert (hashlib.sha256(raw).hexdigest(), len(raw), sum(1 for _ in warc.members(raw))) == (m["sha256"], m["bytes"], m["records"])


def test_empty_table_and_damage(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.archived(none).count() == 0
    raw = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parse(raw)[1] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"pay1oad"))
    with pytest.raises(FileNotFoundError):
        warc.read(spark, f"{tmp_path}/nothing")


def test_shards_follow_the_ids(spark, tmp_path):
    """Ids at both ends of long and one far from the rest: files of different shards hold ids of ranges that don't overlap."""
    ends = [-(1 << 63), -(1 << 63) + 1, 1 << 62, (1 << 63) - 2, (1 << 63) - 1]
    data = [(i, "u", f"{i} " * 40) for i in [*range(3000), *ends]]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(4)
    for name, most in (("all", warc.RANGES), ("sampled", 500)):
        old, warc.RANGES = warc.RANGES, most
        try:
            warc.write(pages, f"{tmp_path}/{name}", shard_bytes=60_000)
        finally:
            warc.RANGES = old
        spans = {}
        for m in json.load(open(f"{tmp_path}/{name}/manifest.json")):
            raw = open(f"{tmp_path}/{name}/{m['file']}", "rb").read()
            ids = [int(warc.parse(x)[1].split()[0]) for x in warc.members(raw)]
            assert ids == sorted(ids)
            shard = m["file"].split("-")[1]
            low, high = spans.get(shard, (ids[0], ids[0]))
            spans[shard] = min(low, *ids), max(high, *ids)
        spans = [spans[k] for k in sorted(spans)]
        assert len(spans) >= 5 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        assert sorted(r["page_id"] for r in warc.read(spark, f"{tmp_path}/{name}").collect()) == sorted(i for i, *_ in data)
