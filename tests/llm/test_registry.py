"""The registered queries' own columns against brute force and the libraries that the contract names, on the small tables."""

import hashlib
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers

from reconlake.llm import queries
from tests.llm.test_repeats import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_op1_columns(spark, texts):
    got = {r["doc_id"]: r for r in queries.op1_suffix_array_dedup(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for (n, spans, kept), k in zip(brute(list(texts.values()), 400), texts):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_bytes"]) == (n, sum(b - a for a, b in spans), len(spans), len(kept))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        if not spans:
            assert r["text"] == (texts[k] or "")


def test_op8_columns(spark, texts, library):
    got = {r["doc_id"]: r for r in queries.op8_bpe_round_trip(spark, SF).collect()}
    for k, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def plain_best_fit(sizes, capacity=2048):
    rooms, opened = [], 0
    for s in sorted(sizes, reverse=True):
        k = bisect_left(rooms, s)
        if k < len(rooms):
            insort(rooms, rooms.pop(k) - s)
        else:
            opened += 1
            insort(rooms, capacity - s)
    return opened


def test_op9_columns(spark, texts, library):
    rows = queries.op9_best_fit_packing(spark, SF).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 2048)))
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)]).tolist()[:-1] and sum(r["length"] for r in pieces) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= plain_best_fit([r["length"] for r in rows])


def test_op4_and_op5_columns(spark):
    vectors = [(i, v) for i, v in duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall() if v]
    x = np.array([v for _, v in vectors], np.float64)
    ids = np.array([i for i, _ in vectors])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    met = total = 0
    rows = defaultdict(dict)
    for r in queries.op4_ann_kmeans_tree(spark, SF).collect():
        rows[r["query_id"]][r["rank"]] = r
    assert rows.keys() == set(ids[ids % 50 == 0].tolist())
    for q, found in rows.items():
        s = unit @ unit[ids == q][0]
        s[ids == q] = -2
        best = {int(ids[k]) for k in np.lexsort((ids, -s))[:5]}
        assert sorted(found) == [1, 2, 3, 4, 5]
        met, total = met + sum(r["vec_id"] in best for r in found.values()), total + 5
    assert met >= 0.9 * total

    pages = {k: (h or "").encode() for k, h in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()}
    last = {}
    for k, p in sorted(pages.items()):
        last[p] = k
    got = {r["page_id"]: r for r in queries.op5_warc_round_trip(spark, SF).collect()}
    for k, p in pages.items():
        again = len(p) >= 1000 and last[p] != k
        assert tuple(got[k][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == (len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", last[p] if again else None)


def test_op6_and_op7_rows(spark, texts):
    counts = {r["doc_id"]: r for r in queries.op6_trie_token_counts(spark, SF).collect()}
    assert {k: r["n_pretokens"] for k, r in counts.items()} == {k: len((t or "").translate({0x85: "x", 0xA0: "x"}).encode().split()) for k, t in texts.items()}
    said = Counter(duckdb.sql(f"SELECT conv_id, turn FROM '{SF}/conversations.parquet'").fetchall())
    assert Counter((r["conv_id"], r["turn"]) for r in queries.op7_quotation_linking(spark, SF).collect()) == said
