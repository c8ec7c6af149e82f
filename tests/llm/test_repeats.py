"""Removal of repeated strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from reconlake.llm import suffix_dedup

SCHEMA = "doc_id long, text string, key int, size string, spans string, z int"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, np.int8)
        for k in range(len(t) - length + 1):
            if n[t[k : k + length]] > 1:
                gone[k : k + length] = 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone))))
        cuts = [0, *edge.tolist(), len(t)]
        out.append((len(t), [tuple(x) for x in zip(edge[::2].tolist(), edge[1::2].tolist())], b"".join(t[cuts[k] : cuts[k + 1]] for k in range(0, len(cuts), 2))))
    return out


def texts():
    r = random.Random(11)
    make = lambda n: "".join(r.choice(["the ", "of ", "and ", "über", "ss", "tion ", "x", "日", "\n"]) for _ in range(n))
    passage, tail = make(90), make(40)
    out = [None, "", "short", "a" * 700, "ab" * 300, "a" * 150, make(900), make(3000)]
    out += [make(r.randint(5, 60)) + passage + make(r.randint(5, 60)) for _ in range(9)]
    out += [passage[3:] + tail, passage[:-2], out[6], out[6], out[7][:2000] + "!" + out[7][2001:], tail + passage[5:] + passage[:120]]
    return out


@pytest.mark.parametrize("at_once", [1024, 1])
def test_removal_equals_brute_force(spark, at_once):
    rows = texts()
    docs = spark.createDataFrame([(k, t, 1, "s", "c", 2) for k, t in enumerate(rows)] + [(5, rows[5], 1, "s", "c", 2)], SCHEMA).repartition(3)
    got = suffix_dedup.remove_repeats(docs, length=100, anchor=20, at_once=at_once, keep=("size", "key")).collect()
    want = brute([*rows, rows[5]], 100)
    ids = [*range(len(rows)), 5]
    assert sorted((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got) == sorted((i, *w) for i, w in zip(ids, want))
    assert {r["size"] for r in got} == {"s"}


def test_production_lengths_and_empty_table(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(90)
    rows = [text(300) + passage + text(200), passage, text(50), text(400) + passage[:430], passage[20:450] + text(90), text(3000)]
    rows += [rows[5].replace("a", "b", 3), rows[2]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got) == [(i, *w) for i, w in enumerate(brute(rows, 400))]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_long_texts_are_cut_without_loss():
    r = np.random.default_rng(3)
    text = bytes(r.integers(97, 123, 3 << 20, dtype=np.uint8))
    starts = []
    for idx, off, parts in suffix_dedup._buffers([b"x" * 500, text, b"y" * 400], 400):
        starts += [(i, o + k) for i, o, p in zip(idx, off, parts) if i == 1 for k in (0, len(p) - 400)]
        assert sum(map(len, parts)) <= 1 << 19
    edges = [s for _, s in starts]
    assert edges[0] == 0 and edges[-1] == len(text) - 400 and all(b == a + 1 for a, b in zip(edges[1::2], edges[2::2]))
