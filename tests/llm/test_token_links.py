"""Alignments against plain loops over whole texts encoded by the libraries, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reconlake.llm import queries, token_links
from reconlake.llm.bpe import byte_letters

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_letters()
    bytes_a = {i: bytes(letters[c] for c in s) for s, i in a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in s)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    bytes_b = {i: piece(i) for i in range(b.vocab_size())}
    return a, b, bytes_a, bytes_b


def tokens(libraries, text):
    a, b, bytes_a, bytes_b = libraries
    raw = (" " + text).encode() if text else b""
    if not text:
        return None
    out = []
    for ids, known in ((a.encode(" " + text, add_special_tokens=False).ids, bytes_a), (b.encode(text), bytes_b)):
        if b"".join(known[i] for i in ids) != raw:
            return None
        end, at = [], 0
        for i in ids:
            at += len(known[i])
            end.append(at)
        out.append((ids, end))
    return out


def brute(libraries, rows):
    """Rows of the contract, by loops."""
    docs, corpus = [], Counter()
    for d, text in rows:
        got = tokens(libraries, text)
        if got is None:
            docs.append((d, None))
            continue
        (ids_a, end_a), (ids_b, end_b) = got
        by_end = {}
        for j, e in zip(ids_b, end_b):
            by_end.setdefault(e, []).append(j)
        links = [(i, j) for i, e in zip(ids_a, end_a) for j in by_end.get(e, ())]
        corpus.update(links)
        cuts, groups, x, y = sorted(set(end_a) & set(end_b)), [], 0, 0
        for c in cuts:
            p, q = x, y
            while x < len(end_a) and end_a[x] <= c:
                x += 1
            while y < len(end_b) and end_b[y] <= c:
                y += 1
            groups.append(",".join(map(str, ids_a[p:x])) + "|" + ",".join(map(str, ids_b[q:y])))
        docs.append((d, (len(ids_a), len(ids_b), groups, links)))
    best = {}
    for (_, j), n in corpus.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for d, x in docs:
        if x is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        out.append((d, n_a, n_b, len(groups), len(links), sum(corpus[p] == best[p[1]] for p in links), sum(corpus[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_registered_query(spark, libraries):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = queries.op12_cross_tokenizer_alignment(spark, SF)
    assert got.columns[:8] == COLUMNS and all(t == "bigint" for c, t in got.dtypes if c != "groups_sha256")
    assert sorted(tuple(r)[:8] for r in got.collect()) == sorted(brute(libraries, rows))


def test_edges(spark, libraries):
    r = random.Random(3)
    lexicon = ["the", "of", "Tion", "über", "naïve", "日本", "q" * 40, "re,", "it's", "▁x", "<s>", "<|endoftext|>", "<0x41>", "👩‍👩‍👧", "á", " ", "\t", "\n", "  ", "12345"]
    texts = [None, "", " ", "    ", "a", "a▁b", "<|endoftext|>", "x" * 50_000, " " * 5_000, "\n\n\n", "ﬁ ①　x", "\x00 nul", "a  b\n\n c\t<s>d </s>  ", "\x1c \x85 ﻿"]
    texts += ["".join(r.choice(lexicon) + r.choice(["", " ", "  "]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(3, "a"), (3, "a"), (None, "the of")]
    docs = spark.createDataFrame([(d, t, "g", [1], 2, "s") for d, t in rows], "doc_id long, text string, groups string, pairs array<int>, n int, n_best string").repartition(3)
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted((tuple(x[c] for c in COLUMNS) for x in token_links.align(docs, A, B).collect()), key=order) == sorted(brute(libraries, rows), key=order)
    assert token_links.align(docs.limit(0), A, B).collect() == []
    assert [tuple(x[c] for c in COLUMNS) for x in token_links.align(docs.where("text is null"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab zé日 \t\n.▁'1 "), max_size=40))
def test_parts_equal_whole_texts(libraries, text):
    (got,) = token_links._aligned([text], A, B)
    want = tokens(libraries, text)
    assert (got is None) == (want is None)
    if got:
        assert (got.n_a, got.n_b) == tuple(len(ids) for ids, _ in want)
        assert [x for g in got.groups.split(";") for x in g.split("|")[0].split(",")] == list(map(str, want[0][0]))
        assert [x for g in got.groups.split(";") for x in g.split("|")[1].split(",")] == list(map(str, want[1][0]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.lists(st.integers(1, 5), min_size=1, max_size=12))
def test_products_are_those_of_dense_matrices(x, y):
    total = max(sum(x), sum(y))
    x, y = x + [total - sum(x)] * (sum(x) < total), y + [total - sum(y)] * (sum(y) < total)
    own = lambda v: np.array([[s <= k < s + n for k in range(total)] for s, n in zip(np.cumsum([0, *v]), v)], int)
    both = token_links.Alignment.of(np.array(x), np.array(y))
    dense = own(x) @ own(y).T
    a, b, n = both.overlaps()
    assert list(zip(a, b)) == list(zip(*np.nonzero(dense))) and list(n) == list(dense[np.nonzero(dense)])
    group = lambda v: np.array([[int(sum(c < e for c in both.cuts) == g) for g in range(len(both.cuts))] for e in np.cumsum(v)])
    a, b = both.group_links()
    assert list(zip(a, b)) == list(zip(*np.nonzero(group(x) @ group(y).T)))
    a, b = both.end_links()
    assert list(both.end_a[a]) == list(both.end_b[b]) == list(both.cuts)
