"""Language profiles and predictions against a plain version, with nulls, ties, repeats, empty tables and clashing columns."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from reconlake.llm import language_id, queries

SF = "/root/testdata/sf0.001"


def plain_ngrams(text):
    words = "".join(c if c.isalpha() else "\x01" for c in text.lower()).split("\x01")
    out = Counter()
    for w in filter(None, words):
        w = f"\x01{w}\x01"
        for n in (1, 2, 3):
            out.update(w[k : k + n] for k in range(len(w) - n + 1))
        out.subtract(["\x01", "\x01"])
    # an edge between two words is one gap for both, which changes no n-gram of up to three characters
    return {g: n for g, n in out.items() if n > 0}


def top(counts, most):
    return sorted(counts, key=lambda g: (-counts[g], [0] * (3 - len(g)) + [ord(c) for c in g]))[:most]


def plain(rows, most=language_id.PROFILE):
    total = defaultdict(Counter)
    for d, text, lang in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 5 and lang is not None:
            total[lang].update(plain_ngrams(text or ""))
    known = {lang: {g: k for k, g in enumerate(top(c, most))} for lang, c in total.items() if c}
    out = []
    for d, text, _ in rows:
        grams, held = top(plain_ngrams(text or ""), most), d is None or zlib.crc32(str(d).encode()) % 5 == 0
        if not grams or not known:
            out.append((d, held, "und", 0.0))
            continue
        near = {lang: sum(most - abs(k - r[g]) for k, g in enumerate(grams) if g in r) / (most * len(grams)) for lang, r in known.items()}
        best = max(sorted(near, key=str.encode), key=near.get)
        out.append((d, held, best, near[best]))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(math.isclose(a[3], b[3], abs_tol=1e-12) and 0 <= a[3] <= 1 for a, b in zip(got, want))


def test_registered_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    got = queries.op11_language_id(spark, SF).collect()
    same(got, plain(rows))
    true = {d: lang for d, _, lang in rows}
    held = [r for r in got if r["held_out"]]
    assert sum(true[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_edges(spark):
    texts = [None, "", " 12 ?!\n", "a", "Ä ä ÄÄ", "ab ab ba", "İstanbul straße ǅ", "日本語 の 文", "x" * 100_000, "the cat, the dog\x00the", "été"]
    rows = [(k, t, lang) for lang in ("en", "xx", None, "") for k, t in enumerate(texts * 2, 7 * len(lang or "?"))]
    rows += [(None, "no id here", "en"), (3, "the cat", "en"), (3, "the cat", "en")]
    wide = [(d, t, lang, "c", 0.5, True, 1, 2) for d, t, lang in rows]
    docs = spark.createDataFrame(wide, "doc_id long, text string, lang string, lang_pred string, score double, held_out boolean, gram int, `rank` int")
    same(language_id.identify(docs.repartition(3)).collect(), plain(rows))
    assert language_id.identify(docs.limit(0)).collect() == []
    unlearned = language_id.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("doc_id is null")).collect()
    assert [(r["lang_pred"], r["score"]) for r in unlearned] == [("und", 0.0)]


def test_predict_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    known = language_id.profiles(docs)
    got = language_id.predict(docs.selectExpr("doc_id", "text", "'x' as score", "4 as `a.b`"), known).collect()
    assert {(r["doc_id"], r["lang_pred"], r["a.b"]) for r in got} == {(1, "en", 4), (2, "de", 4)}


def test_counts_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(language_id, "COUNTED_TOGETHER", 50)
    docs = spark.createDataFrame([(k, f"w{chr(97 + k % 26)}{chr(97 + k % 7)} the", f"l{k % 2}") for k in range(300)], "doc_id long, text string, lang string").coalesce(1)
    got = language_id.profiles(docs, 10).collect()
    want = defaultdict(Counter)
    for r in docs.collect():
        want[r["lang"]].update(plain_ngrams(r["text"]))
    for lang, c in want.items():
        assert [r["n"] for r in sorted((r for r in got if r["lang"] == lang), key=lambda r: r["rank"])] == [c[g] for g in top(c, 10)]


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 1)
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.predict(docs, language_id.profiles(docs))
