"""Collocations against a plain version, with nulls, ties, repeats, long texts, empty tables, hot prefixes and clashing columns."""

import random
import re
from collections import Counter

import duckdb
import pytest

from reconlake.llm import phrases, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, phrase string, n long, word string, prefix string, segment int, rank int"


def plain(rows, max_words=3, least=10, subsumed=50, most=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, max_words + 1):
                count.update((lang, tuple(w[k : k + n])) for k in range(len(w) - n + 1))
    candidates = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in candidates.items():
        inside = lambda v: any(v[k : k + len(w)] == w for k in range(len(v) - len(w) + 1))
        if any(x == lang and len(v) > len(w) and inside(v) and 100 * f >= subsumed * a for (x, v), f in candidates.items()):
            continue
        cuts = [(1000000 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(w), a, left, right, total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, k + 1, *r[1:]) for k, r in enumerate(own[:most])]
    return sorted(ranked)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    lexicon = ["the", "The", "of", "É", "é", "日本", "x\x1cy", "a\xa0b", "q" * 90, "re", "-", "new", "york", "city"]
    make = lambda n: "".join(r.choice(lexicon) + r.choice([" ", " ", "\t", "  ", ", ", "\n", "! "]) for _ in range(n))
    texts = [None, "", " \t ", ".,;", "one", "new york city " * 30, "the " * 4000, "New York City. new\vyork", *[make(r.randint(1, 120)) for _ in range(60)]]
    out = [(lang, t) for lang in ("en", "und", None, "") for t in texts]
    return out + [out[5]] * 3


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, "p", 1, "w", "p", 2, 3) for k, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)


def test_registered_query(spark):
    rows = duckdb.sql(f"SELECT lang, text FROM '{SF}/documents.parquet'").fetchall()
    out = queries.op13_phrase_collocations(spark, SF)
    assert [t for c, t in out.dtypes if c not in ("lang", "phrase")] == ["bigint"] * 6
    assert rows_of(out) == plain(rows)


def test_edges(docs, rows):
    assert rows_of(phrases.collocations(docs)) == plain(rows)
    assert phrases.collocations(docs.limit(0)).collect() == []
    assert phrases.collocations(docs.where("text is null")).collect() == []


@pytest.mark.parametrize("size,least,most", [(2, 3, 5), (4, 4, 2000)])
def test_other_parameters(docs, rows, size, least, most):
    assert rows_of(phrases.collocations(docs, max_words=size, least=least, subsumed=80, most=most)) == plain(rows, size, least, 80, most)


def test_small_blocks_full_filter_and_hot_prefixes(docs, rows, monkeypatch):
    for name, value in {"BLOCK": 300, "FILTER_BITS": 8, "HEAVY": 3, "SEGMENTS": 4, "FAN": 2}.items():
        monkeypatch.setattr(phrases, name, value)
    assert rows_of(phrases.collocations(docs)) == plain(rows)


def test_entries_of_a_prefix_sum_up_to_its_count(docs, rows):
    one, two, three = phrases.stripes(docs)
    count = {(r["lang"], r["word"]): r["n"] for r in one.collect()}
    for r in two.groupBy("lang", "prefix").sum("n").collect():
        assert count[r["lang"], r["prefix"]] == r["sum(n)"]
    count = {(r["lang"], f"{r['prefix']} {r['word']}"): r["n"] for r in two.collect()}
    for r in three.groupBy("lang", "prefix").sum("n").collect():
        assert count.get((r["lang"], r["prefix"]), r["sum(n)"]) == r["sum(n)"]


def test_large_counts_stay_exact(spark, monkeypatch):
    """Products beyond 64 bits: counts are raised after the stripes are merged."""
    docs = spark.createDataFrame([("en", "aa bb cc. " * 12)], "lang string, text string")
    whole, factor = phrases.stripes, 10**11 + 7
    monkeypatch.setattr(phrases, "stripes", lambda *a: [m.withColumn("n", m["n"] * factor) for m in whole(*a)])
    assert [tuple(r)[2:] for r in phrases.collocations(docs).collect()] == [("aa bb cc", 12 * factor, 12 * factor, 12 * factor, 36 * factor, 1000000)]


def test_one_word_is_no_phrase(docs):
    with pytest.raises(ValueError):
        phrases.collocations(docs, max_words=1)
