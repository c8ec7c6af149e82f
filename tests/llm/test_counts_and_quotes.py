"""Token counts and quotation links against plain loops."""

import random
import re

import public_tokenizers
import pyarrow as pa
import sentencepiece

from reconlake.llm import quote_links, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_equal_a_plain_search(spark):
    model = token_counts.Unigram.load(PATH)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert len(model.costs) > 30000 and model.costs[sp.id_to_piece(300)] == -sp.get_score(300)

    def plain(word):
        ways = [(0, 0)]
        for e in range(1, len(word) + 1):
            n = len(word[e - 1].encode())
            options = [(ways[e - 1][0] + n * model.byte_cost, ways[e - 1][1] + n)]
            options += [(ways[b][0] + model.costs[word[b:e]], ways[b][1] + 1) for b in range(e) if word[b:e] in model.costs]
            ways.append(min(options))
        return ways[-1][1]

    r = random.Random(8)
    make = lambda n: "".join(r.choice(["the", "tion", " ", "über", "日本", "\n", "x", "🎉", "ing ", "\t\t"]) for _ in range(n))
    texts = [None, "", "  \n", "word", "z" * 500, *[make(r.randint(1, 80)) for _ in range(40)], make(4000)]
    texts.append(texts[6])
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int, key int").repartition(3)
    got = {r_["doc_id"]: (r_["n_pretokens"], r_["n_tokens"]) for r_ in token_counts.token_counts(df, PATH).collect()}
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert got[k] == (len(words), sum(plain("▁" + w) for w in words))
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0


def test_generations_turn_without_loss():
    model = token_counts.Unigram({"a": 1, "b": 2, "ab": 1, "▁": 1}, 9)
    small = token_counts.TrieCounts(model, most=3)
    for words in (["a", "ab"], ["b", "bb", "abb"], ["a", "ba", "aab"]):
        small.learn({w for w in words if w not in small.new})
        assert small.of(words) == sum(len(re.findall("ab|a|b", w)) for w in words)


def test_a_slice_over_the_bound_after_an_earlier_one(spark, monkeypatch):
    made = token_counts.TrieCounts(token_counts.Unigram({"a": 1, "b": 2, "ab": 1, "▁": 1}, 9), most=10)
    monkeypatch.setattr(token_counts, "_counts", lambda path: made)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, kinds: run)
    run = token_counts.token_counts(docs, PATH)
    texts = ["a ab b"] * 64 + ["a " + " ".join("b" * k for k in range(2, 30))] + ["ab"] * 63 + ["a bb ab"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    got = next(run(iter([batch]))).to_pylist()
    assert [r["n_tokens"] for r in got] == [sum(1 + len(re.findall("ab|a|b", w)) for w in t.split()) for t in texts]


def test_parse_levels():
    p = quote_links.parse("Hi\nOn Monday Ann wrote:\n> one\n> two\n>> deep\n> back\n\nBye\n>>> x")
    assert p.body == "Hi\n\nBye"
    assert [n for n, _ in p.passages] == [1, 2, 1, 3]
    assert p.segments[:2] == [(None, "Hi"), (0, "On Monday Ann wrote:\n> one\n> two")]
    assert "\n".join(t for _, t in p.segments) == "Hi\nOn Monday Ann wrote:\n> one\n> two\n>> deep\n> back\n\nBye\n>>> x"
    assert quote_links.parse("a > b\nc")[:2] == ("a > b\nc", [])
    assert quote_links.parse(None)[:3] == ("", [], set())


def test_partial_quotes_and_what_stays(spark):
    source = "a\nb\nc\nd\n\nThe second part has many words\nand goes on over two lines here.\n\nEnd"
    rows = [
        (1, 0, "u", source),
        (1, 1, "u", "> b\n> c\nshort run"),
        (1, 2, "u", "> part has many\n> words and goes on\nre-wrapped"),
        (1, 3, "u", "> goes on over two lines here.\n>\n> End\nover paragraphs"),
        (1, 4, "u", ">>> print(1)\n1\n>>> x = 2"),
        (1, 5, "u", "> words that nobody has said so far\nkept"),
        (1, 6, "u", "> goes on over two lines now and then\nhalf known"),
        (2, 0, "u", "> part has many words and goes on\nelsewhere"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quote_links.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[1, k]["parent_turn"], got[1, k]["n_linked"], got[1, k]["text"]) for k in (1, 2, 3)] == [(0, 1, "short run"), (0, 1, "re-wrapped"), (0, 1, "over paragraphs")]
    for k in (4, 5, 6):
        assert (got[1, k]["n_linked"], got[1, k]["parent_turn"], got[1, k]["text"]) == (0, k - 1, rows[k][3])
    assert (got[2, 0]["n_linked"], got[2, 0]["text"]) == (0, rows[7][3])


def test_random_conversations_equal_a_plain_loop(spark):
    r = random.Random(4)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(8):
            text = "\n".join(" ".join(r.choice("alpha beta gamma delta eps zeta".split()) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 4)))
            if said and r.random() < 0.7:
                words = r.choice(said).split()
                k = r.randrange(len(words))
                text = "> " + " ".join(words[k : k + r.randint(1, 14)]) + "\n" + text
            rows.append((conv, turn, "u", text))
            said.append(quote_links.parse(text).body)
    want = {}
    for conv, turn, _, text in rows:
        quotes = quote_links.parse(text).passages
        before = [quote_links.parse(t).body for c, n, _, t in rows if c == conv and n < turn]
        parent = turn - 1 if turn else None
        for _, q in quotes:
            plain = " ".join(q.split())
            whole = [k for k, b in enumerate(before) if plain in {" ".join(x.split()) for x in (b, *b.split("\n"), *("\n".join(b.split("\n")[i:j]) for i in range(5) for j in range(i + 1, 6) if len(" ".join(b.split("\n")[i:j]).split()) < 5))}]
            ws = set(quote_links.windows(q))
            first = [min((k for k, b in enumerate(before) if w in quote_links.windows(b)), default=None) for w in ws]
            if whole:
                parent = whole[0]
            elif ws and None not in first and ws <= set(quote_links.windows(before[max(first)])):
                parent = max(first)
        want[conv, turn] = parent
    got = {(x["conv_id"], x["turn"]): x["parent_turn"] for x in quote_links.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert got == want


def test_links_and_reply_order(spark):
    rows = [
        (1, 0, "user", "First point.\n\nSecond   point here."),
        (1, 1, "assistant", "> first POINT.\nI agree."),
        (1, 2, "user", "Other matter"),
        (1, 3, "assistant", "> second point here.\nNo, because.\n>> nothing like it"),
        (1, 4, "user", "> Other matter\n>> First point.\nBoth"),
        (2, 0, "user", "> Other matter\nin another conversation"),
        (2, 5, "assistant", None),
        (2, 5, "user", ""),
        (None, 0, "user", "no conversation"),
        (None, None, None, "no turn"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, idx int, root string").repartition(3)
    got = {(r["conv_id"], r["turn"], r["role"]): r for r in quote_links.link(df).collect()}
    assert len(got) == len(rows)
    short = lambda *k: tuple(got[k][c] for c in ("parent_turn", "depth", "position", "n_quotes", "n_linked"))
    assert short(1, 0, "user") == (None, 0, 0, 0, 0)
    assert short(1, 1, "assistant") == (0, 1, 1, 1, 1)
    assert short(1, 3, "assistant") == (0, 1, 2, 2, 1)
    assert short(1, 2, "user") == (1, 2, 3, 0, 0)
    assert short(1, 4, "user") == (2, 3, 4, 2, 2)
    assert short(2, 0, "user") == (None, 0, 0, 1, 0)
    assert short(2, 5, "user")[:3] == (5, 2, 2)
    assert short(None, None, None)[:3] == (None, 0, 0) and short(None, 0, "user")[:2] == (None, 1)
    assert got[1, 4, "user"]["text"] == "Both" and got[2, 5, "assistant"]["text"] == ""
    assert quote_links.link(df.limit(0)).count() == 0


def test_long_chain_with_a_hot_message(spark):
    rows = [(7, k, "u", f"line {k}") if k % 3 else (7, k, "u", f"> line 1\nsays {k}") for k in range(300)]
    got = {r["turn"]: r for r in quote_links.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    depth = {}
    for k in range(300):
        parent = None if k == 0 else (1 if k % 3 == 0 and k > 1 else k - 1)
        depth[k] = 0 if parent is None else depth[parent] + 1
        assert (got[k]["parent_turn"], got[k]["depth"]) == (parent, depth[k])
    assert [r["turn"] for r in sorted(got.values(), key=lambda r: r["position"])] == sorted(range(300), key=lambda k: (depth[k], k))
