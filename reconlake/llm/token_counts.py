"""Token counts under a unigram vocabulary: distinct pre-tokens in a trie, forward scores once per shared prefix."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The mark that stands for the space before a word.
MARK = "▁"


class Unigram:
    """Pieces with whole-number costs; a character that no piece covers costs its bytes' pieces."""

    def __init__(self, costs: dict[str, int], byte_cost: int):
        self.costs, self.byte_cost = costs, byte_cost
        self.longest = max(map(len, costs), default=1)

    @classmethod
    def load(cls, path: str) -> Unigram:
        """Costs are the negated scores of the file's ordinary pieces; a byte costs more than any of them."""
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        costs = {sp.id_to_piece(i): round(-sp.get_score(i)) for i in range(sp.get_piece_size()) if not odd(i)}
        return cls(costs, max(costs.values()) + 1)


class TrieCounts:
    """Tokens of the cheapest segmentation of each pre-token, fewest tokens among equal costs.

    New pre-tokens are taken in sorted order, which walks their trie depth first: the forward scores (cost, tokens) of the
    prefix shared with the pre-token before stay on the stack, and a pre-token's last score is its terminal count.
    """

    def __init__(self, model: Unigram, most: int = 400_000):
        self.model, self.most = model, most
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def learn(self, pretokens: set[str]) -> dict[str, int]:
        """Counts of all these pre-tokens, whatever their number: a generation turns before they are worked out, never between."""
        if len(self.new) + sum(p not in self.new for p in pretokens) > self.most:
            self.old, self.new = self.new, {}
        kept, old = self.new, self.old
        here: dict[str, int] = {}
        fresh = []
        for p in pretokens:
            n = kept.get(p)
            if n is None:
                n = old.get(p)
            if n is None:
                fresh.append(p)
            else:
                here[p] = n
        costs, longest, byte_cost = self.model.costs.get, self.model.longest, self.model.byte_cost
        forward: list[tuple[int, int]] = [(0, 0)]
        before = ""
        for p in sorted(fresh):
            del forward[len(commonprefix((before, p))) + 1 :]
            for end in range(len(forward), len(p) + 1):
                n = len(p[end - 1].encode())
                cost, tokens = forward[end - 1]
                best = cost + n * byte_cost, tokens + n
                for begin in range(max(0, end - longest), end):
                    c = costs(p[begin:end])
                    if c is not None:
                        way = forward[begin][0] + c, forward[begin][1] + 1
                        if way < best:
                            best = way
                forward.append(best)
            here[p] = forward[-1][1]
            before = p
        kept.update(here)
        return here

    def of(self, pretokens: list[str]) -> int:
        return sum(map(self.new.__getitem__, pretokens))


@lru_cache(maxsize=2)
def _counts(path: str) -> TrieCounts:
    return TrieCounts(Unigram.load(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens): one row per input row.

    Pre-tokens are the words between ASCII white space, each with the mark of its space. path: the model's file, on every
    machine. Null and empty texts have none. Repeated rows stay repeated; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(path)
        for b in batches:
            words, tokens = [], []
            for k in range(0, b.num_rows, 64):
                some = [[MARK + w for w in _WORD.findall(t.as_py() or "")] for t in b.column(1).slice(k, 64)]
                learned = counts.learn({w for x in some for w in x})
                words += map(len, some)
                tokens += (sum(map(learned.__getitem__, x)) for x in some)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
