"""SimHash near-duplicates: pigeonhole blocks, joins on blocks, Hamming distance checked on each candidate."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.operators.graph import connected_components
from reconlake.plans.lineage import stored

#: Texts of one bucket that are compared in one task, at most; larger buckets are cut into parts, each compared with each other.
CROWD = 8192
#: Texts, and windows of words in them, whose sets meet in one task at most (a larger pair of texts meets alone).
MEMBERS, LOAD = 4096, 1 << 21
#: Fingerprints of one bucket up to this many are compared pair by pair; larger buckets take the exact way of _links_by_flips.
PAIRWISE = 48


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text; no words: 0.

    A-Z become lower case; words are runs of anything but ASCII white space; fewer words than a shingle form one.
    A bit is 1 if it is set in over half of the shingles' XXH64, repeats counted.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    return int(_majority(_shingles(words, shingle, seed)))


def _shingles(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the windows of `shingle` words, in order; fewer words form one window, none form none."""
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def _majority(h: np.ndarray) -> int:
    """The number whose bits are those set in over half of h."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65280):
        part = np.zeros((-(-len(h[k : k + 65280]) // 255) * 255, 8), np.uint8)
        part[: len(h[k : k + 65280])] = h[k : k + 65280].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1).reshape(-1, 255, 64)  # sums of 255 bits fit into a byte
        ones += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _mixed(h: np.ndarray) -> np.ndarray:
    """h under the finalizer of splitmix64: a second fingerprint from the same hashes, with bits of its own."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per document, fp the fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, fp long")


def _blocks(distance: int, extra: int) -> list[int]:
    """Masks of the bits that stay when any `distance` of distance + extra blocks are left out."""
    n = distance + extra
    edges = [round(k * 64 / n) for k in range(n + 1)]
    block = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(n)]
    return [sum(x) for x in combinations(block, extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links_by_flips(fps: DataFrame, distance: int) -> DataFrame:
    """Stars that connect what is within 2 bits, exact for any bucket size, without pairs.

    Two fingerprints are within 2 bits exactly if they meet after flipping one bit or none in each, so all that share
    such a value are linked to the smallest of them.
    """
    if distance > 2:
        raise ValueError("large buckets are linked exactly for distances of 1 and 2 only")
    flips = [0] + [_signed(1 << k) for k in range(64)] if distance == 2 else [0]
    if distance == 1:  # a link of one bit: one side flips, the other doesn't
        flips = [_signed(1 << k) for k in range(64)] + [0]
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("flip"))
    keyed = keyed.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") == 0).alias("own"))
    if distance == 1:
        own = keyed.where("own").select("key", F.col("fp").alias("b"))
        return keyed.where("not own").join(own, "key").select(F.col("fp").alias("a"), "b")
    least = keyed.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    return keyed.join(least, "key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_links(fps: DataFrame, distance: int = 2, extra: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """(a, b): links that connect distinct fingerprints differing in at most `distance` bits (1 or 2).

    The 64 bits are split into distance + extra blocks; two close fingerprints agree on some `extra` of them (pigeonhole).
    Buckets of equal blocks up to `pairwise` are joined and verified; fingerprints of larger ones are linked by
    _links_by_flips. Both are exact; within large buckets links are stars, not all pairs.
    """
    keys = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("v")) for k, m in enumerate(_blocks(distance, extra))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.k", "key.v")
    size = rows.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    rows = stored(rows.join(size, ["k", "v"]), "blocks")
    small = rows.where(F.col("n") <= pairwise).drop("n")
    other = small.select("k", "v", F.col("fp").alias("b"))
    near = small.join(other, ["k", "v"]).where((F.col("fp") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance))
    large = rows.where(F.col("n") > pairwise).select("fp").distinct()
    return near.select(F.col("fp").alias("a"), "b").unionByName(_links_by_flips(large, distance)).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp): one row per input row.

    component_id is the smallest id that is reached over links of at most `distance` bits; equal fingerprints are linked,
    those of empty or null texts (zero) too. Rows with a null id keep their fingerprint and get their group's smallest id
    (null if none has one). Repeated rows stay repeated. An empty table gives an empty table. Other columns are not read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    own = rows.groupBy("fp").agg(F.min("id").alias("least"))
    comp = connected_components(near_links(own.select("fp"), distance), "a", "b")
    named = own.join(comp, own["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("comp"))
    first = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(first, "comp").select("fp", "component_id")
    out = rows.join(named, "fp")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are hashed at once; words of over LONG_WORD bytes are hashed by XXH64 alone.
SLICE, LONG_WORD = 1 << 16, 64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blanks among the bytes, a random odd number for each byte (0 for blanks), and the powers of an odd number with their inverses."""
    blank = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
    value = np.random.default_rng(42).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    up, down = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    power = lambda x: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(SLICE, x, np.uint64))), dtype=np.uint64)
    return blank, np.where(blank, np.uint64(0), value), power(up), power(down)


def _windows(hashes: np.ndarray, shingle: int) -> np.ndarray:
    """A hash of each window of `shingle` words from the words' hashes; fewer words form one window, none form none."""
    n = min(shingle, len(hashes))
    h = np.zeros(len(hashes) - n + 1 if n else 0, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(h)]
    return _mixed(h)


def _word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word in order, A-Z as a-z: sums of its bytes' numbers times powers by their place in the word, mixed."""
    blank, value, up, down = _tables()
    text = text.lower()
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        x = np.frombuffer(text, np.uint8, min(SLICE, len(text) - at), at)
        edge = np.flatnonzero(np.diff(blank[x], prepend=True, append=True))
        if at + len(x) < len(text) and not blank[x[-1]]:  # the last word may go on: leave it, or take it whole if there is none before it
            if len(edge) == 2 and edge[0] == 0:
                end = _GAP.search(text, at)
                word = text[at : end.start() if end else len(text)]
                out.append(np.array([xxhash.xxh64_intdigest(word, 42)], np.uint64))
                at += len(word)
                continue
            last, edge = int(edge[-2]), edge[:-2]
        else:
            last = len(x)
        if len(edge):
            start, end = edge[::2], edge[1::2]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[x] * up[: len(x)], dtype=np.uint64)))
            h = _mixed((sums[end] - sums[start]) * down[start])
            for k in np.flatnonzero(end - start > LONG_WORD):
                h[k] = xxhash.xxh64_intdigest(text[at + int(start[k]) : at + int(end[k])], 42)
            out.append(h)
        at += last
    return np.concatenate(out)


def _sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(t, size, fps): number of distinct windows of `shingle` words, and two fingerprints over windows of 3 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, fps = [], []
            for text in b.column(1).cast(pa.binary()):
                hashes = _word_hashes(text.as_py())
                size.append(len(np.unique(_windows(hashes, shingle))))
                h = _windows(hashes, 3)
                fps.append([_signed(_majority(h)), _signed(_majority(_mixed(h)))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int32()), pa.array(fps, pa.list_(pa.int64()))], names=["t", "size", "fps"])

    return texts.mapInArrow(run, "t long, size int, fps array<long>")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(family, parts, t, set): distinct hashes of the windows of `shingle` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(_windows(_word_hashes(x.as_py()), shingle)).view(np.int64) for x in b.column("text").cast(pa.binary())]
            kept = ["family", "parts", "t"]
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(sets, pa.list_(pa.int64()))], names=[*kept, "set"])

    return texts.select("family", "parts", "t", "text").mapInArrow(run, "family long, parts int, t long, set array<long>")


def _keyed(sketches: DataFrame, blocks: int, shared: int) -> DataFrame:
    """sketches (t, size, p, q, ...) once for each of their buckets (key): texts that agree on `shared` blocks of one fingerprint."""
    masks = [F.lit(_signed(m)).cast("long") for m in _blocks(blocks - shared, shared)]
    keys = [F.xxhash64(F.lit(f), F.lit(k), F.col(fp).bitwiseAND(m)) for f, fp in enumerate("pq") for k, m in enumerate(masks)]
    return sketches.where("size > 0").select(F.explode(F.array(*keys)).alias("key"), *sketches.columns)


def _near(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float, distance: int) -> np.ndarray:
    """Which pairs of rows i and j are of different texts, with sizes that allow the similarity and near fingerprints."""
    size, t = x["size"], x["t"]
    apart = sum(np.bitwise_count((x[c][i] ^ x[c][j]).view(np.uint64)).astype(int) for c in "pq")
    return (apart <= distance) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])) & (t[i] != t[j])


def _alike(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float, distance: int) -> pa.RecordBatch:
    """(a, b), a < b: those pairs of rows i and j that are near."""
    near = _near(x, i, j, similarity, distance)
    a, b = x["t"][i[near]], x["t"][j[near]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _joined(held: dict[str, np.ndarray], b: pa.RecordBatch) -> dict[str, np.ndarray]:
    new = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
    return {c: np.concatenate((held[c], v)) for c, v in new.items()} if held else new


def _stars(sketches: DataFrame, similarity: float, distance: int, blocks: int, shared: int) -> DataFrame:
    """(a, b), a < b: texts alike with the smallest text of one of their buckets; passed through in order, a bucket of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x = _joined(first, b)
                at = np.arange(len(x["key"]))
                start = np.maximum.accumulate(np.where(np.diff(x["key"], prepend=x["key"][0]) != 0, at, 0))
                yield _alike(x, start, at, similarity, distance)
                first = {c: v[start[-1] : start[-1] + 1] for c, v in x.items()}

    rows = _keyed(sketches, blocks, shared)
    return rows.repartition("key").sortWithinPartitions("key", "t").mapInArrow(run, "a long, b long").distinct()


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least label of each label's component, root, once labels a and b are linked."""
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    return root


def _across(sketches: DataFrame, similarity: float, distance: int, blocks: int, shared: int, crowd: int = CROWD, joining: bool = False) -> DataFrame:
    """(a, b), a < b: all alike texts that share a bucket and lie in different components (`comp`).

    Buckets of over `crowd` texts in different components are cut into parts, and each two parts are a bucket.
    joining: instead of all of them, links that join the same components, without those between what a task has joined already.
    """

    def pairs(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = x["key"]
        label = np.unique(x["comp"], return_inverse=True)[1]
        root = np.arange(len(label))
        at, step = np.arange(len(key)), 0
        while len(at):
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            u, v = root[label[at]], root[label[at + step]]
            i = at[u != v]
            if len(i) and joining:
                i = i[_near(x, i, i + step, similarity, distance)]
                u, v = root[label[i]], root[label[i + step]]
                i = i[np.unique(np.minimum(u, v) * len(root) + np.maximum(u, v), return_index=True)[1]]
                root = _merged(root, label[i], label[i + step])
            if len(i):
                yield _alike(x, i, i + step, similarity, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x = _joined(held, b)
                last = np.searchsorted(x["key"], x["key"][-1])
                yield from pairs({c: v[:last] for c, v in x.items()})
                held = {c: v[last:] for c, v in x.items()}
        if held:
            yield from pairs(held)

    rows = _keyed(sketches, blocks, shared)
    crowded = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd), "crowded")
    if not crowded.isEmpty():
        among = rows.join(crowded, "key")
        mixed = stored(among.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "mixed")
        among = among.join(mixed, "key").withColumn("n", F.ceil(F.col("n") / F.lit(crowd / 2)).cast("int")).withColumn("i", F.pmod(F.xxhash64("t"), F.col("n")).cast("int"))
        among = among.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        among = among.withColumn("key", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))).select(*rows.columns)
        rows = rows.join(crowded, "key", "left_anti").select(*rows.columns).unionByName(among)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def _links_within(size: np.ndarray, values: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(i, j): links that connect sets of that Jaccard similarity, of all pairs of sets; `values` are the sets' elements one after another.

    Sets are told by their differences to the elements that most of them hold, since two sets differ as much as their
    differences do; elements of one difference only are counted with its size.
    """
    m = len(size)
    _, col, held = np.unique(values, return_inverse=True, return_counts=True)
    owner, major = np.repeat(np.arange(m), size), held > m / 2
    common = major[col]
    has = np.zeros((m, int(major.sum())), bool)
    has[owner[common], (np.cumsum(major) - 1)[col[common]]] = True
    lacks, lacked = np.nonzero(~has)
    owner, col = np.concatenate((owner[~common], lacks)), np.concatenate((col[~common], np.flatnonzero(major)[lacked]))
    differs = np.bincount(owner, minlength=m)
    shared = np.bincount(col, minlength=len(held))[col] > 1
    owner, col = owner[shared], col[shared]
    by_col = np.lexsort((owner, col))
    holders, sorted_col = owner[by_col], col[by_col]
    by_owner = np.lexsort((col, owner))
    low = np.searchsorted(sorted_col, col[by_owner])
    bound = np.searchsorted(owner[by_owner], np.arange(m + 1))
    count = np.bincount(col, minlength=len(held))[col[by_owner]]
    label, out = np.arange(m), []
    for i in range(1, m):
        first, n = low[bound[i] : bound[i + 1]], count[bound[i] : bound[i + 1]]
        places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(holders[places], minlength=m)[:i]
        sum_ = size[i] + size[:i]
        common = (sum_ - (differs[i] + differs[:i] - 2 * both)) // 2
        hit = np.flatnonzero(common >= similarity * (sum_ - common))
        if len(hit):
            labels, at = np.unique(label[hit], return_index=True)
            out += [(int(j), i) for j in hit[at]]
            label[:i][np.isin(label[:i], labels)] = labels[0]
            label[i] = labels[0]
    return out


def _verified(texts: DataFrame, families: DataFrame, shingle: int, similarity: float, members: int = MEMBERS, load: int = LOAD) -> DataFrame:
    """(a, b), a < b: links that connect the texts of each family (t, size, family) with that Jaccard similarity, on whole sets.

    All pairs of a family are judged in the tasks that hold their sets. Families of over `members` texts or `load` windows are cut
    into parts, and each two parts meet in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, t, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            found = _links_within(np.array([len(x) for x in sets]), np.concatenate(sets), similarity) if len(t) > 1 else []
            if found:
                a, b = np.array(t)[np.array(found).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for b in batches:
            held = b.column("set")
            values, ends = held.values.to_numpy(), held.offsets.to_numpy()
            for k, (key, text) in enumerate(zip(b.column("block").to_pylist(), b.column("t").to_pylist())):
                if key != block:
                    yield from links()
                    block, t, sets = key, [], []
                t.append(text)
                sets.append(values[ends[k] : ends[k + 1]].copy())
        yield from links()

    total = families.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("windows")).where("n > 1")
    needed = F.greatest(F.col("n") / F.lit(members), F.col("windows") / F.lit(load))
    total = total.select("family", F.when(needed <= 1, 1).otherwise(F.ceil(2 * needed)).cast("int").alias("parts"))
    placed = families.join(total, "family").select("family", "parts", "t")
    sets = _shingle_sets(texts.join(placed, "t"), shingle).withColumn("i", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int"))
    sets = sets.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 or i <> j")
    rows = sets.select(F.xxhash64("family", F.least("i", "j"), F.greatest("i", "j")).alias("block"), "t", "set")
    return rows.repartition("block").sortWithinPartitions("block", "t").mapInArrow(run, "a long, b long")


def similar_links(
    texts: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 30, blocks: int = 8, shared: int = 2, crowd: int = CROWD, members: int = MEMBERS, load: int = LOAD
) -> DataFrame:
    """(a, b): links that connect texts (t, text), t distinct, whose sets of `shingle`-word windows have that Jaccard similarity.

    Candidates differ in at most `distance` of the 128 bits of two fingerprints: those within blocks - shared bits in one of
    them are met, wider ones with the likelihood that their differing bits leave `shared` blocks free. So links can be missed, but
    none is wrong. Candidates are joined to families, by links to the smallest texts of their buckets first, then by those between
    what these leave apart. Then all pairs of a family are judged on whole sets of 64-bit window hashes, in tasks that hold the
    sets; what leaves a task are links that connect, less than its texts, not all pairs. So groups are at least those of all
    candidates. Texts without words have no link.
    """
    sketches = stored(_sketches(texts, shingle).select("t", "size", F.get("fps", F.lit(0)).alias("p"), F.get("fps", F.lit(1)).alias("q")), "sketches")
    how = {"similarity": similarity, "distance": distance, "blocks": blocks, "shared": shared}
    star = stored(_stars(sketches, **how).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "stars")
    comp = connected_components(star, "a", "b")
    placed = sketches.join(comp, F.col("t") == F.col("node"), "left").select(*sketches.columns, F.coalesce("component", "t").alias("comp"))
    rest = stored(_across(stored(placed, "placed"), crowd=crowd, joining=True, **how), "rest")
    family = connected_components(star.unionByName(rest), "a", "b").select(F.col("node").alias("t"), F.col("component").alias("family"))
    families = stored(sketches.select("t", "size").join(family, "t"), "families")
    return stored(_verified(texts, families, shingle, similarity, members, load), "links").distinct()


def one_of_each(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group of similar texts: the one with the smallest id, among rows without one that of the smallest hash.

    Groups are the components over similar_links; equal texts are one text, and all texts without words are one group.
    """
    rows = docs.select(*columns).withColumn("t", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    texts = rows.select("t", F.coalesce(text_col, F.lit("")).alias("text")).dropDuplicates(["t"])
    comp = connected_components(similar_links(texts, **how), "a", "b")
    blank = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    slim = rows.select(F.col(id_col).alias("id"), "t", blank.alias("blank")).join(comp, F.col("t") == F.col("node"), "left")
    slim = slim.withColumns({"group": F.when(F.col("blank"), F.lit(0).cast("long")).otherwise(F.coalesce("component", "t")), "nameless": F.col("id").isNull()})
    best = slim.groupBy("blank", "group").agg(F.min(F.struct("nameless", "id", "t")).alias("best")).select(F.col("best.id").alias("_id"), F.col("best.t").alias("_t"))
    out = rows.join(best, (F.col("t") == F.col("_t")) & F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
    return out.dropDuplicates([id_col, "t"]).select(*columns)
