"""Operator 6: SimHash near-duplicates over BK-trees.

Distinct fingerprints are dealt to shards so that any two within the radius meet in one: fingerprints that differ by RADIUS
bits at most agree on two of RADIUS + 2 equal blocks of bits, and each choice of two blocks and their value is a shard. A
shard of more than SHARD fingerprints is split by the bits on which its members may still differ: these make RADIUS + 1
groups, linked members agree on one of them, and each group with its value is a shard again. So a fingerprint is copied a
few times however hot its shard is, and as at most 2 ** 7 values are left after four splits, every shard ends small.

A BK-tree is built of each shard, children keyed by their distance to the parent. Up to TREES nodes in all, a size that is
checked, trees are broadcast and every fingerprint walks those of its shards where it lies; beyond that a shard's members
come to where its tree is. A walk follows only the edges within the radius of its distance to a node. Links already implied
by others of the same task aren't given out, and components then join them across tasks.

near_duplicates() joins texts of similar word shingles: BK-trees of shards of shared anchors find each text's nearest, and
an exact prefix filter finds all pairs that this leaves apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations, groupby

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_SENT, among, frequent, map_rows, numbered, renamed, settle, table, unsettle, without
from .graph import components

BITS = 64
#: Fingerprints of one tree.
SHARD = 512
#: Nodes of all trees together up to which they are broadcast: about 26 MB.
TREES = 2_000_000
#: Fingerprints, those of most rows, whose components are sent to all tasks; the others have at most one row in HOT each.
HOT = 65_536


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `width` words, in order and with repeats. Fewer words: of all of them. None: nothing."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z alone become lower case, ASCII white space alone splits
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes. Signed, as Spark's long."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 16_384):
        part = hashes[at : at + 16_384].view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (long) of every whole text; null and wordless texts have 0."""

    def make():
        def step(cols):
            for i, t in zip(*cols):
                yield i, fold(shingle_hashes(t, width))

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, fingerprint long")


class BKTree:
    """Values by Hamming distance: a child's edge is its distance to its parent. Equal values are one node with several
    items."""

    def __init__(self):
        self.values: list[int] = []
        self.items: list[list] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, item) -> None:
        if not self.values:
            return self._node(value, item)
        at = 0
        while d := (value ^ self.values[at]).bit_count():
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = len(self.values)
                return self._node(value, item)
            at = child
        self.items[at].append(item)

    def _node(self, value: int, item) -> None:
        self.values.append(value)
        self.items.append([item])
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator:
        """Items whose value differs by radius bits at most."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                yield from self.items[at]
            stack += self._edges(at, d, radius)

    def nearest(self, value: int, radius: int):
        """The first item of a nearest value within the radius, or None. What is found narrows the radius."""
        stack, best = ([0] if self.values else []), None
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d < radius or best is None and d == radius:
                radius, best = d, self.items[at][0]
            stack += self._edges(at, d, radius)
        return best

    def _edges(self, at: int, d: int, radius: int) -> list[int]:
        children = self.children[at]
        if len(children) <= 2 * radius:
            return [c for e, c in children.items() if d - radius <= e <= d + radius]
        return [children[e] for e in range(max(1, d - radius), d + radius + 1) if e in children]

    def packed(self) -> bytes:
        """The nodes in the order they came, each with its parent and edge; items are left out."""
        parents, edges = np.zeros(len(self.values), np.int32), np.zeros(len(self.values), np.uint8)
        for at, own in enumerate(self.children):
            for e, c in own.items():
                parents[c], edges[c] = at, e
        return np.array(self.values, np.uint64).tobytes() + parents.tobytes() + edges.tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> BKTree:
        """A tree whose items are its values."""
        n = len(raw) // 13
        tree = cls()
        tree.values = np.frombuffer(raw, np.uint64, n).tolist()
        tree.items = [[v] for v in tree.values]
        tree.children = [{} for _ in range(n)]
        for c, (at, e) in enumerate(zip(np.frombuffer(raw, np.int32, n, 8 * n).tolist(), np.frombuffer(raw, np.uint8, n, 12 * n).tolist())):
            if c:
                tree.children[at][e] = c
        return tree


class Joined:
    """Which items of a task are already joined."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _masks(bits: list[int], groups: int) -> list[int]:
    """Masks of about equally many of the given bits each."""
    return [sum(1 << x for x in bits[len(bits) * k // groups : len(bits) * (k + 1) // groups]) for k in range(groups)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shards(nodes: DataFrame, radius: int) -> DataFrame:
    """shard, fingerprint, a settled table: of nodes (distinct fingerprints), each with all shards that it shares with
    another, at most SHARD in each."""
    blocks = _masks(list(range(BITS)), radius + 2)
    fixed = [a | b for a, b in combinations(blocks, 2)]  # of each kind of shard the bits that its members share
    key = lambda kind, mask, above: F.xxhash64(F.lit(kind), above, F.col("fingerprint").bitwiseAND(F.lit(_signed(mask))))
    first = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), key(k, m, F.lit(0)).alias("shard")) for k, m in enumerate(fixed))))
    rows = settle(nodes.select("fingerprint", first.alias("_s")).select("fingerprint", "_s.kind", "_s.shard"))
    small = None
    while True:
        sizes = settle(rows.groupBy("shard").agg(F.count("*").alias("_n")).filter("_n > 1"))
        cold = rows.join(sizes.filter(F.col("_n") <= SHARD), "shard").select("shard", "fingerprint")
        small = cold if small is None else small.unionByName(cold)
        hot = sizes.filter(F.col("_n") > SHARD)
        # Groups of the bits that differ yet, by kind; with one bit or less a group, shards are small already.
        groups = [_masks([x for x in range(BITS) if not m >> x & 1], radius + 1) for m in fixed]
        if hot.isEmpty() or not all(all(g) for g in groups):
            return settle(small.unionByName(rows.join(hot, "shard").select("shard", "fingerprint")))
        split = [F.array(*(F.struct(F.lit(len(g) * k + i).alias("kind"), key(len(g) * k + i, x, F.col("shard")).alias("shard")) for i, x in enumerate(g))) for k, g in enumerate(groups)]
        chosen = F.coalesce(*(F.when(F.col("kind") == k, a) for k, a in enumerate(split)))
        rows = settle(rows.join(hot, "shard").select("fingerprint", F.explode(chosen).alias("_s")).select("fingerprint", "_s.kind", "_s.shard"))
        fixed = [m | x for m, g in zip(fixed, groups) for x in g]


def runs(dealt: DataFrame, keys: list[str], columns: list[str], make, schema: str) -> DataFrame:
    """make() gives a function from the rows of equal keys (these first, then columns, in their order) to row tuples."""
    ordered = dealt.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *columns)

    def start():
        work, held = make(), []

        def step(cols):
            nonlocal held
            for k, rows in groupby(zip(*cols), lambda r: r[: len(keys)]):
                if held and held[0][: len(keys)] != k:
                    yield from work(held)
                    held = []
                held.extend(rows)

        def end():
            return work(held) if held else ()

        step.end = end
        return step

    return map_rows(ordered, start, schema)


def _tree(rows: list[tuple]) -> BKTree:
    tree = BKTree()
    for _, value in rows:
        tree.add(value & 0xFFFFFFFFFFFFFFFF, value)
    return tree


def _links_in(rows: list[tuple], radius: int) -> Iterator[tuple[int, int]]:
    tree, joined = BKTree(), Joined()
    for _, value in rows:
        bits = value & 0xFFFFFFFFFFFFFFFF
        for other in tree.within(bits, radius):
            if joined.join(value, other):
                yield value, other
        tree.add(bits, value)


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """a, b: links between distinct fingerprints of nodes (column fingerprint) that differ by radius bits at most; all
    other such links join what these join already."""
    dealt = shards(nodes, radius)
    if dealt.count() > TREES:
        return runs(dealt, ["shard"], ["fingerprint"], lambda: lambda own: _links_in(own, radius), "a long, b long")
    packed = runs(dealt, ["shard"], ["fingerprint"], lambda: lambda own: [(own[0][0], _tree(own).packed())], "shard long, tree binary").toArrow()  # 13 bytes a node
    sent = nodes.sparkSession.sparkContext.broadcast(dict(zip(packed["shard"].to_pylist(), packed["tree"].to_pylist())))

    def make():
        opened: dict[int, BKTree] = {}
        joined = Joined()

        def step(cols):
            for shard, value in zip(*cols):
                tree = opened.get(shard)
                if tree is None:
                    if len(opened) >= 1_000:
                        opened.clear()
                    tree = opened[shard] = BKTree.unpacked(sent.value[shard])
                bits = value & 0xFFFFFFFFFFFFFFFF
                for other in tree.within(bits, radius):
                    other = _signed(other)
                    if other < value and joined.join(value, other):
                        yield value, other

        return step

    return map_rows(dealt.select("shard", "fingerprint"), make, "a long, b long")


def groups(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id that links reach, its own included.

    Null and wordless texts have fingerprint zero and link like others. Texts of any length are taken whole. Each row gives
    one row, repeated rows are in one component; null ids are never a component's id unless it has no others. An empty
    table gives an empty one. Other columns of docs, whatever their names, play no part.
    """
    signed = settle(fingerprints(docs, width, id_col, text_col))
    nodes = settle(signed.groupBy("fingerprint").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")))
    found = components(settle(links(nodes, radius)))
    joined = nodes.join(found, nodes["fingerprint"] == found["node"], "left").select("fingerprint", "_first", "_n", F.coalesce("component", "fingerprint").alias("_component"))
    joined = settle(joined)
    least = settle(joined.groupBy("_component").agg(F.min("_first").alias("component_id")))
    named = settle(joined.join(least, "_component").select(F.col("fingerprint").alias("_print"), "component_id", "_n"))
    # A fingerprint of very many rows is no hot key: the most frequent ones are sent to all tasks.
    often = F.broadcast(settle(frequent(named.filter("_n > 1"), "_n", HOT, "_print").drop("_n")))
    at = F.col("fingerprint") == F.col("_print")
    rest = signed.join(often.select("_print"), at, "left_anti").join(named.drop("_n"), at)
    out = signed.join(often, at).unionByName(rest)
    return out.select(id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


#: Near-duplicates by similarity, first pass. Pairs of the least similarity have fingerprints at 10 bits on average; a
#: nearest one beyond this many isn't near, and what is lost so is left to the second pass.
REACH = 28
#: Shards for similarity: anchors, each made of ROWS minima of hash functions over a text's shingles. A pair at 0.8
#: shares an anchor with a probability of 1 - (1 - 0.8 ** 3) ** 12, over 0.9998; the second pass finds the others.
ANCHORS, ROWS = 12, 3
#: Second pass: shingles that are in OFTEN or more of one in SAMPLE texts come last in the order of shingles, at most
#: COMMON of them. This decides how many candidates there are, never which pairs are found.
SAMPLE, OFTEN, COMMON = 16, 4, 65_536
#: Bits of a text's marks at least, and of the filter of shared shingles at most (32 MB).
MARKS, FILTER = 512, 2**28


def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def anchors(hashes: np.ndarray) -> list[int]:
    """ANCHORS numbers; equal sets of shingles have equal ones."""
    factor, plus = _mixers(ANCHORS * ROWS)
    low = np.full(ANCHORS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096, None] * factor + plus
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.minimum(low, mixed.min(0))
    rows = low.reshape(ANCHORS, ROWS)
    out = np.arange(ANCHORS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64).tolist()


def marks(hashes: np.ndarray) -> bytes:
    """A bit for each member of a set, or up to twice as many, MARKS at least: whether an odd number of members fall on it."""
    size = max(MARKS, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """By how many bits two sets' marks differ, at the size of the smaller: no more than the members of one set alone."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum())


def sketches(docs: DataFrame, width: int, row_col: str, text_col: str) -> DataFrame:
    """row, class (a hash of 128 bits of the lower-case word sequence), fingerprint, number of shingles, marks,
    anchors (null for wordless texts)."""

    def make():
        from xxhash import xxh3_128_hexdigest

        def step(cols):
            for i, t in zip(*cols):
                own = np.unique(shingle_hashes(t, width))  # similarity is of sets: repeats don't count
                name = xxh3_128_hexdigest(b" ".join((t or "").encode().lower().split()))
                yield i, name, fold(own), len(own), marks(own), anchors(own) if len(own) else None

        return step

    return map_rows(docs.select(row_col, text_col), make, "_row long, class string, fingerprint long, size int, marks binary, anchors array<long>", rows=5_000)


def deal(rows: DataFrame, key: str, item: str, most: int = SHARD) -> DataFrame:
    """rows of the keys with two rows or more, with part and to: a key with over `most` rows is cut into parts by a hash of
    the item. The first part's rows, the shard's tree, go to all parts, the others to their own, so a row of a shard is
    copied once on average, however large the shard is."""
    sizes = settle(rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1"))
    parts = F.ceil(F.col("_n") / most).cast("int")
    dealt = rows.join(sizes, key).withColumn("part", F.pmod(F.xxhash64(item, F.lit(11)), parts).cast("int"))
    to = F.when(F.col("part") == 0, F.sequence(F.lit(0), parts - 1)).otherwise(F.array("part"))
    return dealt.withColumn("to", F.explode(to)).select(*rows.columns, "part", "to")


def nearest_links(dealt: DataFrame) -> DataFrame:
    """a, b: each node of a shard's part with the nearest one of the shard's tree and of what came before in its part."""

    def make():
        def work(rows):
            tree = BKTree()
            for _, to, part, node, value in rows:
                bits = value & 0xFFFFFFFFFFFFFFFF
                if part == to and (other := tree.nearest(bits, REACH)) is not None:
                    yield max(node, other), min(node, other)
                tree.add(bits, node)

        return work

    return runs(dealt, ["shard", "to"], ["part", "node", "fingerprint"], make, "a long, b long")


def likely(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) that may have the similarity: all but those whose sets (node, size, marks) must differ by more.
    Exact, and no text moves for it."""

    def make():
        def step(cols):
            for a, b, n, m, x, y in zip(*cols):
                if apart(x, y) <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6:
                    yield a, b

        return step

    side = lambda n: sets.select(F.col("node").alias(n), F.col("size").alias(f"_size_{n}"), F.col("marks").alias(f"_marks_{n}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    return map_rows(full.select("a", "b", "_size_a", "_size_b", "_marks_a", "_marks_b"), make, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b), a settled table, whose texts (node, _text) have the similarity or more."""

    def make():
        last = [None, None]

        def step(cols):
            for a, b, s, t in zip(*cols):
                if last[0] != a:  # pairs come in order of a
                    last[:] = a, np.unique(shingle_hashes(s, width))
                mine, theirs = last[1], np.unique(shingle_hashes(t, width))
                shared = len(np.intersect1d(mine, theirs, assume_unique=True))
                if shared >= similarity * (len(mine) + len(theirs) - shared):
                    yield a, b

        return step

    texts = settle(among(texts, F.col("node"), pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    side = lambda n: texts.select(F.col("node").alias(n), F.col("_text").alias(f"_text_{n}"))
    full = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "_text_a", "_text_b")
    return map_rows(full.sortWithinPartitions("a"), make, "a long, b long")


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes of the most frequent shingles in a sample of texts (columns node, _text), the rarer first."""

    def make():
        def step(cols):
            for (t,) in zip(*cols):
                yield (np.unique(shingle_hashes(t, width)).view(np.int64).tolist(),)

        return step

    some = texts.filter(F.pmod(F.xxhash64("node", F.lit(17)), F.lit(SAMPLE)) == 0).select("_text")
    each = map_rows(some, make, "own array<long>", rows=5_000).select(F.explode("own").alias("h"))
    counts = settle(each.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN))
    rows = frequent(counts, "n", COMMON, "h").toArrow()  # COMMON rows at most
    unsettle(counts)
    h, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    return h[np.lexsort((h, n))]


def prefix(own: np.ndarray, common: np.ndarray, ranks: np.ndarray, similarity: float) -> list[int]:
    """The first shingles of a set in an order that is the same for all sets: others by hash, then common ones by rank.
    Sets of the similarity or more share one of these. common is sorted, with the rank of each."""
    n = len(own)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        known = common[at] == own
        own = np.concatenate((own[~known], own[known][np.argsort(ranks[at[known]])]))
    return own[: n - math.ceil(similarity * n - 1e-9) + 1].view(np.int64).tolist()


def prefixes(texts: DataFrame, width: int, similarity: float, common: np.ndarray) -> DataFrame:
    """node, size, own (the prefix of the text's shingles) of texts (columns node, _text)."""
    order = np.argsort(common)
    keys, ranks = common[order], order

    def make():
        def step(cols):
            for i, t in zip(*cols):
                own = np.unique(shingle_hashes(t, width))
                if len(own):
                    yield i, len(own), prefix(own, keys, ranks, similarity)

        return step

    return map_rows(texts.select("node", "_text"), make, "node long, size int, own array<long>", rows=5_000)


def missed_links(texts: DataFrame, labels: DataFrame, width: int, similarity: float, sets: DataFrame | None = None) -> DataFrame:
    """a, b: the pairs of texts (node, _text) of the similarity or more that labels (node, _group, of all texts) don't join
    yet. What sets (node, size, marks) rule out isn't looked into.

    Exact: the first shingle that such a pair has in common lies in both prefixes, and what follows it in the shorter
    remainder is all that they can share besides.
    """
    own = prefixes(texts, width, similarity, common_shingles(texts, width))
    grouped = settle(labels.filter("node <> _group").select("node", "_group"))  # prefixes stay where they are
    few = grouped.count() <= MOST_SENT
    own = own.join(F.broadcast(grouped) if few else grouped, "node", "left").withColumn("_group", F.coalesce("_group", "node"))
    rows = settle(own.select("node", "_group", "size", F.posexplode("own").alias("at", "shingle")))
    # Only shingles of more than one group can link anything; most are of one text.
    shared = settle(rows.groupBy("shingle").agg(F.min("_group").alias("lo"), F.max("_group").alias("hi")).filter("lo <> hi").select("shingle"))
    # Most others stay where they are: a filter of at most FILTER bits is sent to all tasks, before the exact join.
    bits = min(FILTER, 1 << (16 * shared.count() + 32_768).bit_length())
    place = F.col("shingle").bitwiseAND(F.lit(bits - 1))
    left = settle(among(rows, place, shared.select(place.alias("place"))).join(shared, "shingle"))
    right = left.select("shingle", *(F.col(c).alias(f"{c}_2") for c in ("node", "_group", "size", "at")))
    most = F.least(F.col("size") - F.col("at"), F.col("size_2") - F.col("at_2"))  # with the shingle itself
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("size_2")) - 1e-6)
    pairs = left.join(right, "shingle").filter((F.col("node") < F.col("node_2")) & (F.col("_group") != F.col("_group_2")) & (most >= least))
    pairs = settle(pairs.select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct())
    unsettle(grouped, rows, shared, left)
    return verified(pairs if sets is None else settle(likely(pairs, sets, similarity)), texts, width, similarity)


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, _group, _keep for each row of docs, which has a _row: the least _row of its group, and whether it is the one
    with the group's smallest id, null last, and of equal ids the first.

    Linked are texts whose sets of `width`-word shingles, in lower case, have a Jaccard similarity of `similarity` or
    more; groups are connected by links. Texts with the same words are one node before anything is compared, wordless
    and null ones too. In a first pass shards come from shared anchors, as shards of fingerprint blocks can't reach the
    ten bits or more that such pairs differ by; in a shard's BK-tree each text finds its nearest, and whole shingle sets
    decide. So a group of near copies is joined by about as many links as it has members. A second pass finds every pair
    that the first left in two groups, by prefixes of shingle sets.
    """
    found = settle(sketches(docs, width, "_row", text_col))
    same_words = F.min(F.struct("_row", "fingerprint", "size", "marks", "anchors"))  # equal words: all of these but _row are equal
    nodes = settle(found.groupBy("class").agg(same_words.alias("_m")).select("class", F.col("_m._row").alias("node"), *(F.col(f"_m.{c}").alias(c) for c in ("fingerprint", "size", "marks", "anchors"))))
    rows = nodes.select("node", "fingerprint", F.explode("anchors").alias("shard"))
    # Shards with the same members are looked into once: similar texts share most of their anchors.
    members = [F.count("*").alias("_n"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(5))).alias("_y")]
    same = settle(rows.groupBy("shard").agg(*members).filter("_n > 1").groupBy("_n", "_x", "_y").agg(F.min("shard").alias("shard")).select("shard"))
    dealt = settle(deal(rows.join(same, "shard"), "shard", "node"))
    pairs = settle(nearest_links(dealt).distinct())
    unsettle(same, dealt)
    texts = docs.select(F.col("_row").alias("node"), F.col(text_col).alias("_text"))
    joined = components(settle(verified(settle(likely(pairs, nodes, similarity)), texts, width, similarity)))
    known = settle(nodes.filter("anchors IS NOT NULL").select("node").join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("_group")))
    missed = settle(missed_links(among(texts, F.col("node"), known.select("node")), known, width, similarity, nodes))
    joined = components(missed.unionByName(joined.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))))
    labels = settle(nodes.select("class", "node").join(joined, "node", "left").select(F.col("class").alias("_class"), F.coalesce("component", "node").alias("_group")))
    ids = docs.select(F.col("_row").alias("_r"), F.col(id_col).alias("_id"))
    placed = settle(found.select("_row", "class").join(labels, F.col("class") == F.col("_class")).select("_row", "_group").join(ids, F.col("_row") == F.col("_r")))
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r")))
    firsts = settle(placed.groupBy("_group").agg(first.alias("_f")).select("_group", F.col("_f.r").alias("_first")))
    return placed.select("_row", "_group").join(firsts, "_group").select("_row", "_group", (F.col("_row") == F.col("_first")).alias("_keep"))


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, of each group of near_duplicates() only the first. An empty table gives an empty one."""
    rows = numbered(docs)
    found = near_duplicates(rows, width, similarity, renamed(rows, id_col), renamed(rows, text_col))
    return without(rows, settle(found.filter(~F.col("_keep")).select("_row")))
