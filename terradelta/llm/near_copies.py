"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, verified exactly.

SimHash fingerprints of the sets meet in the popcount grid of ``simhash``, and what it finds is verified and tied
first. Its reach of two bits a word is short for a similarity near 0.8, so what shares a band of minima and is not
tied yet is compared to the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.llm import simhash
from terradelta.llm.components import components
from terradelta.llm.membership import listed_rows, one_of_repeated
from terradelta.llm.tables import drop_staged, shared_keys, slices, staged, utf8
from terradelta.llm.words import tokens

SHINGLE = 5
WORDS, BITS = 4, 48  # words of a fingerprint, each in a popcount grid of its own, and the bits of a word
BANDS, ROWS = 24, 5  # a pair of similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS
BLOCK = 256  # nodes of a block of those that are compared with all others at a band value
SEED = 42
_SUMMED = 1 << 14  # shingles whose bits are summed up at a time
_MARKS = [sum(3 << (BITS + 2 * b) for b in range(8) if i >> b & 1) for i in range(WORDS)]
_DRAWN = np.random.default_rng(SEED).integers(1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64)
_TIMES, _PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The set of 64-bit hashes of the word shingles, sorted; a text of fewer words is one shingle, none without words."""
    words = tokens(text)
    if not words:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(lambda p: xxhash.xxh64_intdigest(p, SEED), parts), np.uint64))


def _digest(found: np.ndarray) -> int:
    """Names a set of shingles; equal sets are one node."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def _mixed(found: np.ndarray, turn: int) -> np.ndarray:
    """Other 64-bit hashes of the same shingles, a set for each turn (the finalizer of SplitMix64)."""
    x = found + np.uint64(((turn + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(found: np.ndarray) -> list[int]:
    """The words of a set's SimHash, each marked with its number above its bits; none for an empty set.

    A bit is 1 if it is set in over half the shingles' hashes, as in ``simhash``. Marks are pairs of ones.
    """
    if not len(found):
        return []
    ones, n_bytes = np.zeros(WORDS * BITS, np.int64), WORDS * BITS // 8
    for at in range(0, len(found), _SUMMED):
        mixed = np.stack([_mixed(found[at : at + _SUMMED], turn) for turn in range(-(-n_bytes // 8))], 1)
        ones += np.unpackbits(mixed.view(np.uint8)[:, :n_bytes], axis=1).sum(0, dtype=np.int64)
    words = np.packbits(2 * ones > len(found)).reshape(WORDS, -1)
    return [int.from_bytes(word.tobytes(), "big") | _MARKS[i] for i, word in enumerate(words)]


def bands(found: np.ndarray) -> list[int]:
    """A hash for each band of ROWS minima; none for an empty set."""
    if not len(found):
        return []
    least = np.array([(found * t + p).min() for t, p in zip(_TIMES, _PLUS)], np.uint64)
    return [xxhash.xxh64_intdigest(row.tobytes(), b) - (1 << 63) for b, row in enumerate(least.reshape(BANDS, ROWS))]


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, node, words, bands)`` per row of ``docs``. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingles(t, shingle) for t in utf8(part.column(1))]
            numbers = [pa.array(map(f, sets), pa.list_(pa.int64())) for f in (fingerprint, bands)]
            columns = [part.column(0), pa.array(map(_digest, sets), pa.int64()), *numbers]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "words", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, words array<long>, bands array<long>")


def grid_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates ``(hi, lo)`` of the popcount grid, staged: enough to join all ``nodes`` that have a word which differs in 2 bits or less.

    ``nodes`` are (node, words). The words that link are as many at most as ``simhash.links`` says; nodes of
    an equal word are tied to the smallest of them.
    """
    worded = staged(nodes.select("node", F.explode("words").alias("fp")), "words")
    named = staged(worded.groupBy("fp").agg(F.min("node").alias("first")), "fps")
    equal = worded.join(named, "fp").select("node", F.col("first").alias("other"))
    ends = [named.select(F.col("fp").alias(end), F.col("first").alias(name)) for end, name in (("hi", "node"), ("lo", "other"))]
    linked = simhash.links(named, BITS // 2).join(ends[0], "hi").join(ends[1], "lo").select("node", "other")
    pairs = equal.unionByName(linked).where("node <> other")
    found = staged(pairs.select(F.greatest("node", "other").alias("hi"), F.least("node", "other").alias("lo")).distinct(), "grid")
    drop_staged(worded, named)
    return found


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``(node, hashes)`` of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            sets = [shingles(t, shingle) for t in utf8(part.column(0))]
            columns = [pa.array(map(_digest, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "hashes"])

    return docs.select("text").mapInArrow(run, "node long, hashes array<long>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` ``(hi, lo)`` of nodes whose sets have a Jaccard similarity of 0.8 or more: 9 times what both have is 4 times both sizes."""
    one = sets.select(F.col("node").alias("lo"), F.col("hashes").alias("x"))
    other = sets.select(F.col("node").alias("hi"), F.col("hashes").alias("y"))
    n, m = F.size("x"), F.size("y")
    both = F.when(5 * F.least(n, m) >= 4 * F.greatest(n, m), F.size(F.array_intersect("x", "y"))).otherwise(0)
    return pairs.join(one, "lo").join(other, "hi").where(9 * both >= 4 * (n + m)).select("hi", "lo")


def _leaders(members: DataFrame) -> DataFrame:
    """``(band, leader, tied)``: the member of each band value that shares the most with the rest of the table, and its group.

    A copy that was edited little keeps most of its band values in common with its fellows, so the sum of the
    crowds at its values is large; compared with that one first, most of a crowd is tied at once.
    """
    crowds = members.groupBy("band").agg(F.count("*").alias("n"))
    liked = members.join(crowds, "band").groupBy("node").agg(F.sum("n").alias("liked"))
    best = members.join(liked, "node").groupBy("band").agg(F.max(F.struct("liked", "node", "root")).alias("best"))
    return best.select("band", F.col("best.node").alias("leader"), F.col("best.root").alias("tied"))


def _placed(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``(band, node, root)``, staged: the members and the groups that the links make of them."""
    placed = members.join(components(edges), "node", "left")
    return staged(placed.select("band", "node", F.coalesce("root", "node").alias("root")), "placed")


def _in_blocks(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """``(band, one, other, odd, node, hashes)``: what each comparison of two blocks needs, once for each block that it meets.

    ``placed`` are (band, node, root). At each band value the nodes outside its largest group, the odd ones,
    still have to meet all others: blocks of odd ones against blocks of all nodes.
    """
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("total"), F.count("*").alias("groups"))
    open_bands = staged(most.where("groups >= 2").select("band", F.col("most.root").alias("most"), F.col("most.n").alias("n"), "total"), "open")
    rest = placed.join(open_bands, "band")
    n_odd, n_all = (F.ceil(x / F.lit(BLOCK)).cast("int") for x in (F.col("total") - F.col("n"), F.col("total")))
    odd = rest.where("root <> most").withColumn("one", _turn("node", n_odd, 1)).withColumn("other", F.explode(F.sequence(F.lit(0), n_all - 1)))
    every = rest.withColumn("other", _turn("node", n_all, 2)).withColumn("one", F.explode(F.sequence(F.lit(0), n_odd - 1)))
    names = ["band", "one", "other", "node", "root"]
    both = odd.select(*names, F.lit(True).alias("odd")).unionByName(every.select(*names, F.lit(False).alias("odd")))
    return both.join(sets, "node").select(*names, "odd", "hashes")


def _turn(node: str, blocks: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), node), blocks).cast("int")


def _compared(blocks: DataFrame) -> DataFrame:
    """Links ``(hi, lo)`` that join all similar nodes of each pair of blocks; at most one for each node of the two."""

    def run(rows: pa.Table) -> pa.Table:
        odd = np.array(rows.column("odd").to_pylist(), bool)
        nodes, roots = rows.column("node").to_pylist(), rows.column("root").to_pylist()
        sets = [np.array(x, np.int64) for x in rows.column("hashes").to_pylist()]
        groups = _Groups(roots)
        left = np.flatnonzero(odd)
        hashes = np.concatenate([sets[i] for i in left]) if len(left) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(left)), [len(sets[i]) for i in left])
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        sizes = np.array([len(sets[i]) for i in left], np.int64)
        found: list[tuple[int, int]] = []
        for j in np.flatnonzero(~odd):
            first, last = np.searchsorted(hashes, sets[j], "left"), np.searchsorted(hashes, sets[j], "right")
            spans = [owner[a:b] for a, b in zip(first[first < last], last[first < last])]
            both = np.bincount(np.concatenate(spans), minlength=len(left)) if spans else np.zeros(len(left), np.int64)
            for i in np.flatnonzero(9 * both >= 4 * (sizes + len(sets[j]))):
                a, b = nodes[left[i]], nodes[j]
                if a != b and groups.unite(roots[left[i]], roots[j]):
                    found.append((max(a, b), min(a, b)))
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["hi", "lo"])

    return blocks.groupBy("band", "one", "other").applyInArrow(run, "hi long, lo long")


class _Groups:
    """Groups of roots that links have joined."""

    def __init__(self, roots: list[int]) -> None:
        self.above = {r: r for r in roots}

    def find(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = self.above[self.above[x]]
            x = self.above[x]
        return x

    def unite(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.above[a] = b
        return a != b


def links(members: DataFrame, sets: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Verified links ``(hi, lo)`` that join all similar nodes which share a band value; ``members`` are ``(band, node)``.

    ``near`` are candidates (hi, lo) to verify and tie before: those of the grid. Then, at the band values whose
    nodes are still of several groups, all nodes are compared with one of them, which ties most of a crowd of copies
    at a cost of one comparison a node. At last, where they still are of several groups, the nodes outside the largest
    group are compared with all others, BLOCK against BLOCK inside a task: rows that move are nodes times blocks of
    odd nodes, never pairs, and no pair of different groups is passed over.
    """
    none = members.sparkSession.createDataFrame([], "hi long, lo long")
    first = staged(none if near is None else similar(near, sets), "near")
    placed = _placed(members, first)
    several = placed.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    apart = staged(placed.join(several.select("band"), "band", "left_semi"), "apart")
    met = apart.join(staged(_leaders(apart), "leaders"), "band").where("root <> tied")
    pairs = staged(met.select(F.greatest("node", "leader").alias("hi"), F.least("node", "leader").alias("lo")).distinct(), "pairs")
    edges = staged(first.unionByName(similar(pairs, sets)), "similar")
    rest = staged(_compared(_in_blocks(_placed(apart.select("band", "node"), edges), sets)), "rest")
    return edges.unionByName(rest)


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, node, component_id)`` per row of ``docs`` with a doc_id: groups joined by similar texts.

    component_id is the smallest doc_id of the group. Rows without doc_id take no part; repeated rows give
    repeated results; texts without words are equal; an empty table gives an empty one. Texts stay where they
    lie: only signatures, and the shingle sets of nodes that the grid or a band value brings together, move.
    """
    docs = docs.where("doc_id IS NOT NULL")
    signed = staged(signatures(docs, shingle), "signed")
    nodes = staged(signed.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("words", "bands"))), "nodes")
    near = grid_pairs(nodes)
    banded = nodes.select("node", F.explode("bands").alias("band"))
    members = staged(banded.join(shared_keys(banded, "band", "bands"), "band", "left_semi").select("band", "node"), "banded")
    met = members.select("node").union(near.select("hi")).union(near.select("lo")).distinct()
    wanted = staged(nodes.join(met, "node", "left_semi").select("least"), "wanted")
    sets = _sets(listed_rows(docs.select("doc_id", "text"), "doc_id", wanted), shingle)
    # Of rows with equal doc_id and other texts, each has its own node.
    sets = staged(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
    roots = components(links(members, sets, near))
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    known = staged(rooted.join(named, "root").select("node", "component_id"), "known")
    drop_staged(nodes, members, near, wanted, sets, named)
    return signed.join(known, "node").select("doc_id", "node", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, the one with the smallest doc_id.

    Of repeated rows with that doc_id one stays. Rows without doc_id all stay, as nothing tells them apart.
    """
    found = groups(docs, shingle)
    keep = staged(found.where("doc_id = component_id").select("doc_id").distinct(), "keep")
    kept = one_of_repeated(listed_rows(docs, "doc_id", keep), "doc_id")
    return kept.unionByName(docs.where("doc_id IS NULL"))
