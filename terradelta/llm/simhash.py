"""SimHash near-duplicates: fingerprints, a grid range join of segment popcounts, exact check, groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.llm.components import components
from terradelta.llm.membership import listed_rows, one_of_repeated
from terradelta.llm.tables import slices, staged, utf8
from terradelta.llm.words import tokens

SHINGLE = 3
SEED = 42
RADIUS = 2  # bits in which linked fingerprints may differ
BLOCK = 1024  # fingerprints of a crowded cell that a task compares with as many others
_BLOCK = 1 << 14  # shingles whose bits are counted at a time


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 for a text without words."""
    words = tokens(text)
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    n, ones = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    for _ in range(0, n, _BLOCK):
        block = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in islice(parts, _BLOCK)), ">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs``; fp holds the 64 bits as a signed long. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in utf8(part.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The embedding: ones in each of the 32 two-bit segments, packed as 32 two-bit numbers into a long."""
    low, high = (x.bitwiseAND(F.lit(0x5555555555555555)) for x in (fp, F.shiftrightunsigned(fp, 1)))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def cells(point: Column, segments: int = 32) -> Column:
    """Grid cells within Manhattan distance 1 of an embedded point, in its lowest ``segments`` coordinates.

    Two points at distance 2 or less have one of these in common: on a shortest path between them lies a
    point at most 1 from either, and its coordinates stay between theirs.
    """
    out = [point]
    for j in range(segments):
        at = F.shiftrightunsigned(point, 2 * j).bitwiseAND(F.lit(3))
        out += [F.when(at < 2, point.bitwiseXOR(F.shiftleft((at + 1).bitwiseXOR(at), 2 * j)))]
        out += [F.when(at > 0, point.bitwiseXOR(F.shiftleft((at - 1).bitwiseXOR(at), 2 * j)))]
    return F.filter(F.array(*out), lambda c: c.isNotNull())


def candidates(fps: DataFrame, segments: int = 32) -> DataFrame:
    """``(cell, fp, n)``: the grid range join. Fingerprints beside those that share a cell with them, n in all.

    The Manhattan distance of segment popcounts never exceeds the number of differing bits, so two that
    differ in 2 bits or less share a cell. Each registers in at most 65 cells whatever the data; crowded cells
    are counted before the shuffle, and those of a single fingerprint go.
    """
    placed = fps.select("fp", F.explode(cells(popcounts(F.col("fp")), segments)).alias("cell"))
    shared = staged(placed.groupBy("cell").agg(F.count("*").alias("n")).where("n >= 2"), "cells")
    return staged(placed.join(shared, "cell"), "near")


def links(fps: DataFrame, segments: int = 32) -> DataFrame:
    """Exact links ``(hi, lo)`` among distinct fingerprints ``fp``: enough of them to join all that differ in 2 bits.

    Fingerprints of fewer than 32 two-bit ``segments`` may be marked in the bits above: only those of equal marks
    link, if marks are made of zeros and pairs of ones.

    The fingerprints of a cell are verified against each other inside tasks. A crowded cell is dealt out in
    blocks, every two of which meet in a task: what moves is its fingerprints times its blocks, and what comes
    back at most one link for each fingerprint, however many pairs there are.
    """
    near = candidates(fps, segments)
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = near.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, "block").alias("one"), F.greatest(j, "block").alias("other")))
    met = dealt.select("cell", "fp", "block", F.inline(others))

    def run(rows: pa.Table) -> pa.Table:
        fp, block = rows.column("fp").to_numpy().astype(np.int64), rows.column("block").to_numpy()
        one, other = int(rows.column("one")[0].as_py()), int(rows.column("other")[0].as_py())
        a, b = np.sort(fp[block == one]), np.sort(fp[block == other])
        near = np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= RADIUS
        i, j = np.nonzero(np.triu(near, 1) if one == other else near)
        above = np.arange(len(a) + (0 if one == other else len(b)))
        out = []
        for x, y in zip(i.tolist(), (j if one == other else j + len(a)).tolist()):
            u, v = _root(above, x), _root(above, y)
            if u != v:
                above[u] = v
                ends = int(a[x]), int(b[y] if one == other else b[y - len(a)])
                out.append((max(ends), min(ends)))
        return pa.table([pa.array([h for h, _ in out], pa.int64()), pa.array([l for _, l in out], pa.int64())], names=["hi", "lo"])

    return met.groupBy("cell", "one", "other").applyInArrow(run, "hi long, lo long")


def _root(above: np.ndarray, x: int) -> int:
    while above[x] != x:
        above[x] = above[above[x]]
        x = above[x]
    return x


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``: groups of texts whose fingerprints link.

    Copies of a fingerprint are one node. component_id is the smallest doc_id of the group; rows without
    doc_id take part but name no group (null only if the whole group has no doc_id). Repeated rows give
    repeated results; a text without words has fingerprint 0; an empty table gives an empty one.
    """
    prints = staged(fingerprints(docs, shingle), "prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = staged(components(links(nodes)), "roots")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    known = staged(rooted.join(named, "root").select("fp", "component_id"), "known")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, the one with the smallest doc_id.

    Of repeated rows with that doc_id one stays. Rows without doc_id all stay, as nothing tells them apart.
    """
    found = groups(docs, shingle)
    keep = staged(found.where("doc_id = component_id").select("doc_id").distinct(), "keep")
    kept = one_of_repeated(listed_rows(docs, "doc_id", keep), "doc_id")
    return kept.unionByName(docs.where("doc_id IS NULL"))
