"""Ranked lexical search: bit-sliced Bloom signatures bound every score from above, what can't be excluded is rescored."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terradelta.llm.membership import likely, marks
from terradelta.llm.tables import slices, staged, utf8
from terradelta.llm.words import terms

BEST = 10
FIRST_LOOK = 16  # documents of each item, by upper bound, whose exact scores set the mark to reach
MAX_TERMS = 100_000  # item terms held by a task; a larger benchmark is searched in several passes over the signatures
#: A term that occurs tf times is entered once for each of these that tf reaches, so bounds know tf exactly up to 6.
TIMES = np.array([1, 2, 3, 4, 5, 6, 8, 11, 16, 24, 36, 54, 81, 122, 183, 275], np.int64)
BITS, HASHES = 12, 4  # signature bits for each entry of the fullest document of a block, and those that an entry sets
_CELLS = 1 << 22  # bits of a block
_ELEMENTS = 1 << 20  # numbers of a block that are summed up at a time


class Items(NamedTuple):
    """Benchmark items of one pass. Terms of item i: ``term[start[i]:start[i + 1]]``, as numbers into ``hashes``."""

    ids: list
    words: list[bytes]
    hashes: np.ndarray
    weights: np.ndarray
    term: np.ndarray
    start: np.ndarray
    n_docs: int
    n_terms: int


# --- signatures ---------------------------------------------------------------------------------------------------


def _spots(hashes: np.ndarray, level: np.ndarray | int, width: int) -> np.ndarray:
    """Bits of entries (term hash, level) in a signature of ``width`` bits, HASHES for each."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(width)).astype(np.int64)


def _levels(counts: np.ndarray) -> np.ndarray:
    """How many of TIMES each count reaches."""
    return np.searchsorted(TIMES, counts, "right")


def _room(size: int) -> tuple[int, int]:
    """Signature bits, and documents in a block, of documents with up to ``size`` entries."""
    width = BITS * size
    return width, min(512, max(8, _CELLS // width // 8 * 8))


def _block(size: int, docs: list[tuple[int, int, np.ndarray, np.ndarray]]) -> tuple:
    """The block row of documents (doc_id, n, term hashes, levels): slice j holds bit j of every document's signature."""
    width, room = _room(size)
    columns = -(-len(docs) // 8) * 8
    bits = np.zeros((width, columns), bool)
    for column, (_, _, hashes, levels) in enumerate(docs):
        level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
        bits[_spots(np.repeat(hashes, levels), level, width).ravel(), column] = True
    return width, [d[0] for d in docs], [d[1] for d in docs], np.packbits(bits, axis=1).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """Blocks ``(width, ids, lengths, slices)`` of the rows of ``docs`` with a doc_id and a term.

    A document's signature is a Bloom filter of its terms, each entered once for every count in TIMES that it
    reaches. Documents of similar size, by powers of two, share a block, whose bitmaps are stored by slices: one
    bit of all its documents together. A task fills blocks as it reads and holds at most one open for each size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, list] = {}
        for block in slices(batches):
            for doc_id, text in zip(block.column(0).to_pylist(), utf8(block.column(1))):
                counts = Counter(terms(text))
                if not counts:
                    continue
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts))
                found = np.fromiter(counts.values(), np.int64, len(counts))
                levels = _levels(found)
                size = 1 << max(4, int(levels.sum() - 1).bit_length())
                rows = open_blocks.setdefault(size, [])
                rows.append((doc_id, int(found.sum()), hashes, levels))
                if len(rows) == _room(size)[1]:
                    yield _batch([_block(size, open_blocks.pop(size))], _BLOCKS)
        for size, rows in open_blocks.items():
            yield _batch([_block(size, rows)], _BLOCKS)

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "width long, ids array<long>, lengths array<long>, slices binary")


_BLOCKS = pa.schema([("width", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("slices", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


# --- items and statistics -----------------------------------------------------------------------------------------


def _passes(benchmark: DataFrame, max_terms: int) -> Iterator[dict[object, set[bytes]]]:
    """Terms of each item, in groups of items with about ``max_terms`` terms at most; one group at a time is held."""
    sized = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // (2 * max_terms)))  # a term and its separator take two characters at least
    for part in range(parts):
        found: dict[object, set[bytes]] = {}
        for row in sized.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toLocalIterator():
            found.setdefault(row["item_id"], set()).update(terms(row["text"].encode()))
        yield found


def _statistics(docs: DataFrame, words: list[bytes]) -> dict[int, int]:
    """Documents that hold each of the words, by number; at -1 those with any term, at -2 all terms of the corpus."""
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        known, counts, n_docs, n_terms = number.keys(), np.zeros(len(number), np.int64), 0, 0
        for block in slices(batches):
            for text in utf8(block.column(0)):
                found = terms(text)
                n_docs += bool(found)
                n_terms += len(found)
                for word in known & set(found):
                    counts[number[word]] += 1
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"word": [-1, -2, *held.tolist()], "n": [n_docs, n_terms, *counts[held].tolist()]})

    counted = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}  # at most a row for each word


def weigh(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def prepared(docs: DataFrame, found: dict[object, set[bytes]]) -> Items:
    """Items with the weights of their terms; terms that no document holds are left out."""
    words = sorted(set().union(*found.values()))
    stats = _statistics(docs, words)
    held = [w for i, w in enumerate(words) if i in stats]
    weights = np.array([weigh(stats[i], stats[-1]) for i, w in enumerate(words) if i in stats], np.int64)
    number = {w: i for i, w in enumerate(held)}
    ids = sorted(found, key=str)
    lists = [sorted(number[w] for w in found[i] if w in number) for i in ids]
    start = np.cumsum([0, *map(len, lists)])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, held), np.uint64, len(held))
    term = np.array([t for x in lists for t in x], np.int64)
    return Items(ids, held, hashes, weights, term, start, stats.get(-1, 0), stats.get(-2, 0))


def _damping(lengths: np.ndarray, items: Items) -> np.ndarray:
    """A document's m from its number of terms."""
    return 100 - 90 + 90 * lengths * items.n_docs // max(1, items.n_terms)


# --- bounds -------------------------------------------------------------------------------------------------------


def bounds(items: Items, width: int, lengths: np.ndarray, bits: bytes) -> np.ndarray:
    """Upper bounds of the scores, items by documents, as exact integers.

    A term's slices, combined, mark every document that holds it and a few others. The highest level marked
    gives the largest count that the term can have there, and the score grows with the count.
    """
    sliced = np.frombuffer(bits, np.uint8).reshape(width, -1)
    m = _damping(np.pad(lengths, (0, 8 * sliced.shape[1] - len(lengths)), constant_values=1), items)
    most = np.append(TIMES[1:] - 1, 1 << 40)  # a billion times this fits into 64 bits only after the division below
    parts = np.array([np.zeros_like(m), *((1_000_000_000 * t) // (1000 * t + 8 * m) for t in most[:-1]), np.full_like(m, 1_000_000)])
    level = np.zeros((len(items.words), len(m)), np.uint8)
    active = np.arange(len(items.words))
    held = np.full((len(active), sliced.shape[1]), 255, np.uint8)
    for number in range(len(TIMES)):
        spots = _spots(items.hashes[active], number, width)
        for k in range(HASHES):
            held = held & sliced[spots[:, k]]
        some = held.any(axis=1)
        active, held = active[some], held[some]
        if not len(active):
            break
        level[active] += np.unpackbits(held, axis=1)
    out = np.zeros((len(items.ids), len(m)), np.int64)
    columns = np.arange(len(m))
    first, per_turn = 0, max(1, _ELEMENTS // len(m))
    while first < len(items.ids):
        last = max(first + 1, int(np.searchsorted(items.start, items.start[first] + per_turn, "right")) - 1)
        begin, end = items.start[first], items.start[last]
        if end > begin:
            chosen = items.term[begin:end]
            value = parts[level[chosen], columns] * items.weights[chosen][:, None]
            filled = np.flatnonzero(np.diff(items.start[first : last + 1]))  # reduceat can't sum an empty range
            out[first + filled] = np.add.reduceat(value, items.start[first:last][filled] - begin, axis=0)
        first = last
    return out[:, : len(lengths)]


def _judged(blocks: pa.RecordBatch, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for width, ids, lengths, bits in zip(*(blocks.column(n) for n in _BLOCKS.names)):
        yield np.array(ids.as_py(), np.int64), bounds(items, width.as_py(), np.array(lengths.as_py(), np.int64), bits.as_py())


_PAIRS = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("bound", pa.int64())])


def _most_promising(blocks: DataFrame, sent, count: int) -> DataFrame:
    """``(item, doc_id, bound)``: the ``count`` documents of each item with the highest bounds, smaller doc_ids first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        best, who = np.zeros((len(items.ids), 0), np.int64), np.zeros((len(items.ids), 0), np.int64)
        for batch in batches:
            for ids, bound in _judged(batch, items):
                best, who = np.hstack([best, bound]), np.hstack([who, np.broadcast_to(ids, bound.shape)])
                order = np.lexsort((who, -best), axis=1)[:, :count]
                best, who = np.take_along_axis(best, order, 1), np.take_along_axis(who, order, 1)
        item, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(who[item, place]), pa.array(best[item, place])], schema=_PAIRS)

    found = blocks.mapInArrow(run, "item long, doc_id long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).drop("place")


def _not_excluded(blocks: DataFrame, sent, marks_to_reach: dict[int, tuple[int, int]]) -> DataFrame:
    """``(item, doc_id, bound)``: all documents whose bound may still rank them above the mark (score, doc_id) of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        least = np.array([marks_to_reach.get(i, (0, 0))[0] for i in range(len(items.ids))])[:, None]
        last = np.array([marks_to_reach.get(i, (0, 0))[1] for i in range(len(items.ids))])[:, None]
        for batch in batches:
            for ids, bound in _judged(batch, items):
                item, place = np.nonzero((bound > least) | (bound == least) & (bound > 0) & (ids <= last))
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids[place]), pa.array(bound[item, place])], schema=_PAIRS)

    return blocks.mapInArrow(run, "item long, doc_id long, bound long")


# --- exact scores -------------------------------------------------------------------------------------------------


def _rescored(docs: DataFrame, pairs: DataFrame, sent) -> DataFrame:
    """``(item, doc_id, score)`` of the ``pairs``, from whole texts. Only texts of the pairs' documents move."""
    wanted = staged(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")), "wanted")  # items of one pass at most
    near = likely(docs.select("doc_id", "text"), [F.col("doc_id")], marks(wanted.select("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        number = {w: i for i, w in enumerate(items.words)}
        for batch in slices(batches):
            out = []
            for doc_id, text, wanted in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                found = terms(text)
                tf = np.zeros(len(items.words), np.int64)
                for word, n in Counter(w for w in found if w in number).items():
                    tf[number[word]] = n
                held = np.flatnonzero(tf)
                m, n = _damping(np.array(len(found)), items), tf[held]
                score = np.zeros(len(tf), np.int64)
                score[held] = items.weights[held] * (1_000_000_000 * n // (1000 * n + 8 * m))
                out += [(i, doc_id, int(score[items.term[items.start[i] : items.start[i + 1]]].sum())) for i in wanted]
            yield _batch(out, pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    met = near.join(wanted, "doc_id").select("doc_id", "text", "items")
    return met.mapInArrow(run, "item long, doc_id long, score long").where("score > 0")


def _ranked(scores: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(docs: DataFrame, benchmark: DataFrame, best: int = BEST, max_terms: int = MAX_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``best`` documents with a score above 0 for each item, ties by doc_id.

    Texts are cut into ``words.terms``; null has none. N: documents with a term; L: all terms; a term in df
    documents weighs w = floor(1000 * ln((2 N + 2) / (2 df + 1))); a document of n terms has m = 10 + 90 n N div L
    and scores the sum of w * (10 ** 9 tf div (1000 tf + 8 m)) over the item's terms, each once.

    The signatures bound all scores from above. The exact scores of the FIRST_LOOK most promising documents of
    an item give a mark, the best-th of them; every document whose bound does not fall short of it is scored
    exactly, however many there are. Rows without doc_id count in N, L and df, but are not ranked; repeated rows
    are ranked each; items of equal item_id are one with the terms of all; items without item_id or term, and an
    empty corpus, give no rows. What goes to the driver and to all tasks is bounded by ``max_terms``.
    """
    blocks, kind, results = staged(signatures(docs), "signatures"), benchmark.schema["item_id"].dataType, None
    for found in _passes(benchmark, max_terms):
        items = prepared(docs, found)
        sent = docs.sparkSession.sparkContext.broadcast(items)
        look = _rescored(docs, staged(_most_promising(blocks, sent, max(best, FIRST_LOOK)), "promising"), sent)
        last = _ranked(look, best).where(F.col("rank") == best)
        to_reach = {r["item"]: (r["score"], r["doc_id"]) for r in last.collect()}  # a row for each item of the pass
        scored = _ranked(_rescored(docs, staged(_not_excluded(blocks, sent, to_reach), "left"), sent), best)
        names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), StructType([StructField("item", LongType()), StructField("item_id", kind)]))
        ranked = scored.join(names, "item").select("item_id", "rank", "doc_id", "score")
        results = ranked if results is None else results.unionByName(ranked)
    return results
