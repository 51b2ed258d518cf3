"""Suffix-array deduplication: repeated passages from suffixes at content-selected positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terradelta.llm.tables import shared_keys, slices, staged, utf8
from terradelta.llm.words import tokens

PASSAGE = 50  # words of the shortest repeat that is reported
SPREAD = 20  # positions of which at least one suffix is retained
STEM = PASSAGE - SPREAD + 1  # words by which suffixes are first compared
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolled(values: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of ``size`` values, all in one pass."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, len(values)), dtype=np.uint64)])
    out = (sums[size:] - sums[:-size]) * _powers(_INVERSE, n)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(32)


def minimisers(stems: np.ndarray, spread: int = SPREAD) -> np.ndarray:
    """For each window of ``spread`` stems the place of its smallest one, the first of equals."""
    if len(stems) < spread:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(stems, spread).argmin(1) + np.arange(len(stems) - spread + 1)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def suffixes(texts: DataFrame) -> DataFrame:
    """``(key, first, end, at, stem, turn)``: retained suffixes of each text and the hash of their first STEM words.

    A window of PASSAGE words retains the suffix at the smallest of its stems, so equal windows retain
    equal suffixes. ``first`` to ``end`` are the words of all windows that chose the suffix at word ``at``,
    and ``turn`` is a hash of them and of the suffix's place among them: equal turns have all these windows
    in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for key, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                words = hashes(tokens(text))
                stems = rolled(words, STEM)
                chosen = minimisers(stems)
                if not len(chosen):
                    continue
                at, first, count = np.unique(chosen, return_index=True, return_counts=True)
                ends = first + count - 1 + PASSAGE  # the windows that choose a suffix follow each other
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64)])
                turn = (sums[ends] - sums[first]) * _powers(_INVERSE, len(words))[first]
                turn = turn * np.uint64(0xD6E8FEB86659FD93) + ((at - first) * 64 + count).astype(np.uint64)
                for a in range(0, len(at), 8192):
                    cut = slice(a, a + 8192)
                    size = len(at[cut])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key] * size, pa.int64()),
                            *(pa.array(x[cut].astype(np.int32)) for x in (first, ends, at)),
                            _signed(stems[at[cut]]),
                            _signed(turn[cut]),
                        ],
                        ["key", "first", "end", "at", "stem", "turn"],
                    )

    return texts.select("key", "text").mapInArrow(run, "key long, first int, end int, at int, stem long, turn long")


def _windows(texts: DataFrame) -> DataFrame:
    """``(key, at, window)``: the hash of each window of PASSAGE words whose suffix is among ``stems`` of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for key, text, wanted in zip(part.column(0).to_pylist(), utf8(part.column(1)), part.column(2).to_pylist()):
                words = hashes(tokens(text))
                chosen = minimisers(rolled(words, STEM))
                at = np.flatnonzero(np.isin(chosen, np.array(wanted, np.int64)))
                found = rolled(words, PASSAGE)[at]
                for a in range(0, len(at), 8192):
                    cut = slice(a, a + 8192)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(at[cut]), pa.int64()), pa.array(at[cut].astype(np.int32)), _signed(found[cut])],
                        ["key", "at", "window"],
                    )

    return texts.select("key", "text", "wanted").mapInArrow(run, "key long, at int, window long")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``(key, first, end)``: words of each text in a window of PASSAGE words that occurs twice or more; spans may overlap.

    Suffixes are grouped by the hash of their stem, then of their turn, in place of a sort of their words: equal
    suffixes meet as neighbours would, and both are counted before they meet, so a passage that a third of all
    texts share is a few rows and no task holds its run of the sorted array. Turns found twice are repeats in full. Where a stem has
    several turns, as at the ends of a repeat, one place of each turn is extended: its windows to the left
    and right of the suffix are compared one by one. Nothing pairs places with each other.
    """
    found = staged(suffixes(texts), "suffixes")
    turns = staged(found.groupBy("stem", "turn").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one")), "turns")
    whole = found.join(turns.where("n >= 2").select("stem", "turn"), ["stem", "turn"], "left_semi")
    mixed = shared_keys(turns, "stem", "stems")
    ends = turns.join(mixed, "stem", "left_semi").groupBy("one.key").agg(F.collect_list("one.at").alias("wanted"))
    windows = staged(_windows(texts.join(ends, "key").dropDuplicates(["key"])), "windows")
    again = windows.join(shared_keys(windows, "window", "repeats"), "window", "left_semi")
    return whole.select("key", "first", "end").union(again.select("key", "at", F.col("at") + F.lit(PASSAGE)))


def repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, first_word, end_word)`` for every maximal run of words in repeated passages.

    Words are as in ``words.tokens``; a passage is PASSAGE words or more that stand, word for word, at two or
    more places of any texts. One row for each run and row of ``docs``; a text without repeats has none.
    Null and short texts have none, rows without doc_id are compared like others, repeated rows repeat
    each other, an empty table gives an empty result. Words are compared by 64-bit hashes of whole windows.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    before = Window.partitionBy("key").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, 0)
    spans = repeated_spans(texts).withColumn("fresh", F.coalesce(F.col("first") > F.max("end").over(before), F.lit(True)).cast("int"))
    runs = spans.withColumn("run", F.sum("fresh").over(upto)).groupBy("key", "run")
    merged = staged(runs.agg(F.min("first").alias("first_word"), F.max("end").alias("end_word")).drop("run"), "runs")
    named = texts.select("doc_id", "key").join(merged, "key")
    return named.select("doc_id", F.col("first_word").cast("long"), F.col("end_word").cast("long"))
