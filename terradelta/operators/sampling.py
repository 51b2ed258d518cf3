"""Row-major ranks of mask pixels and evenly spaced samples of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradelta.functions.numbers import int_div
from terradelta.operators.bitrows import bit_at, core_width, shift_left

SAMPLE_SIZE = 200  # fixed value: most points shown per class


def class_long(words: DataFrame, keys: Sequence[str], classes: dict[str, Column]) -> DataFrame:
    """One row per word and class that has a pixel set: keys, class, tile_row, word, row, bits."""
    options = F.array(
        *[F.struct(F.lit(name).alias("class"), bits.alias("bits")) for name, bits in classes.items()]
    )
    return words.select(*keys, "tile_row", "word", "row", F.inline(options)).where("bits != 0")


def rank_words(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``start``, the row-major rank of a word's first pixel, ``hits`` and ``n``, pixels per key.

    Ranks are built in three levels: a running count inside each raster row, one of the rows of a tile (a number
    each), and one of the tiles. No task sees all words of a key, or of a tile, however wide the raster is.
    """
    tile, line = [*keys, "tile_row"], [*keys, "tile_row", "row"]
    counted = words.withColumn("hits", F.bit_count("bits").cast("long"))
    over_tiles = Window.partitionBy(*keys).orderBy("tile_row")
    tile_starts = (
        counted.groupBy(*tile)
        .agg(F.sum("hits").alias("tile_hits"))
        .select(
            *tile,
            (F.sum("tile_hits").over(over_tiles) - F.col("tile_hits")).alias("tile_start"),
            F.sum("tile_hits").over(Window.partitionBy(*keys)).alias("n"),
        )
    )
    over_rows = Window.partitionBy(*tile).orderBy("row")
    row_starts = (
        counted.groupBy(*line)
        .agg(F.sum("hits").alias("row_hits"))
        .select(*line, (F.sum("row_hits").over(over_rows) - F.col("row_hits")).alias("row_start"))
        .join(tile_starts, tile)
        .select(*line, (F.col("row_start") + F.col("tile_start")).alias("before"), "n")
    )
    in_row = Window.partitionBy(*line).orderBy("word")
    return (
        counted.withColumn("start", F.sum("hits").over(in_row) - F.col("hits"))
        .join(row_starts, line)
        .withColumn("start", F.col("start") + F.col("before"))
        .drop("before")
    )


def rank_pixels(ranked: DataFrame, keys: Sequence[str], halo: int) -> DataFrame:
    """Unfold ranked words: keys, row, col, rank and n of every set pixel."""
    core = core_width(halo)
    position = F.explode(F.sequence(F.lit(halo), F.lit(halo + core - 1))).alias("position")
    lower = shift_left(F.lit(1).cast("long"), F.col("position")) - 1
    return (
        ranked.select(*keys, "row", "word", "bits", "start", "n", position)
        .where(bit_at(F.col("bits"), F.col("position")) == 1)
        .select(
            *keys,
            "row",
            (F.col("word") * core + F.col("position") - halo).cast("long").alias("col"),
            (F.col("start") + F.bit_count(F.col("bits").bitwiseAND(lower))).alias("rank"),
            "n",
        )
    )


def _slot(rank: Column, n: Column, k: int) -> Column:
    """Index of the first sample at or after ``rank`` (n > k > 1)."""
    return int_div(rank * (k - 1) + n - 2, n - 1)


def _slot_rank(slot: Column, n: Column, k: int) -> Column:
    return int_div(slot * (n - 1), k - 1)


def sampled(rank: Column, n: Column, k: int = SAMPLE_SIZE) -> Column:
    """True for the ranks of an evenly spaced sample of k of n, first and last included."""
    if k == 1:
        return rank == 0
    hit = _slot_rank(_slot(rank, n, k), n, k) == rank
    return F.when(n <= k, F.lit(True)).otherwise(hit)


def holds_sample(start: Column, hits: Column, n: Column, k: int = SAMPLE_SIZE) -> Column:
    """True when one of the ranks start .. start + hits - 1 is sampled."""
    if k == 1:
        return start == 0
    slot = _slot(start, n, k)
    hit = (slot < k) & (_slot_rank(slot, n, k) < start + hits)
    return F.when(n <= k, F.lit(True)).otherwise(hit)


def even_sample(ranked: DataFrame, keys: Sequence[str], halo: int, k: int = SAMPLE_SIZE) -> DataFrame:
    """Sampled pixels of ranked words; only words that hold a sample are unfolded."""
    words = ranked.where(holds_sample(F.col("start"), F.col("hits"), F.col("n"), k))
    pixels = rank_pixels(words, keys, halo)
    return pixels.where(sampled(F.col("rank"), F.col("n"), k))
