"""Rasters of yes/no pixels as rows of 64-bit words.

A mask pixel is one bit. ``pack`` folds a run of neighbouring pixels of one raster row into a single
``bigint``, so whatever follows (neighbourhood windows, counts, ranks) handles dozens of pixels per
row and shuffles a small fraction of the pixel table. ``spread`` then copies to each word the bits
that lie up to ``halo`` pixels beside, above and below it. After that one exchange every
neighbourhood step of total radius <= ``halo`` is local to a (tile_row, word) group of at most
``TILE_ROWS + 2 * halo`` rows, however large a single raster is.

Columns of a packed table: the keys, ``tile_row``, ``word``, ``row``, ``present`` (which pixels
exist) and one ``bigint`` per flag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.functions.numbers import floor_div

WORD_BITS = 64
TILE_ROWS = 512
MAX_HALO = 16
ADDRESS = ("tile_row", "word", "row")


def core_width(halo: int) -> int:
    """Number of pixels a word owns; the rest of its bits is room for the halo."""
    if not 1 <= halo <= MAX_HALO:
        raise ValueError(f"halo must be in 1..{MAX_HALO}")
    return WORD_BITS - 2 * halo


def core_bits(halo: int) -> Column:
    return F.lit(((1 << core_width(halo)) - 1) << halo).cast("long")


def shift_left(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", value, by if isinstance(by, Column) else F.lit(by))


def shift_right(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", value, by if isinstance(by, Column) else F.lit(by))


def bit_at(value: Column, position: Column) -> Column:
    """Bit ``position`` of ``value`` as 0/1."""
    return shift_right(value, position).bitwiseAND(F.lit(1).cast("long")).cast("int")


def position_of(col: Column, halo: int) -> Column:
    return (F.pmod(col, F.lit(core_width(halo))) + halo).cast("int")


def with_address(df: DataFrame, halo: int) -> DataFrame:
    """Add the ``tile_row`` and ``word`` a pixel belongs to."""
    return df.withColumns(
        {
            "tile_row": floor_div(F.col("row"), TILE_ROWS),
            "word": floor_div(F.col("col"), core_width(halo)),
        }
    )


def pack(df: DataFrame, keys: Sequence[str], flags: dict[str, Column], halo: int) -> DataFrame:
    """Fold pixels into words. Aggregates partially before it shuffles."""
    if "word" not in df.columns:
        df = with_address(df, halo)
    one = shift_left(F.lit(1).cast("long"), position_of(F.col("col"), halo))
    zero = F.lit(0).cast("long")
    folded = [F.bit_or(F.when(flag, one).otherwise(zero)).alias(n) for n, flag in flags.items()]
    return df.groupBy(*keys, *ADDRESS).agg(F.bit_or(one).alias("present"), *folded)


def spread(words: DataFrame, keys: Sequence[str], names: Sequence[str], halo: int) -> DataFrame:
    """Give every word the pixels around it: one exchange, on (keys, tile_row, word)."""
    core = core_width(halo)
    columns = ["present", *names]
    inner_row = F.pmod(F.col("row"), F.lit(TILE_ROWS))
    tile_steps = F.array_compact(
        F.array(
            F.lit(0),
            F.when(inner_row < halo, F.lit(-1)),
            F.when(inner_row >= TILE_ROWS - halo, F.lit(1)),
        )
    )

    def beside(step: int, move) -> Column:
        moved = [move(F.col(c)).alias(c) for c in columns]
        return F.struct((F.col("word") + step).alias("word"), *moved)

    copies = F.array(
        beside(0, lambda c: c),
        beside(1, lambda c: shift_right(c, core)),
        beside(-1, lambda c: shift_left(c, core)),
    )
    return (
        words.select(*keys, "tile_row", "row", F.explode(copies).alias("copy"))
        .where(F.col("copy.present") != 0)
        .select(*keys, F.explode(tile_steps).alias("step"), "tile_row", "row", "copy.*")
        .withColumn("tile_row", F.col("tile_row") + F.col("step"))
        .drop("step")
        .repartition(*keys, "tile_row", "word")
        .groupBy(*keys, *ADDRESS)
        .agg(*[F.bit_or(c).alias(c) for c in columns])
    )


def owned(words: DataFrame, names: Sequence[str], halo: int) -> DataFrame:
    """Drop the halo again: only a word's own pixels remain."""
    core = core_bits(halo)
    return words.where(
        (F.col("tile_row") == floor_div(F.col("row"), TILE_ROWS))
        & (F.col("present").bitwiseAND(core) != 0)
    ).withColumns({c: F.col(c).bitwiseAND(core) for c in ["present", *names]})


def unpack(words: DataFrame, keys: Sequence[str], names: Sequence[str], halo: int) -> DataFrame:
    """One row per existing pixel, flags as 0/1 ints."""
    core = core_width(halo)
    position = F.explode(F.sequence(F.lit(halo), F.lit(halo + core - 1))).alias("position")
    return (
        words.select(*keys, "row", "word", "present", *names, position)
        .where(bit_at(F.col("present"), F.col("position")) == 1)
        .select(
            *keys,
            "row",
            (F.col("word") * core + F.col("position") - halo).cast("long").alias("col"),
            *[bit_at(F.col(n), F.col("position")).alias(n) for n in names],
        )
    )


def attach(
    pixels: DataFrame, words: DataFrame, keys: Sequence[str], names: Sequence[str], halo: int
) -> DataFrame:
    """Look up the flags of pixel rows in packed words; ``names`` become 0/1 int columns."""
    addressed = pixels if "word" in pixels.columns else with_address(pixels, halo)
    on = [*keys, *ADDRESS]
    joined = addressed.join(words.select(*on, *names), on)
    position = position_of(F.col("col"), halo)
    return joined.withColumns({n: bit_at(F.col(n), position) for n in names}).drop("tile_row", "word")
