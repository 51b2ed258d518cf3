"""Exact membership of rows in a large set of keys, without moving the rows: cascades of bitmaps in DataFrame functions."""

from __future__ import annotations

from collections.abc import Iterable
from math import ceil, sqrt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.llm.tables import staged

#: Bits of a bitmap. Only words with a bit set are kept, so it has at most one row for each key, and 2 ** 20 rows
#: (about 50 MB as a broadcast) however many keys there are.
BITS = 1 << 26
#: Keys in one cascade of bitmaps; a longer list is cut into several by a hash of the key, each one pass over the rows.
MAX_KEYS = 1 << 23
MAX_PASSES = 16  # from here on it is cheaper to move each row once than to read it so many times


class Marks(NamedTuple):
    """A bitmap of hashed keys: ``words`` are ``(place, bits)``; ``salt`` makes its hash its own."""

    words: DataFrame
    salt: int


def fresh(names: Iterable[str], name: str) -> str:
    """``name`` with as many underscores before it as make it new among ``names``."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def settled(value: Column) -> Column:
    """``value``, computed where it stands.

    The optimizer copies the steps behind a column into filters, and moves semi joins below them; what depends
    on the row's number stays in place.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def spot(keys: list[Column], salt: int) -> Column:
    """The bit of a key among BITS."""
    return F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(BITS))


def words_of_bits(spots: DataFrame, name: str) -> DataFrame:
    """The words ``(place, bits)`` of the bit numbers ``spot``, united by a grouped aggregation and staged."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("spot").bitwiseAND(F.lit(63)).cast("int"))
    placed = spots.select(F.shiftright("spot", 6).alias("place"), bit.alias("bit"))
    return staged(placed.groupBy("place").agg(F.bit_or("bit").alias("bits")), name)


def marks(keys: DataFrame, salt: int = 1) -> Marks:
    """The bitmap of all columns of ``keys`` together."""
    return Marks(words_of_bits(keys.select(spot([keys[c] for c in keys.columns], salt).alias("spot")), "marks"), salt)


def has_bit(df: DataFrame, at: Column, words: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean column ``name``: whether bit ``at`` is set in ``words``. Rows stay where they are."""
    held, place, bits = (fresh([*df.columns, name], n) for n in ("_spot", "_place", "_bits"))
    small = words.select(F.col("place").alias(place), F.col("bits").alias(bits))
    placed = df.withColumn(held, at).withColumn(place, F.shiftright(held, 6))
    mine = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(held).bitwiseAND(F.lit(63)).cast("int"))
    found = placed.join(F.broadcast(small), place, "left")  # at most 2 ** 20 rows, see BITS
    return found.withColumn(name, settled(F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(mine) != 0)).drop(held, place, bits)


def flagged(df: DataFrame, keys: list[Column], known: Marks, name: str) -> DataFrame:
    """``df`` with ``name``: false if the key is surely not among those of the bitmap."""
    return has_bit(df, spot(keys, known.salt), known.words, name)


def likely(df: DataFrame, keys: list[Column], known: Marks) -> DataFrame:
    """The rows whose key may be among those of the bitmap, all that are and few others while there are fewer keys than bits."""
    name = fresh(df.columns, "_likely")
    return flagged(df, keys, known, name).where(name).drop(name)


def _cascade(keys: DataFrame) -> list[Marks]:
    """Bitmaps of ``(key, listed)``, each key once: the first marks the listed keys, the second the others that
    it lets through, the third the listed ones that the second lets through, until nothing is wrong."""
    levels: list[Marks] = []
    for number in range(1, 65):
        mine = keys.where(F.col("listed") == (number % 2 == 1))
        if mine.isEmpty():
            return levels
        levels.append(marks(mine.select("key"), number))
        other = likely(keys.where(F.col("listed") != (number % 2 == 1)), [F.col("key")], levels[-1])
        keys = staged(mine.unionByName(other), "cascade")
    raise ValueError("keys share all hashes; is any of them repeated?")


def listed_rows(df: DataFrame, key: str, listed: DataFrame, max_keys: int = MAX_KEYS) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``listed`` (one column): a semi join that shuffles keys, never rows.

    All keys of ``df`` meet the listed ones once, without the rows; the answer is encoded in a cascade of
    broadcast bitmaps that is exact for these keys. Lists too long for MAX_PASSES cascades take a plain semi join,
    with the same rows. Null keys are not listed; repeated listed keys count once.
    """
    wanted = listed.select(F.col(listed.columns[0]).alias("key")).distinct().withColumn("listed", F.lit(True))
    universe = df.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().join(wanted, "key", "left")
    keys = staged(universe.select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    size = keys.agg(F.count("*").alias("all"), F.count_if("listed").alias("listed")).first()
    # The second bitmap holds what the first lets through by chance: a share listed / BITS of the other keys.
    parts = max(1, -(-size["listed"] // max_keys), ceil(sqrt(size["listed"] * size["all"] / (BITS * max_keys))))
    if parts > MAX_PASSES:
        return df.join(keys.where("listed").select(F.col("key").alias(key)), key, "left_semi").select(df.columns)
    part_of = lambda k: F.pmod(F.xxhash64(F.lit("part"), k), F.lit(parts))
    out = []
    for part in range(parts):
        rows = df.where(F.col(key).isNotNull() & (part_of(F.col(key)) == part))
        names, levels = [], _cascade(keys.where(part_of(F.col("key")) == part))
        for level in levels:
            names.append(fresh(rows.columns, f"_level_{len(names)}"))
            rows = flagged(rows, [F.col(key)], level, names[-1])
        verdict = F.lit(len(levels) % 2 == 1)
        for number, name in reversed(list(enumerate(names))):
            verdict = F.when(F.col(name), verdict).otherwise(F.lit(number % 2 == 1))
        out.append(rows.where(verdict).drop(*names))
    found = out[0]
    for rows in out[1:]:
        found = found.unionByName(rows)
    return found


def one_of_repeated(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row for each value of ``key`` (null: all rows). Only rows whose key is repeated are shuffled."""
    again = staged(df.select(key).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "again")
    if again.isEmpty():
        return df
    known, name = marks(again), fresh(df.columns, "_again")
    split = flagged(df, [F.col(key)], known, name)
    rows = split.where(F.col(name) & F.col(key).isNotNull()).drop(name).dropDuplicates([key])
    return split.where(~F.col(name) | F.col(key).isNull()).drop(name).unionByName(rows)
