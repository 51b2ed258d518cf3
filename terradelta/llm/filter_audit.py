"""Audit of interacting filters: what each removes in every order, from additive counts of failure masks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.llm.membership import BITS, has_bit, words_of_bits
from terradelta.llm.tables import slices, staged, utf8

#: The filters, each a bit of a mask in this order; the last, repeated texts, needs the whole table.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10  # words; percent of the words; percent of the code points

_CAPITALS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point


def fails(text: bytes) -> int:
    """The mask of the filters that a text fails by itself. Words are ``[^\\x20\\x09-\\x0D]+``."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        + 2 * (100 * len(set(words)) < MIN_DISTINCT * len(words))
        + 4 * (100 * capitals > MAX_CAPITALS * len(text.translate(None, _FOLLOWING)))
        + 8 * (len(text.translate(None, _MARKS)) < len(text))
    )


def possible_repeats(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` (with a column ``text``, no nulls) with ``hash`` and ``name``: false for texts that surely stand alone.

    A counting Bloom filter of two counters a text: each task counts its own texts, the sketches are added up,
    and a text whose counters are not both 2 or more is unique. The counters that are go out as a bitmap of
    bounded size (see ``membership.BITS``); a corpus with more texts than bits has more rows that may repeat.
    """
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    slots = [F.pmod(F.col("hash"), F.lit(BITS)), F.pmod(F.xxhash64(F.lit(1), F.col("hash")), F.lit(BITS))]
    sketch = hashed.select(F.explode(F.array(*slots)).alias("spot")).groupBy("spot").agg(F.count("*").alias("n"))
    counters = words_of_bits(sketch.where("n > 1").select("spot"), "counters")
    for number, slot in enumerate(slots):
        hashed = has_bit(hashed, slot, counters, f"{name}_{number}")
    return hashed.withColumn(name, F.col(f"{name}_0") & F.col(f"{name}_1")).drop(f"{name}_0", f"{name}_1")


def masks(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, mask)`` per row of ``docs``: its lang (null: empty) and the filters that it fails, a bit each.

    A to D look at the text: under 100 words; under 80 % distinct words; over 10 % capitals; a character of
    ``[#$%&*|]``. E: the text is that of a smaller doc_id. A null text is empty. Rows without doc_id neither fail
    E nor make others fail; repeated rows are no smaller than each other; rows of one doc_id are told apart by a
    64-bit hash of the text.
    """
    slim = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    sketched = possible_repeats(slim, "again")
    # Only texts that may repeat move; copies in one task are one row before the shuffle.
    repeated = sketched.where("again AND doc_id IS NOT NULL")
    first = staged(repeated.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.first("hash").alias("hash")).select("doc_id", "hash"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches):
            found = pa.array(map(fails, utf8(block.column("text"))), pa.int32())
            yield pa.RecordBatch.from_arrays([*(block.column(n) for n in names), found], [*names, "mask"])

    names = ["doc_id", "part", "hash", "again"]
    judged = sketched.select(*names, "text").mapInArrow(run, "doc_id long, part string, hash long, again boolean, mask int")
    met = judged.join(first.withColumn("first", F.lit(True)).distinct(), ["doc_id", "hash"], "left")
    fifth = F.when(F.col("again") & F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return met.select("doc_id", "part", (F.col("mask") + fifth).alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each part and mask, and those labelled quality 1 and toxic 1.

    Counts of disjoint sets: counts of any union of documents add up. Of repeated labels any one counts; labels
    without doc_id, and nulls in them, don't.
    """
    per_id = labels.groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    known = masks(docs).join(per_id.where("doc_id IS NOT NULL"), "doc_id", "left")
    return known.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def _steps() -> str:
    """Every step of every order: its filter's bit and the bits before it."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            rows.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return json.dumps(rows)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Everything is summed from the counts of ``mask_counts``, at most 32 rows a part, so texts are read for no
    order again. ``shapley`` is the number of documents that the step's filter removes, over all 120 orders: a
    document that fails k filters is removed by each of them in 120 / k orders. Each part has all 600 rows, zeros
    included; an empty table has no part.
    """
    counted = staged(mask_counts(docs, labels), "masks")
    kind = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    steps = counted.select("*", F.explode(F.from_json(F.lit(_steps()), kind)).alias("at")).select("*", "at.*")
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    here, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(value: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.expr(value))), F.lit(0)).cast("long")

    return steps.groupBy("part", "filter_order", "step").agg(
        total("n", ~here & ~earlier).alias("kept"),
        total("n", here & ~earlier).alias("removed"),
        total("n", here & earlier).alias("redundant"),
        total("n", mask == bit).alias("unique_fails"),
        total("good", here & ~earlier).alias("good_lost"),
        total("toxic", here & ~earlier).alias("toxic_lost"),
        total("n * (120 div bit_count(mask))", here).alias("shapley"),
    )
