"""Exact duplicates by most-significant-digit radix partitioning: groups are split by successive bytes until they end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.llm.membership import flagged, listed_rows, marks, one_of_repeated
from terradelta.llm.tables import staged

#: Bytes of the first digit, and how many times as many each later one has.
FIRST, GROWTH = 64, 64


def _split(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The parts of two and more rows that ``keys`` split the rows into: their size, largest doc_id and a label of their own."""
    parts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where("n > 1")
    return staged(parts.withColumn("part", F.monotonically_increasing_id()), name)  # labels are fixed once written


def _finished(rows: DataFrame) -> DataFrame:
    """Rows alone in their part are their own group; the others have the part's size and largest doc_id."""
    alone = F.col("n").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def duplicates(docs: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, text_sha256.

    Texts are equal when their UTF-8 bytes are; a null text is empty. keep_id is the largest doc_id of the rows
    with that text, and group_size their number, repeated rows included. Rows without doc_id are counted, but
    name a group only if no other row of it has a doc_id (keep_id is null then). Repeated rows give repeated
    results; an empty table gives an empty one.

    A text's key is its length, as the leading digit, and then its bytes. The first digit, length and ``first``
    bytes, is counted where the texts lie, and texts that share it with no other never move. The others are
    dealt out by digit after digit, each ``growth`` times as long as the one before; a part of one row is done,
    a part whose bytes have ended is a group of equal texts. No digest decides, and the bytes of a group are
    counted before the shuffle, so that a group of any size travels once for each task that holds some of it.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", body.alias("rest")).withColumn("size", F.length("rest"))
    rows = rows.withColumn("digit", F.substring("rest", 1, first))
    sha = F.unhex(F.sha2("rest", 256)).alias("sha")
    parts = _split(rows, ["size", "digit"], "parts")
    split = flagged(rows, [F.col("size"), F.col("digit")], marks(parts.select("size", "digit")), "shared")
    done = [_finished(split.where("NOT shared").select("doc_id", sha, F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("keep")))]
    width = first
    left = split.where("shared").join(parts, ["size", "digit"], "left")
    while True:
        ended = F.col("part").isNull() | (F.length("rest") <= width)
        rest = F.when(~ended, F.substring(F.col("rest"), F.lit(width + 1), F.length("rest")))
        dealt = staged(left.select("doc_id", sha if len(done) == 1 else "sha", "n", "keep", "part", rest.alias("rest")), "dealt")
        done.append(_finished(dealt.where("rest IS NULL")))
        live = dealt.where("rest IS NOT NULL").select("doc_id", "sha", F.col("part").alias("group"), "rest")
        if live.isEmpty():
            return reduce(DataFrame.unionByName, done)
        width *= growth
        live = live.withColumn("digit", F.substring("rest", 1, width))
        parts = _split(live, ["group", "digit"], "parts")
        left = live.join(parts, ["group", "digit"], "left")


def kept(doc_id: Column, keep_id: Column) -> Column:
    """Whether a row stays: it has the largest doc_id of its group."""
    return doc_id.eqNullSafe(keep_id)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the largest doc_id.

    Of repeated rows (doc_id and text) one stays; texts of rows without doc_id stay if no row with a doc_id has them.
    """
    found = duplicates(docs.select("doc_id", "text"))
    stay = found.where(kept(F.col("doc_id"), F.col("keep_id"))).select(_row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.coalesce("row.text", F.lit("")).cast("binary")
    keyed = rows.withColumn("key", _row_key(F.col("row.doc_id"), F.sha2(text, 256)))
    return one_of_repeated(listed_rows(keyed, "key", stay), "key").select("row.*")


def _row_key(doc_id: Column, sha: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), sha)
