"""Quality rules in DataFrame functions alone: counts of each text, and an n-gram log-likelihood ratio."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.llm.membership import listed_rows
from terradelta.llm.tables import staged

BUCKETS, MOST_BUCKETS = 1 << 14, 1 << 17  # of hashed n-grams; the most bound every table of weights to a megabyte
CHARS = 512  # characters of the corpus for each bucket, between these bounds
PRIOR = 1000.0  # least n-grams of the raw corpus that the target is smoothed with
RATIO = -0.065  # least mean log ratio of a text that is kept
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated windows

_SYMBOLS = "#*$%&|<>"


def _flat(text: Column) -> Column:
    """The text with every white space character as a space; null is empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", F.coalesce(text, F.lit("")))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null has none."""
    return F.array_remove(F.split(_flat(text), " "), "")  # a plain separator needs no regular expression


def _settled(value: Column) -> Column:
    """``value``, computed before any filter on it.

    The optimizer would copy the steps behind a column into a filter, once for each use of each step; it
    leaves what depends on the row's number in place.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _bucket(x: Column, buckets: int) -> Column:
    return x.bitwiseAND(F.lit(buckets - 1))


def _hashed(docs: DataFrame) -> DataFrame:
    """``docs`` (without text) with the 64-bit hashes of the words, ``_hashes``, and of each word and the next, ``_pairs``.

    The last word is paired with the end of the text. Columns are added step by step, so that each array
    is made once however often it is used.
    """
    listed = docs.withColumn("_words", words_of(F.col("text"))).drop("text")
    hashed = listed.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    following = F.slice("_hashes", 2, F.greatest(F.size("_hashes") - 1, F.lit(0)))
    return hashed.withColumn("_pairs", F.zip_with("_hashes", following, lambda a, b: F.xxhash64(a, b)))


def _repeats(hashed: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words that lie in a window of three words found twice or more in the text.

    A window is the hash of its three words, whose low bits make way for its place; so equal windows are
    neighbours after a sort of plain numbers. Windows are compared by the 64 bits that the sort and the
    hash leave: 64 less the bits of the text's length, 50 and more for texts up to 16,000 words.
    """
    h, size = F.col("_hashes"), F.greatest(F.size("_hashes") - 2, F.lit(0))
    each = F.zip_with(F.slice("_pairs", 1, size), F.slice(h, 3, size), lambda p, c: F.xxhash64(p, c))
    bits = F.length(F.bin(F.size(h).cast("long")))
    windows = hashed.withColumn("_windows", each)
    windows = windows.withColumn("_low", F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    low, none = F.col("_low"), F.array().cast("array<bigint>")
    top = F.bitwise_not(low)
    packed = F.transform("_windows", lambda x, i: x.bitwiseAND(top).bitwiseOR(i.cast("long")))
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")  # else there is nothing to sort
    windows = windows.withColumn("_sorted", F.when(again, F.sort_array(packed)).otherwise(none)).drop("_windows")
    # Neighbours that differ in the low bits alone; both their places count.
    row = F.col("_sorted")
    twins = F.zip_with(
        row,
        F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0))),
        lambda x, y: F.when(x.bitwiseXOR(y).bitwiseAND(top) == 0, F.array(x, y)),
    )
    paired = windows.withColumn("_twins", F.flatten(F.filter(twins, lambda x: x.isNotNull()))).drop("_sorted")
    places = paired.withColumn("_places", F.sort_array(F.array_distinct(F.transform("_twins", lambda x: x.bitwiseAND(low)))))
    at = F.col("_places")
    # A window covers its three words unless the next repeated window begins earlier.
    covered = F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(3)), F.lit(3)))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    return places.withColumn("n_repeat_words", _settled(total)).drop("_twins", "_places", "_low")


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of each whole text (and working columns, whose names begin with _); null has no words.

    n_words; word_chars: code points in words; n_symbols: characters of ``[#*$%&|<>]``; n_dup_lines: lines
    with a word that equal an earlier line; n_repeat_words: words in windows of three found twice or more.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), _SYMBOLS, text)
    counted = docs.withColumn("_lines", lines)
    counted = counted.withColumns({
        "word_chars": F.length(F.replace(_flat(F.col("text")), F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": (F.length(text) - F.length(plain)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    counted = _repeats(_hashed(counted.drop("_lines")))
    return counted.withColumn("n_words", F.size("_hashes").cast("long"))


def buckets_for(docs: DataFrame) -> int:
    """The power of two of buckets that a corpus gets: one for about CHARS characters, within the bounds."""
    chars = docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    return min(MOST_BUCKETS, max(BUCKETS, 1 << max(0, chars // CHARS - 1).bit_length()))


def _counts(docs: DataFrame, buckets: int, name: str) -> DataFrame:
    """``(bucket, name)``: hashed words and word pairs of all texts. Each task sends at most a row for each bucket."""
    grams = _hashed(docs.select("text")).select(F.explode(F.concat("_hashes", "_pairs")).alias("gram"))
    return grams.groupBy(_bucket(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias(name))


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows ``(doc_id, text)`` whose doc_id has a label of quality 1: all of them, and none of the texts moves.

    Ids meet ids; the answer goes out as a cascade of bounded bitmaps that is exact (``membership.listed_rows``).
    """
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id")
    return listed_rows(docs.select("doc_id", "text"), "doc_id", trusted)


def ngram_counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, raw, target)``: hashed words and word pairs of all texts, and of all those that ``labels`` trust.

    The last word is paired with the end of the text.
    """
    raw, target = _counts(docs, buckets, "raw"), _counts(trusted_texts(docs, labels), buckets, "target")
    return raw.join(target, "bucket", "left").select("bucket", "raw", F.coalesce("target", F.lit(0)).alias("target"))


def prior_for(target: int, buckets: int) -> float:
    """N-grams of the raw distribution that smooth a target of ``target`` n-grams.

    It grows with the root of the target's size and of the buckets: a small target has noisy counts and is
    smoothed by more than itself, a large one by a small share, and either can still tell a text from it.
    """
    return max(PRIOR, 2 * math.sqrt(target * buckets))


def ratio_weights(docs: DataFrame, labels: DataFrame, prior: float | None) -> tuple[DataFrame, int]:
    """log P(n-gram | target) - log P(n-gram | raw) for each bucket, as one row of one array of doubles, staged; and the number of buckets.

    Target: the texts with a label of quality 1. Raw: every text. The target is smoothed with ``prior`` n-grams
    of the raw distribution (None: by ``prior_for``), so that what it lacks counts against a text by a bounded amount.
    """
    buckets = buckets_for(docs)
    per_bucket = staged(ngram_counts(docs, labels, buckets), "ngrams")
    total = per_bucket.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("all_raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("all_target"))
    row = total.first()
    prior = prior_for(row["all_target"], buckets) if prior is None else prior
    p_raw = F.col("raw") / F.lit(float(max(1, row["all_raw"])))
    weight = F.ln((F.col("target") + prior * p_raw) / F.lit(row["all_target"] + prior)) - F.ln(p_raw)
    known = per_bucket.where("raw > 0").select("bucket", weight.alias("weight"))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(known, "bucket", "left")
    placed = F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("weight", F.lit(0.0)).alias("weight"))))  # at most MOST_BUCKETS
    return staged(every.agg(F.transform(placed, lambda x: x["weight"]).alias("weights")), "weights"), buckets


def _judged(docs: DataFrame, labels: DataFrame, ratio: float, prior: float | None) -> DataFrame:
    """``docs`` with all counts, ``llr``, ``base_failed`` and ``kept``.

    The weights come in as a subquery: as a literal the driver would write all of them out in each description of
    the plan. They are used in one place, where the optimizer puts the subquery; else each row would get a copy.
    """
    weights, buckets = ratio_weights(docs, labels, prior)
    counted = text_counts(docs).withColumn("_weights", weights.scalar())

    def add(total: Column, gram: Column) -> Column:
        return total + F.get(F.col("_weights"), _bucket(gram, buckets))

    sums = F.transform(F.array("_hashes", "_pairs"), lambda grams: F.aggregate(grams, F.lit(0.0), add))
    summed = counted.withColumn("_total", F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)).drop("_weights")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    scored = summed.withColumn("llr", _settled(F.col("_total") / F.greatest(2 * F.col("n_words"), F.lit(1))))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= ratio))


def judge(docs: DataFrame, labels: DataFrame, ratio: float = RATIO, prior: float | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, the counts, llr, base_failed and kept.

    base_failed: fewer than MIN_WORDS words, or over half of the words repeated. ``llr`` is the mean log
    ratio of the text's n-grams under the target and the raw multinomial (0 without words); a text is kept
    if it didn't fail and has at least ``ratio``. Every text meets the same rule; all statistics cover all
    rows. Without any label of quality 1 all ratios are 0. Labels without doc_id or quality are ignored and
    repeated ones count once; a null text has no words; repeated rows give repeated results.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]
    return _judged(docs.select("doc_id", "text"), labels, ratio, prior).select(*names)


def keep_good(docs: DataFrame, labels: DataFrame, ratio: float = RATIO, prior: float | None = None) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, decided row by row without a join of texts."""
    inner = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return _judged(inner, labels, ratio, prior).where("kept").select("_row.*")
