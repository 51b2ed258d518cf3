"""The registered query of each operator: it reads whole tables and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm import (
    decontaminate,
    exact_dedup,
    extraction,
    filter_audit,
    language,
    licenses,
    packing,
    quality,
    ranked_search,
    secret_scan,
    simhash,
    suffixes,
    url_filter,
)

#: Block (True) and allow (False) rules on host and path.
URL_RULES = {"net/": True, "example.net/en/": False, "example.com/de/": True, "org/fr/": False}
#: First labels of the sites on the block list.
LISTED_NAMES = ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; Python workers that start from now on find this package where the driver does."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    sites = pages.select(F.explode(url_filter.sites_of(url_filter.host_of(F.col("url")))).alias("key"))
    listed = sites.where(F.split_part("key", F.lit("."), F.lit(1)).isin(*LISTED_NAMES)).distinct()
    return url_filter.judge(pages, URL_RULES, listed)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents"))
    base = F.transform("phrases", lambda x: x["label"])
    every = F.concat(base, F.transform("spans", lambda x: x["label"]))
    longest = F.array_max(F.transform("spans", lambda x: x["words"]))
    score = F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.least(F.coalesce(longest / 20.0, F.lit(0.0)), F.lit(1.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(F.transform("phrases", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("phrases", lambda x: x["first"])).alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(every).alias("labels"),
        score.alias("score"),
    )


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id",
        *(count(k) for k in ("assign", "access", "hex")),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def packed_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(packing.pack(table(spark, sf_dir, "documents"), ids=False))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def extraction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicates(table(spark, sf_dir, "documents"))
    stays = exact_dedup.kept(F.col("doc_id"), F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter_query,
    "op2_language": language_query,
    "op3_license_scan": license_query,
    "op4_simhash": simhash_query,
    "op5_quality": quality_query,
    "op6_extraction": extraction_query,
    "op7_suffix_dedup": suffix_query,
    "op8_packing": packing_query,
    "op9_secret_scan": secrets_query,
    "op10_decontaminate": decontaminate_query,
    "op11_filter_audit": audit_query,
    "op12_ranked_search": search_query,
    "op13_exact_dedup": exact_dedup_query,
}
