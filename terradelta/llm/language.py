"""Language identification: text likelihood, declared language, address and host, fused by Bayes' rule."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.llm.tables import slices, staged, utf8
from terradelta.llm.url_filter import host_of, path_of

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 14  # of hashed letter triples
CHUNK = 1 << 16  # bytes of a text whose triples are counted at a time
EVIDENCE = 60.0  # letter triples that a text counts as at most; neighbouring ones are far from independent
PRIOR = 4.0  # items that a level of the host hierarchy is smoothed with
_DROP = re.compile(rb"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)|&\w*;?")
#: Letters in lower case (bytes above 127 stay); all other bytes are spaces.
_LETTERS = bytes(c if c >= 128 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def triples(text: bytes) -> np.ndarray:
    """How often each bucket of letter triples occurs in a text; triples across words hold one space."""
    counts = np.zeros(BUCKETS, np.int64)
    plain = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    for at in range(0, max(0, len(plain) - 2), CHUNK):
        x = np.frombuffer(plain[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)
        counts += np.bincount(code >> np.uint32(18), minlength=BUCKETS)
    return counts


def markup_text(page: bytes) -> bytes:
    """The bytes of a page outside tags, scripts and styles."""
    return _DROP.sub(b" ", page)


def train(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """log P(bucket | language) from all rows of ``(text, lang)``; other languages and nulls are ignored.

    Each task sends one row for each language and bucket that it met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), BUCKETS), np.int64)
        for part in slices(batches):
            for text, lang in zip(utf8(part.column(0)), part.column(1).to_pylist()):
                if lang in languages:
                    sums[languages.index(lang)] += triples(text)
        k, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(bucket), pa.array(sums[k, bucket])], ["k", "bucket", "n"])

    counts = np.ones((len(languages), BUCKETS))
    rows = labelled.select("text", "lang").mapInArrow(run, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    for batch in rows.toArrow().to_batches():  # at most len(languages) * BUCKETS rows
        k, bucket, n = (c.to_numpy() for c in batch.columns)
        counts[k, bucket] += n
    return np.log(counts / counts.sum(1, keepdims=True))


def likelihoods(items: DataFrame, model: np.ndarray, markup: bool, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``items`` with ``loglik``, the tempered log-likelihood of ``text`` for each language, in place of the text."""
    sent = items.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in items.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            columns = dict(zip(part.schema.names, part.columns))
            texts = utf8(columns.pop("text"))
            out = []
            for text in texts:
                counts = triples(markup_text(text) if markup else text)
                n = counts.sum()
                at = np.flatnonzero(counts)
                out.append((sent.value[:, at] @ counts[at] * (min(n, EVIDENCE) / max(n, 1))).tolist())
            columns["loglik"] = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return items.mapInArrow(run, f"{schema}, loglik array<double>")


def declared_in(page: Column) -> Column:
    """The language that the html element declares, without region; null if none."""
    found = F.regexp_extract(page, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", 1)
    return F.nullif(F.lower(found), F.lit(""))


def address_mark(url: Column) -> Column:
    """What an address says of the language: its first path step if it has two letters, else its last domain label."""
    step = F.regexp_extract(path_of(url), r"^/([A-Za-z]{2})(?:/|$)", 1)
    top = F.element_at(F.split(host_of(url), r"\."), -1)
    return F.nullif(F.lower(F.when(step != "", step).otherwise(top)), F.lit(""))


def _best(scores: Column, languages: tuple[str, ...]) -> Column:
    """The language with the largest score, the first of equals."""
    return F.element_at(F.array(*map(F.lit, languages)), F.array_position(scores, F.array_max(scores)).cast("int"))


def _counts(languages: tuple[str, ...]) -> list[Column]:
    return [F.sum((F.col("by_text") == x).cast("long")).alias(f"n_{x}") for x in languages]


def _smoothed(languages: tuple[str, ...], above: Column) -> Column:
    """Shares of the languages in n_*, smoothed with PRIOR items of the shares ``above``."""
    total = sum((F.coalesce(f"n_{x}", F.lit(0)) for x in languages), F.lit(0)) + PRIOR
    return F.array(*((F.coalesce(f"n_{x}", F.lit(0)) + PRIOR * F.get(above, F.lit(i))) / total for i, x in enumerate(languages)))


def _reliability(items: DataFrame, column: str, languages: tuple[str, ...]) -> dict[str, list[float]]:
    """log P(mark | language), up to a constant, for each mark that names a language; counted over all items."""
    rows = items.where(F.col(column).isin(*languages)).groupBy(column).agg(*_counts(languages)).collect()
    table = np.ones((len(languages), len(languages)))  # marks by languages
    for r in rows:
        table[languages.index(r[column])] += [r[f"n_{x}"] for x in languages]
    return {x: np.log(table[i] / table.sum(0)).tolist() for i, x in enumerate(languages)}


def _mark_evidence(column: str, table: dict[str, list[float]], languages: tuple[str, ...]) -> Column:
    out = F.array(*(F.lit(0.0) for _ in languages))
    for mark, row in table.items():
        out = F.when(F.col(column) == mark, F.array(*map(F.lit, row))).otherwise(out)
    return out


def fuse(items: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``items`` with language, confidence and by_text (the language of the text alone).

    ``items`` has loglik, declared, address and host; null or unknown marks say nothing. The posterior is the
    text likelihood times P(declared | language) times P(address | language) times the host prior. The
    shares of a host are smoothed with those of its domain, these with those of all items; every share and
    reliability is counted over all items by what their texts say.
    """
    domain = F.substring_index("host", ".", -2)
    seen = items.withColumn("by_text", _best(F.col("loglik"), languages)).withColumn("domain", domain)
    seen = staged(seen, "language")
    everywhere = seen.agg(*_counts(languages)).first()
    flat = [(everywhere[f"n_{x}"] or 0) + 1.0 for x in languages]
    overall = F.array(*(F.lit(n / sum(flat)) for n in flat))
    domains = seen.groupBy("domain").agg(*_counts(languages)).select("domain", _smoothed(languages, overall).alias("above"))
    hosts = seen.groupBy("host", "domain").agg(*_counts(languages)).join(staged(domains, "domains"), "domain", "left")
    hosts = staged(hosts.select("host", _smoothed(languages, F.coalesce("above", overall)).alias("shares")), "hosts")
    declared, address = (_reliability(seen, c, languages) for c in ("declared", "address"))
    joined = seen.join(hosts, "host", "left")
    prior = F.transform(F.coalesce("shares", overall), lambda x: F.log(x))
    parts = [F.col("loglik"), _mark_evidence("declared", declared, languages), _mark_evidence("address", address, languages), prior]
    scores = F.array(*(sum((F.get(p, F.lit(i)) for p in parts[1:]), F.get(parts[0], F.lit(i))) for i in range(len(languages))))
    scored = joined.withColumn("scores", scores)
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("scores")))
    return scored.withColumn("language", _best(F.col("scores"), languages)).withColumn("confidence", 1.0 / total)


def identify(docs: DataFrame, pages: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Per row of ``docs`` and of ``pages``: doc_id or page_id, language, confidence, by_text, declared, address, host.

    The text model is counted over all ``docs`` with a known ``lang``. A document's host is its source; it
    declares nothing and has no address. A null or empty text says nothing, so host and marks decide; a null
    host is the empty host. Repeated rows give repeated results, empty tables empty ones.
    """
    model = train(docs, languages)
    none = F.lit(None)
    of_docs = docs.select(
        F.col("doc_id").cast("long"), none.cast("long").alias("page_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        none.cast("string").alias("declared"), none.cast("string").alias("address"), "text",
    )
    of_pages = pages.select(
        none.cast("long").alias("doc_id"), F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"),
        declared_in(F.col("html")).alias("declared"), address_mark(F.col("url")).alias("address"), F.col("html").alias("text"),
    )
    items = likelihoods(of_docs, model, False, languages).unionByName(likelihoods(of_pages, model, True, languages))
    return fuse(items, languages).select("doc_id", "page_id", "language", "confidence", "by_text", "declared", "address", "host")
