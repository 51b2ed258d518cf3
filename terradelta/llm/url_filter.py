"""URL filters: rules on host and path, and a Bloom filter cascade that answers exactly for listed sites."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.llm.tables import slices, staged

#: Listed keys in one cascade, whose levels then take about 2 bytes each. A longer list is cut into several
#: cascades by a hash of the key; each is one pass.
MAX_KEYS = 50_000_000
FIRST_RATE, NEXT_RATE = 1 / 64, 1 / 2  # false positives that the first level and the later ones let through

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: dict[str, bool]) -> Column:
    """The longest rule ``site/path`` that fits, or null. Equal lengths: the first of ``rules``.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    fits = []
    for rule in sorted(rules, key=lambda r: -len(r)):
        site, tail = rule.split("/", 1)
        fits.append(F.when(((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{tail}"), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def sites_of(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


class Level:
    """One Bloom filter: ``bits`` as little-endian 64-bit words, ``n_hashes`` places for each key."""

    def __init__(self, number: int, n_keys: int, rate: float) -> None:
        self.number, self.n_hashes = number, max(1, round(log(1 / rate, 2)))
        self.n_bits = 64 * ceil(max(1, n_keys) * log(1 / rate) / log(2) ** 2 / 64)
        self.words = np.zeros(0, np.uint64)

    def places(self, keys: list[bytes]) -> np.ndarray:
        """Bit numbers of each key, by double hashing with hashes of this level alone."""
        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k, self.number) for k in keys), "<u8").reshape(-1, 2)
        steps = np.arange(self.n_hashes, dtype=np.uint64)
        return (both[:, :1] + steps * (both[:, 1:] | np.uint64(1))) % np.uint64(self.n_bits)

    def holds(self, keys: list[bytes]) -> np.ndarray:
        at = self.places(keys)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1)


def _fill(level: Level, keys: DataFrame) -> None:
    """Set the bits of the keys. Words are united by a grouped aggregation; only the filter itself is fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8192):
            at = level.places([k.encode() for k in part.column(0).to_pylist()]).ravel()
            word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    level.words = np.zeros(level.n_bits // 64, np.uint64)
    masks = keys.select("key").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    for batch in masks.toArrow().to_batches():
        level.words[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8192):
            held = sent.value.holds([k.encode() for k in part.column(0).to_pylist()])
            yield part.filter(pa.array(held))

    return keys.mapInArrow(run, "key string, listed boolean")


class Cascade:
    """Alternate Bloom filters: level 1 holds the listed keys, level 2 what level 1 wrongly lets through of the
    universe, level 3 the listed keys that level 2 lets through, and so on until nothing is wrong.

    For keys of the universe the answer is exact.
    """

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def listed(self, keys: list[bytes]) -> np.ndarray:
        """Whether each key is listed: the parity of the first level that does not hold it."""
        depth, left = np.full(len(keys), len(self.levels)), np.arange(len(keys))
        for d, level in enumerate(self.levels):
            held = level.holds([keys[i] for i in left])
            depth[left[~held]] = d
            left = left[held]
            if not len(left):
                break
        return depth % 2 == 1


def build(keys: DataFrame) -> Cascade:
    """The cascade of ``(key, listed)``: the complete universe, each key once.

    Each level is one distributed pass over the keys that still matter, a share that falls with every level.
    """
    levels: list[Level] = []
    for number in range(1, 65):
        counts = keys.groupBy("listed").count().collect()  # two rows
        inside = number % 2 == 1
        n = {r["listed"]: r["count"] for r in counts}.get(inside, 0)
        if not n:
            return Cascade(levels)
        level = Level(number, n, FIRST_RATE if number == 1 else NEXT_RATE)
        _fill(level, keys.where(F.col("listed") == inside))
        levels.append(level)
        # the keys of this level stay for the next, those of the other side only if they pass
        other = _passing(keys.where(F.col("listed") != inside), level)
        keys = staged(keys.where(F.col("listed") == inside).unionByName(other), "cascade")
    raise ValueError("keys share all hashes; is the universe free of repeated keys?")


def judge(pages: DataFrame, rules: dict[str, bool], listed: DataFrame, max_keys: int = MAX_KEYS) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, site.

    ``rules`` maps ``site/path`` to block (True) or allow (False); the longest that fits decides. Otherwise a
    page is blocked if its host or a domain above it is in ``listed`` (column ``key``), else allowed;
    ``site`` is the longest listed domain (null if none). Rows are never joined or shuffled: the list is
    encoded exactly over all domains of ``pages``. A null url or one without ``://`` has empty host and path
    and is allowed; repeated rows give repeated results; null and repeated listed keys don't matter; with an
    empty list or table nothing is listed.
    """
    url = F.col("url")
    out = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = out.select("host").distinct()
    universe = hosts.select(F.explode(sites_of(F.col("host"))).alias("key")).where("key <> ''").distinct()
    marked = universe.join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left")
    keys = staged(marked.select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    parts = max(1, ceil(keys.where("listed").count() / max_keys))
    part_of = F.pmod(F.xxhash64("key"), F.lit(parts))
    out = out.withColumn("site", F.lit(None).cast("string"))
    for part in range(parts):
        sent = pages.sparkSession.sparkContext.broadcast(build(keys.where(part_of == part)))
        out = out.withColumn("sites", F.filter(sites_of(F.col("host")), lambda k: (k != "") & (F.pmod(F.xxhash64(k), F.lit(parts)) == part)))
        out = _sites(out, sent)
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    verdict = reduce(
        lambda rest, r: F.when(F.col("rule") == r, F.lit("block" if rules[r] else "allow")).otherwise(rest),
        rules,
        F.when(F.col("site").isNotNull(), F.lit("block")).otherwise(F.lit("allow")),
    )
    return out.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "site")


def _sites(pages: DataFrame, sent) -> DataFrame:
    """Fill ``site`` with the longest of ``sites`` that the cascade lists; the longest of several passes stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for part in slices(batches, 4096):
            columns = dict(zip(part.schema.names, part.columns))
            sites = columns.pop("sites").to_pylist()
            new = list({s for row in sites for s in row}.difference(known))
            if len(known) > 100_000:
                known.clear()
                new = list({s for row in sites for s in row})
            known.update(zip(new, sent.value.listed([s.encode() for s in new])))
            best = [max([s for s in row if known[s]] + ([old] if old else []), key=len, default=None) for row, old in zip(sites, columns["site"].to_pylist())]
            columns["site"] = pa.array(best, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return pages.mapInArrow(run, "page_id long, host string, path string, site string")
