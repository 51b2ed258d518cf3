"""Benchmark decontamination: an Aho-Corasick automaton over item windows scans each text once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terradelta.llm.membership import fresh
from terradelta.llm.tables import slices, utf8
from terradelta.llm.words import terms

WINDOW = 13
#: Item words in one automaton, about 100 bytes each. A larger benchmark is scanned in several passes.
MAX_WORDS = 2_000_000


class Automaton:
    """Aho-Corasick automaton whose letters are words and whose patterns are the windows of the items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in terms(text))
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(ids[at : at + window], set()).add(item_id)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, who in owners.items():
            self.trie.add_word(pattern, (len(pattern), tuple(sorted(who))))
        if owners:
            self.trie.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges ``(first, last)``, both inclusive, inside occurrences; ids of the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if self.empty or not words:
            return spans, found
        known = self.vocabulary.get
        for last, (size, who) in self.trie.iter(tuple([known(w, 0) for w in words])):
            found.update(who)
            first = last - size + 1
            while spans and spans[-1][1] >= first - 1:
                first = min(first, spans.pop()[0])
            spans.append((first, last))
        return spans, found


def _chunks(benchmark: DataFrame, max_words: int) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """Items as (id, text), in groups of at most ``max_words`` words (or one item), and whether a group is the last; one at a time is held."""
    sized = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // (2 * max_words)))  # a word and its separator take two characters at least
    for part in range(parts):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toLocalIterator()
        yield [(r["item_id"], r["text"].encode()) for r in rows], part == parts - 1


Finish = Callable[[pa.RecordBatch, list[list[tuple[int, int]]], list[list[str]]], pa.RecordBatch]


def _hits(frame: DataFrame, benchmark: DataFrame, window: int, max_words: int, finish: Finish, schema: StructType | str) -> DataFrame:
    """What ``finish`` makes of the rows of ``frame``, the merged hit word ranges of their ``text`` and the items that hit.

    It runs inside the last pass: each pass of a stage holds a Python worker of its own.
    """
    hit_spans, hit_items = (fresh(frame.columns, n) for n in ("hit_spans", "hit_items"))
    found = frame.withColumns({
        hit_spans: F.lit(None).cast("array<struct<first:long,last:long>>"),
        hit_items: F.lit(None).cast("array<string>"),
    })
    for items, last in _chunks(benchmark, max_words):
        sent = frame.sparkSession.sparkContext.broadcast(items)

        def one_pass(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(sent.value, window)
            for part in slices(batches):
                columns = dict(zip(part.schema.names, part.columns))
                spans, names = [], []
                for text, old, who in zip(utf8(columns["text"]), columns[hit_spans].to_pylist(), columns[hit_items].to_pylist()):
                    new, items = automaton.scan(terms(text))
                    spans.append(united([(s["first"], s["last"]) for s in old or ()] + new))
                    names.append(sorted(items.union(who or ())))
                if last:
                    yield finish(part, spans, names)
                    continue
                columns[hit_spans] = pa.array([[{"first": a, "last": b} for a, b in x] for x in spans], columns[hit_spans].type)
                columns[hit_items] = pa.array(names, columns[hit_items].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), part.schema.names)

        found = found.mapInArrow(one_pass, schema if last else found.schema)
    return found


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """Per row of ``docs`` where the windows of benchmark items occur in its text, in words and in code points.

    Texts are normalised to words (A-Z lower-cased, see ``words.terms``). A window is ``window`` consecutive
    words of an item; an item with fewer, but not none, is one window. Returns doc_id, n_words, n_hit (words
    inside any occurrence), items (ids of the items that occur, as sorted strings), and spans: the merged hit
    ranges as first and last word (inclusive) and as start and end code point of the original text.

    The benchmark is a curated set, sent to the executors in groups of bounded size; each group is one
    pass over the texts, whose hits are united. Null texts have no words, an empty benchmark hits nothing,
    repeated items count once, a null item_id counts as the empty string, and repeated rows give repeated
    results.
    """

    def located(part: pa.RecordBatch, found: list[list[tuple[int, int]]], items: list[list[str]]) -> pa.RecordBatch:
        counts, hits, spans = [], [], []
        for text, merged in zip(utf8(part.column(1)), found):
            counts.append(len(terms(text)))
            hits.append(sum(b - a + 1 for a, b in merged))
            spans.append(offsets(text, merged))
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _PLACES)],
            ["doc_id", "n_words", "n_hit", "items", "spans"],
        )

    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long,start:long,end:long>>"
    return _hits(docs.select("doc_id", "text"), benchmark, window, max_words, located, schema)


_PLACES = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")]))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, merged inclusive ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(text: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges with their code points in the original text (end exclusive)."""
    if not spans:
        return []
    wanted = {w for pair in spans for w in pair}
    lowered, at, place = text.lower(), 0, {}
    chars = done = 0
    for i, word in enumerate(terms(text)):
        begin = lowered.index(word, at)  # nothing but separators lies before it, so the first find is the word
        at = begin + len(word)
        if i in wanted:
            chars += len(text[done:begin].decode())
            size = len(word.decode())
            place[i] = (chars, chars + size)
            chars, done = chars + size, at
    return [{"first": a, "last": b, "start": place[a][0], "end": place[b][1]} for a, b in spans]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """``scan`` with ``contaminated``: some word is hit, and at least ``percent`` in a hundred are."""
    hit = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return scan(docs, benchmark, window).withColumn("contaminated", hit)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """The rows of ``docs`` that are not contaminated.

    Decided while scanning, row by row: texts are neither shuffled nor joined, and repeated or null ids
    need no rule. Columns of any name pass through; null texts and an empty benchmark are not contaminated.
    """

    names = docs.columns

    def kept(part: pa.RecordBatch, found: list[list[tuple[int, int]]], items: list[list[str]]) -> pa.RecordBatch:
        keep = []
        for text, merged in zip(utf8(part.column("text")), found):
            hit = sum(b - a + 1 for a, b in merged)
            keep.append(not (hit and 100 * hit >= percent * len(terms(text))))
        return part.filter(pa.array(keep, pa.bool_())).select(names)

    return _hits(docs, benchmark, window, MAX_WORDS, kept, docs.schema)
