"""Mixture-controlled packing: deficit round-robin over source queues, laid into full token sequences."""

from __future__ import annotations

import base64
import json
import math
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terradelta.llm.tables import slices, staged

SEQUENCE = 1024  # tokens
ROUND = 64 * SEQUENCE  # tokens of a window in which every source has its share
CACHED = 400_000  # words whose ids a worker remembers
END = 0  # the id that ends a document
MAX_MIX = 10_000  # queues with a target of their own
LAST = 1e-9  # share of queues that are to come after all others
_BLOCK = 4096  # rounds whose totals are summed up together

# What a task yields for a packet: its place in the task's queue, its place in the document, its ids. All ids
# of a vocabulary below 65,536 fit into two bytes, which halves what is stored and shuffled.
_PACKETS = (
    "part int, doc_id long, queue string, before long, start long, length long, doc_tokens long, ids binary"
)


class Encoder:
    """Token ids of ``tokenizers`` as little-endian unsigned 32-bit bytes.

    A single space before a character that is no white space always begins a token, so a text is cut there
    and each part is looked up or encoded once. Parts of plain Latin text take the faster library that
    holds the same vocabulary; all others, and texts with runs of spaces, take ``tokenizers``.
    """

    def __init__(self, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> None:
        self.exact = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.added = tuple(t.content for t in self.exact.get_added_tokens_decoder().values())
        with open(public_tokenizers.path(ranks), "rb") as lines:  # a file of the installed module
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        if self.exact.get_vocab_size() > 1 << 16:
            raise ValueError("ids are stored in two bytes")
        self.known = _Known(self.exact, self.fast)

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text:
            return self.known.ids(text)
        first, *rest = text.split(" ")
        if len(self.known) > CACHED:
            self.known.clear()
        return self.known.ids(first) + b"".join(map(self.known.__getitem__, rest))


class _Known(dict):
    """Ids of words that follow a space. Knows nothing of its encoder, so that both go as soon as they are dropped."""

    def __init__(self, exact: Tokenizer, fast: tiktoken.Encoding) -> None:
        super().__init__()
        self.exact, self.fast = exact, fast

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        plain = text.isascii() or max(text) < "ɐ"
        found = self.fast.encode_ordinary(text) if plain else self.exact.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.ids(" " + word)
        return found


@cache
def _encoder() -> Encoder:
    """The encoder of a Python worker, whose tasks share it and the words that it remembers."""
    return Encoder()


def packets(docs: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """The documents' tokens, each ended by END, in packets of at most ``sequence`` tokens, in reading order.

    ``part`` is the task that made a packet and ``before`` the tokens of the same queue that the task met
    before it: with the totals of the tasks these give every packet its place in its queue.
    """
    queue = F.coalesce(F.col("source").cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(), TaskContext.get().partitionId()
        sent: dict[str, int] = {}
        end = np.array([END], "<u4").tobytes()
        for block in slices(batches, 64):
            rows = _rows(encoder, end, part, sent, sequence, *(c.to_pylist() for c in block.columns))
            while some := list(islice(rows, 512)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _TYPES)], _NAMES)

    return docs.select("doc_id", queue.alias("queue"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _PACKETS)


_NAMES = [field.split()[0] for field in _PACKETS.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _rows(encoder: Encoder, end: bytes, part: int, sent: dict[str, int], sequence: int, ids, queues, texts) -> Iterator[tuple]:
    for doc_id, queue, text in zip(ids, queues, texts):
        found = encoder.encode(text) + end
        total = len(found) // 4
        for start in range(0, total, sequence):
            piece = np.frombuffer(found, "<u4")[start : start + sequence]
            yield part, doc_id, queue, sent.get(queue, 0), start, len(piece), total, piece.astype("<u2").tobytes()
            sent[queue] = sent.get(queue, 0) + len(piece)


def _ahead(total: str, order: list[str], within: list[str]) -> Column:
    """Sum of ``total`` over the rows before this one."""
    rows = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(rows), F.lit(0))


def _mixture(sizes: DataFrame, mix: DataFrame) -> tuple[dict[str, tuple[float, float]], tuple[float, float], np.ndarray, np.ndarray]:
    """Credit of each listed queue, and of all others together, as (share, tokens); and when queues run dry.

    In turn v every queue has been credited v times its share. The last two are the turns in which some queue
    is exhausted, and the tokens sent by then: from there on the others share its credit, and go faster.
    """
    asked = {r["queue"] or "": r["share"] for r in mix.select("queue", "share").limit(MAX_MIX + 1).collect()}
    if len(asked) > MAX_MIX or any(s is None or not 0 <= s < math.inf for s in asked.values()):
        raise ValueError(f"target proportions are at most {MAX_MIX} queues with shares of 0 and more")
    named = F.col("queue").isin(*asked) if asked else F.lit(False)
    per_name = sizes.groupBy(F.when(named, F.col("queue")).alias("queue")).agg(F.sum("tokens").alias("tokens"))
    held = {r["queue"]: r["tokens"] for r in per_name.collect()}  # at most MAX_MIX + 1 rows
    rest = float(held.pop(None, 0))
    over = max(1.0, sum(asked.values()))
    credit = {q: (max(asked[q] / over, LAST), float(n)) for q, n in held.items()}
    others = max(1 - sum(asked.values()) / over, LAST), rest
    kinds = [x for x in [*credit.values(), others] if x[1]]
    turns = np.unique(np.array([0.0, *(n / share for share, n in kinds)]))
    sent = sum((np.minimum(share * turns, n) for share, n in kinds), np.zeros(len(turns)))
    return credit, others, turns, np.maximum.accumulate(sent)


def schedule(tokens: DataFrame, window: int = ROUND, mix: DataFrame | None = None) -> DataFrame:
    """Packets with ``round`` and ``place``, their first token's place in the one stream of all tokens.

    Deficit round-robin in closed form: in each round a queue is credited its quantum, its target share of
    ``window``, and sends packets from its head while its credit lasts; what is left, to the fraction of a token,
    carries over to the next round, whichever task holds the packets. So a packet leaves in the round in which
    the credit of all rounds reaches a certain part of it, drawn for each queue by a hash: the many queues
    smaller than a window, whose turn comes once in many rounds, are spread over all rounds.

    Targets are the corpus shares, by which all queues end together, or those of ``mix`` (queue, share): queues
    that it does not list divide what is left of 1 by their sizes, and the credit of a queue that has run dry goes
    to the others by their shares. Every window has the target mixture to within one packet for each queue.
    """
    slim = tokens.groupBy("part", "queue").agg(F.sum("length").alias("tokens"))
    sums = staged(slim, "queues")  # a row for each task and queue
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    rounds = max(1, -(-total // window))
    sizes = staged(sums.groupBy("queue").agg(F.sum("tokens").alias("tokens")), "sizes")
    drawn = F.pmod(F.xxhash64(F.lit("draw"), "queue"), F.lit(1 << 20)) / float(1 << 20)
    if mix is None:
        rate = F.col("tokens") / F.lit(float(max(1, total)))
    else:
        credit, (share, rest), turns, sent_by = _mixture(sizes, mix)
        rate = F.col("tokens") / F.lit(max(1.0, rest)) * share
        if credit:
            listed = F.from_json(F.lit(json.dumps({q: s for q, (s, _) in credit.items()})), "map<string,double>")
            rate = F.coalesce(F.element_at(listed, F.col("queue")), rate)
    rates = staged(sizes.select("queue", rate.alias("rate"), drawn.alias("drawn")), "rates")
    offsets = sums.withColumn("ahead", _ahead("tokens", ["part"], ["queue"])).join(rates, "queue")
    placed = tokens.join(staged(offsets.drop("tokens"), "offsets"), ["part", "queue"])
    at = placed.withColumn("at", F.col("ahead") + F.col("before"))
    turn = (F.col("at") + F.col("drawn") * F.col("length")) / F.col("rate")
    reached = turn if mix is None else _sent(turns, sent_by)(turn)
    sent = at.withColumn("round", F.least(F.floor(reached / float(window)), F.lit(rounds - 1)).cast("long"))
    # The stream is ordered by round, queue and place in the queue: sum up the tokens before each round and queue.
    turns = sent.groupBy("round", "queue").agg(F.sum("length").alias("tokens"), F.min("at").alias("first"))
    turns = staged(turns.withColumn("block", F.expr(f"round div {_BLOCK}")), "turns")
    blocks = turns.groupBy("block").agg(F.sum("tokens").alias("all"))
    blocks = blocks.select("block", _ahead("all", ["block"], [F.lit(0)]).alias("base"))
    start = F.col("base") + _ahead("tokens", ["round", "queue"], ["block"])
    starts = turns.join(blocks, "block").select("round", "queue", "first", start.alias("begin"))
    # Both sides are laid out by round, so the tokens move once and whole sequences end up together.
    stream = sent.repartition("round").join(staged(starts, "starts").repartition("round"), ["round", "queue"])
    return stream.withColumn("place", F.col("begin") + F.col("at") - F.col("first"))


def _sent(turns: np.ndarray, sent_by: np.ndarray):
    """Tokens sent up to a turn, by a column function; never less for a later turn."""

    @F.pandas_udf("double")
    def reached(turn: pd.Series) -> pd.Series:
        i = np.clip(np.searchsorted(turns, turn.to_numpy(), "right") - 1, 0, max(0, len(turns) - 2))
        if len(turns) < 2:
            return pd.Series(np.zeros(len(turn)))
        slope = (sent_by[i + 1] - sent_by[i]) / (turns[i + 1] - turns[i])
        return pd.Series(np.minimum(sent_by[i] + slope * (turn.to_numpy() - turns[i]), sent_by[i + 1]))

    return reached


def pack(docs: DataFrame, sequence: int = SEQUENCE, window: int = ROUND, ids: bool = True, mix: DataFrame | None = None) -> DataFrame:
    """Pieces of sequences of ``sequence`` tokens, mixed by source as ``schedule`` says (targets: ``mix``).

    Returns doc_id, queue (the source), start, length, doc_tokens, round, sequence_id, offset, ids_crc32 and,
    if asked for, ids: the piece's token ids as little-endian unsigned 32-bit numbers, of which ids_crc32 is
    the checksum. A document is its token ids and END. All sequences but the last are full, so only that one
    is padded. The tokens cross the network once, to their round. A null text is empty (one token), null
    sources share a queue, null doc_ids are kept, repeated rows are packed again, an empty table gives no
    piece.
    """
    stream = schedule(staged(packets(docs, sequence), "packets"), window, mix)
    names = ["doc_id", "queue", "start", "length", "doc_tokens", "round", "place", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            out = [[] for _ in range(9 + ids)]
            for doc_id, queue, start, length, total, turn, place, packed in zip(*(c.to_pylist() for c in part.columns)):
                wide = np.frombuffer(packed, "<u2").astype("<u4")
                at = 0
                while at < length:
                    n = min(length - at, sequence - (place + at) % sequence)
                    piece = wide[at : at + n].tobytes()
                    row = (doc_id, queue, start + at, n, total, turn, *divmod(place + at, sequence), zlib.crc32(piece), piece)
                    for column, value in zip(out, row):
                        column.append(value)
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], fields)

    schema = "doc_id long, queue string, start long, length long, doc_tokens long, round long, sequence_id long, offset long, ids_crc32 long"
    schema += ", ids binary" * ids
    fields = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 7, *[pa.binary()] * ids]
    return stream.select(*names).mapInArrow(cut, schema)
