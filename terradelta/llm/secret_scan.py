"""Secret scans: fixed patterns, and strings that a primed compressor finds new beside a sensitive word."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from terradelta.llm.tables import slices, utf8

# The base patterns, in the order in which kinds are listed, and their least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")  # the runs of 18 and more characters of AKIA[A-Z0-9]+
HEX = re.compile(rb"[0-9a-f]{16,}")  # the runs of 16 and more characters of [0-9a-f]+
ASSIGNED = 12
KINDS = ("assign", "access", "hex", "novel")

#: Strings that may be a secret; they must hold a digit and a letter, and follow a sensitive word closely.
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
#: More of the same after one, such as the next lines of a PEM block; no context to judge it by.
MORE = re.compile(rb"(?:\s+[A-Za-z0-9+/_=-]{16,}(?!\S))*")
SENSITIVE = re.compile(rb"pass(?:word|wd|phrase|code)|secret|token|api[ _-]?key|access[ _-]?key|auth|bearer|credential|private|signature|\bkey\b|\bpwd\b", re.IGNORECASE)
REACH = 48  # bytes before a candidate in which the sensitive word stands, on its line or the line before
AROUND = 160  # bytes of context on each side that the compressor sees
NOVEL = 0.9  # share of the entropy of random characters of a candidate's alphabet that the compressor needs

#: What common identifiers look like; primes the compressor, so that such names cost few bytes.
IDENTIFIERS = (
    b"password passwd passphrase passcode secret secret_key client_secret token access_token refresh_token"
    b" id_token api_key apikey api-key access_key authorization authenticate Bearer Basic credentials private_key"
    b" public_key signature certificate username user_name account session_id request_id content-type application/json"
    b" import from return function const static public private protected class def self this null none true false"
    b" string integer boolean float double default value name path file config environment variable settings"
    b" http:// https:// localhost 127.0.0.1 example.com/ index.html ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz"
    b" 0123456789 0123456789abcdef 00000000-0000-0000-0000-000000000000 xxxxxxxxxxxxxxxx ________________ ----------------"
    b" ================ getElementById addEventListener toString parseInt setTimeout HashMap ArrayList NullPointerException"
    b" internationalization configuration implementation initialization serialization authentication application"
)

#: Stands before short contexts. Without other text the compressor stores what a key adds for less than it is worth.
FILLER = (
    b"On the whole they were glad that the weather had changed, and nobody asked how long it would take to walk back"
    b" over the hills; some had brought bread, others only wine."
)


class Span(NamedTuple):
    """A find in code points, end exclusive."""

    start: int
    end: int
    kind: str

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


@cache
def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def novelty(before: bytes, candidate: bytes, after: bytes) -> float:
    """Compressed bytes that the candidate adds to its surroundings, for each of its bytes."""
    compress = _compressor().compress
    before = FILLER[: max(0, AROUND - len(before) - len(after))] + before
    return (len(compress(before + after + candidate)) - len(compress(before + after))) / max(1, len(candidate))


def entropy(candidate: bytes) -> float:
    """Bytes for each character of a random string over the candidate's alphabet.

    The alphabet: digits, upper and lower case letters (of a case only A-F if no others stand there) as far as
    they occur, and the other characters that occur.
    """
    seen = set(candidate)
    size = 10 * any(48 <= c < 58 for c in seen) + sum(not chr(c).isalnum() for c in seen)
    for first in b"Aa":
        places = [c - first for c in seen if first <= c < first + 26]
        size += (6 if max(places) < 6 else 26) if places else 0
    return math.log2(max(2, size)) / 8


#: What parts the words of paths, addresses and identifiers, and the share of their characters that no word need explain.
PARTS, UNEXPLAINED = re.compile(rb"[/_=+-]+"), 0.25


def named(candidate: bytes) -> bool:
    """Whether a candidate is a path or a name made of words and numbers, such as docs/Guide_2024/index.

    Its three or more parts are words in one case (or with a capital), and numbers, but for less than the share
    UNEXPLAINED of the characters. Random strings mix cases and digits within their parts.
    """
    parts = [p for p in PARTS.split(candidate) if p]
    if len(parts) < 3:
        return False
    plain = (p.isdigit() or p.isalpha() and (p.islower() or p.isupper() or p[1:].islower()) for p in parts)
    return sum(len(p) for p, known in zip(parts, plain) if not known) < UNEXPLAINED * sum(map(len, parts))


def _novel(text: bytes, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Candidates in a sensitive context that compress badly and are not covered by a base find.

    The sensitive word stands on the same line or the one before; what follows a find after white space
    alone, like the lines of a PEM block, shares its context.
    """
    covered = sorted(taken)
    at, origin, last = 0, 0, None
    for m in CANDIDATE.finditer(text):
        found = m.group()
        if found.isalpha() or not any(48 <= c < 58 for c in found) or not any(c >= 65 for c in found) or named(found):
            continue
        a, b = m.span()
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        # A run of digits in a key may be a hex find; the value of an assignment reaches the end of a candidate.
        near = at
        while near < len(covered) and covered[near][0] < b and covered[near][2] != "assign" and not (covered[near][0] <= a and b <= covered[near][1]):
            near += 1
        if near < len(covered) and covered[near][0] < b:
            continue
        low = max(0, a - REACH)
        line = max(low, text.rfind(b"\n", low, a))
        line = max(low, text.rfind(b"\n", low, line) + 1)
        follows = last is not None and a - last <= REACH and text[last:a].isspace()
        if not follows and not SENSITIVE.search(text, line, a):
            continue
        start, end = origin if follows else a, MORE.match(text, b, b + 16 * AROUND).end()
        if novelty(text[max(0, start - AROUND) : start], found, text[end : end + AROUND]) >= NOVEL * entropy(found):
            origin, last = start, b
            yield a, b, "novel"


def scan(text: bytes) -> list[Span]:
    """All finds in a UTF-8 text, by start, then kind as in KINDS."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    found += list(_novel(text, found))
    if not text.isascii():
        places, chars, done = {}, 0, 0
        for at in sorted({x for a, b, _ in found for x in (a, b)}):
            chars, done = chars + len(text[done:at].decode()), at
            places[at] = chars
        found = [(places[a], places[b], kind) for a, b, kind in found]
    return [Span(*x) for x in sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` per row of ``docs``: kind, start and end (code points, end exclusive) of each secret.

    Kinds assign, access and hex are the base patterns, leftmost and not overlapping within a kind; kind
    novel is what the compressor adds. Spans are ordered by start, then kind. A null text is empty; repeated
    rows give repeated results. Texts are scanned where they are read; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            spans = [[s._asdict() for s in scan(t)] for t in utf8(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every find replaced by ``mark``; overlapping finds become one mark."""
    out, at = [], 0
    for start, end, _ in scan(text.encode()):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets replaced by ``mark`` in ``text``, and ``n_chars`` (if there) counted anew where text changed.

    Null and empty texts stay as they are, repeated rows are redacted each, an empty table gives an empty one.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            old = part.column("text").to_pylist()
            new = [t and redacted(t, mark) for t in old]
            columns = dict(zip(part.schema.names, part.columns))
            columns["text"] = pa.array(new, part.schema.field("text").type)
            if "n_chars" in columns:
                counts = [n if a == b else len(b) for a, b, n in zip(old, new, columns["n_chars"].to_pylist())]
                columns["n_chars"] = pa.array(counts, part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), part.schema.names)

    return docs.mapInArrow(run, docs.schema).select(names)
