"""Secret scans: fixed patterns, and a token-efficiency test for what they miss.

Prose takes few tokens for its length, a random string many. So each run of key characters
outside the patterns' spans that has letters is encoded with a byte-level
vocabulary, and a low number of characters a token exposes it, unless it is a known kind of
digest (bare hexadecimal of a digest's length), an identifier (UUID, timestamp, version) or
part of an address.

Results by case: a null or empty text has no spans; a null id stays null; repeated rows are
scanned each; other columns are not carried (``redact`` keeps them all); an empty table
gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with equal starts stand.
KINDS = ("assign", "access", "hex", "dense")
#: The fixed patterns; a match fails if the part that counts is shorter than the length.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Candidates of the efficiency test: length, and characters a token up to which one is random.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MOST_CHARS_A_TOKEN = 2.2
#: Known digests' lengths in hexadecimal, and identifiers.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z")
IDENTIFIER = re.compile(r"(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\d{4}-\d\d-\d\d(?:[T_-]\d{1,9}){0,5}(?:[TZ_-][A-Za-z0-9]{0,6})?|v?\d+(?:[._-]\d+)+[._-]?[A-Za-z0-9]{0,8}|[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?\d{1,6})\Z")
#: Addresses: what starts one (a scheme, a host with a path or of three parts), the host after
#: an @, and what a run of one cannot contain.
ADDRESS = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{1,15}://|(?<![a-zA-Z0-9-])(?:[a-z0-9-]{1,63}\.){1,8}[a-z]{2,6}/|(?<![a-zA-Z0-9-])(?:[a-z0-9-]{1,63}\.){2,8}[a-z]{2,6}(?=:|\Z)")
MAILED = re.compile(r"@[A-Za-z0-9-]+\.[A-Za-z]")
BREAKS = re.compile(r"[\s\"'`<>(){}\[\],;|?&#]")
#: Rows that are masked at once.
SLICE = 256
#: The byte-level vocabularies' split (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Span = tuple[int, int, int]  # start, kind's number, end


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += ((m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"])
    if "AKIA" in text:
        spans += ((m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"])
    spans += ((m.start(), 2, m.end()) for m in HEX.finditer(text))
    return spans


class Runs:
    """The runs of text between BREAKS, passed once, with where addresses in the present one are."""

    def __init__(self, text: str) -> None:
        self.text, self.low, self.high = text, 0, -1

    def in_address(self, a: int, b: int) -> bool:
        """Whether ``text[a:b]`` is part of a URL, an e-mail address or a host; ``a`` never falls."""
        if a >= self.high:
            while a >= self.high:
                self.low = self.high + 1
                found = BREAKS.search(self.text, self.low)
                self.high = found.start() if found else len(self.text)
            run = self.text[self.low : self.high]
            first = ADDRESS.search(run)
            self.first = self.low + first.start() if first else None
            self.mailed = max((self.low + m.start() for m in MAILED.finditer(run)), default=-1)
        return (self.first is not None and self.first < b) or (a > self.low and self.text[a - 1] == "@") or self.mailed >= b


def dense_spans(text: str, vocabulary: str, found: list[Span]) -> list[Span]:
    """Random-looking strings that touch no span in ``found``."""
    out: list[Span] = []
    # Stretches that spans cover, in order: both they and the candidates are passed once.
    covered: list[list[int]] = []
    for x, _, y in sorted(found):
        if covered and x <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], y)
        else:
            covered.append([x, y])
    at, runs = 0, Runs(text)
    for m in CANDIDATE.finditer(text):
        s, a, b = m[0], m.start(), m.end()
        if not any(c.isalpha() for c in s) or DIGEST.match(s) or IDENTIFIER.match(s):
            continue
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        if at < len(covered) and covered[at][0] < b:
            continue
        if len(s) <= MOST_CHARS_A_TOKEN * len(encoder(vocabulary).encode_ordinary(s)):
            if not runs.in_address(a, b):
                out.append((a, 3, b))
    return out


def spans_of(text: str | None, vocabulary: str) -> list[Span]:
    """All spans of one text, by start and then by kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + dense_spans(text, vocabulary, base))


def scan(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans array<struct<kind, start, end>>`` of each row's whole text."""
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, spans array<struct<kind: string, start: int, end: int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t.as_py(), vocabulary)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def masked(text: str | None, vocabulary: str, mask: str) -> str | None:
    """The text with each stretch of overlapping spans replaced by the mask."""
    if not text:
        return text
    out, at = [], 0
    for a, _, b in spans_of(text, vocabulary):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]]) if at else text


def redact(df: DataFrame, vocabulary: str, *, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``df`` with every span of ``text_col`` masked; all rows and columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            for at in range(0, batch.num_rows, SLICE):  # so that a worker holds few texts beside a batch
                part = batch.slice(at, SLICE)
                texts = pa.array([masked(t.as_py(), vocabulary, mask) for t in part.column(place)], batch.schema.field(place).type)
                yield part.set_column(place, batch.schema.field(place), texts)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)
