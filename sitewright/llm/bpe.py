"""BPE encoding and decoding by prefix-sharing trie traversal.

A BPE encoding is fixed by the last token of each prefix: the encoding of ``s[:i]`` is that
of ``s[:i-len(t)]`` followed by ``t``, where ``t`` is the only vocabulary token ending at
``i`` that forms a stable pair with the last token before it. So the distinct words of a
batch go into a trie, and one depth-first walk keeps the last token of each prefix on the
path: a prefix that many words share is encoded once, and a word reads its tokens back
along its own path.

Results by case: a null text encodes as the empty text (no tokens, empty decoding); a null
id stays null; rows that repeat are encoded each; other columns are not carried; an empty
table gives an empty result. Special-token strings in a text become their ids, as the
library does by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct units (words with their punctuation) that a worker keeps; then it starts anew.
CACHE_UNITS = 1_200_000
#: Rows that are encoded and sent on together.
SLICE_ROWS = 512


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(shifted)}


class TrieBPE:
    """A vocabulary with its merges, and words' tokens by depth-first trie walks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.letters = byte_alphabet()
        # Symbols are single characters; a word's last symbol carries the suffix, written
        # here as one character of a private range, so a token is a plain string of symbols.
        self.last = {c: chr(0xE000 + k) for k, c in enumerate(self.letters.values())} if self.suffix else {}
        self.ids = {self._symbols(t): i for t, i in model["vocab"].items()}
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.rank = {}
        for k, (a, b) in enumerate(merges):
            self.rank.setdefault((self._symbols(a), self._symbols(b)), k)
        # Tokens in the order in which merging can build them: symbols first, then merges.
        made = {a + b for a, b in self.rank}
        order = [t for t in self.ids if t not in made]
        self.n_base = len(order)
        self.built = {t: k for k, t in enumerate(order)}
        self.halves: list[tuple[int, int]] = [(k, k) for k in range(self.n_base)]
        self.joined: dict[int, int] = {}
        for a, b in self.rank:
            if a in self.built and b in self.built and a + b in self.ids and a + b not in self.built:
                self.built[a + b] = k = len(self.halves)
                self.halves.append((self.built[a], self.built[b]))
                self.joined[self.built[a] << 20 | self.built[b]] = k
        self.id_of = [self.ids[t] for t in self.built]
        self.length_of = [len(t) for t in self.built]
        self.endings = ahocorasick.Automaton()  # yields a position's tokens from the longest on
        for t, k in self.built.items():
            self.endings.add_word(t, (k, len(t)))
        self.endings.make_automaton()
        self._stable: dict[int, bool] = {}

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return body[:-1] + self.last.get(body[-1], body[-1])
        return token

    def word_symbols(self, word: str) -> str:
        s = "".join(map(self.letters.__getitem__, word.encode()))
        return s[:-1] + self.last[s[-1]] if self.suffix else s

    def merge_all(self, symbols: str) -> list[str]:
        """Rank-order merging of a short string: the definition that pairs are tested by."""
        parts = list(symbols)
        while len(parts) > 1:
            ranked = [(self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:], strict=False))]
            best, at = min(ranked)
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens side by side stay as they are under merging.

        Merging is undone step by step across the seam, latest merge first; the pair breaks
        if the symbols that then meet there have a merge that comes before that step.
        """
        key = a << 20 | b
        if (known := self._stable.get(key)) is not None:
            return known
        if len(self._stable) > 1_000_000:
            self._stable.clear()
        joined, halves, limit = self.joined.get, self.halves, 1 << 40
        while True:
            if joined(a << 20 | b, limit) < limit:
                known = False
                break
            if a > b and a >= self.n_base:
                limit, a = a, halves[a][1]
            elif b >= self.n_base:
                limit, b = b + 1, halves[b][0]
            elif a >= self.n_base:
                limit, a = a, halves[a][1]
            else:
                known = True
                break
        self._stable[key] = known
        return known

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Token ids of each distinct word, from one depth-first walk over their trie.

        Sorted words are the trie in depth-first order: what a word shares with the one
        before it is the path that stays, and only its own symbols are computed.
        """
        out: dict[str, list[int]] = {}
        stable, known, endings = self.stable, self._stable.get, self.endings.iter
        id_of, length_of = self.id_of, self.length_of
        path, last = "", [-1]  # last[i]: the last token of the encoding of the path's first i symbols
        for symbols, word in sorted((self.word_symbols(w), w) for w in words):
            shared, n = 0, len(symbols)
            for x, y in zip(path, symbols):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            last += [-1] * (n - shared)
            path = symbols
            for at, (token, length) in endings(symbols):
                end = at + 1
                if end <= shared or last[end] >= 0:
                    continue
                if length == end:
                    last[end] = token
                elif (before := last[end - length]) >= 0:
                    fits = known(before << 20 | token)
                    if fits is None:
                        fits = stable(before, token)
                    if fits:
                        last[end] = token
            ids, end = [], n
            while end:
                token = last[end]
                if token < 0:  # a symbol outside the vocabulary: merging drops it
                    ids = [self.ids[t] for t in reversed(self.merge_all(symbols)) if t in self.ids]
                    break
                ids.append(id_of[token])
                end -= length_of[token]
            out[word] = ids[::-1]
        return out


#: What splits a normalised text into words (fixed by the vocabulary's file).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class TextCodec:
    """Whole texts to ids and back, with the vocabulary's own normalisation."""

    def __init__(self, path: str):
        self.bpe = TrieBPE(path)
        self.word = regex.compile(WORD)
        self.units: dict[str, bytes] = {}
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.bpe.special, key=len, reverse=True)) + ")") if self.bpe.special else None
        self.surface = [self.bpe.tokens.get(i, "") for i in range(max(self.bpe.tokens) + 1)]

    def units_of(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # letters are lowered one by one, without regard to a word's end
                text = text.replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split, not for \s
            return [u for u in regex.split(r"[\p{White_Space}]+", text) if u]
        return text.split()

    def learn(self, units: set[str]) -> None:
        """Encode new units: all their distinct words share one trie."""
        split = {u: self.word.findall(u) for u in units}
        words = self.bpe.encode_words(set(chain.from_iterable(split.values())))
        for u, ws in split.items():
            self.units[u] = array("i", chain.from_iterable(map(words.__getitem__, ws))).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts: list[list[str]] = []  # each text between special tokens; those stand as one-item lists
        spans: list[tuple[int, int]] = []
        for text in texts:
            at = len(parts)
            if text and any(s in text for s in self.bpe.special):
                parts += [["\n" + p] if p in self.bpe.special else self.units_of(p) for p in self.split_special.split(text) if p]
            else:
                parts.append(self.units_of(text or ""))
            spans.append((at, len(parts)))
        seen = set().union(*parts)
        if len(self.units) + len(seen) > CACHE_UNITS:
            self.units.clear()
        self.units |= {"\n" + s: i.to_bytes(4, "little") for s, i in self.bpe.special.items()}
        if new := seen - self.units.keys():
            self.learn(new)
        get = self.units.__getitem__
        return [np.frombuffer(b"".join(map(get, chain.from_iterable(parts[a:b]))), dtype="<i4") for a, b in spans]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space, as a vocabulary without a decoder does."""
        return " ".join(map(self.surface.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> TextCodec:
    return TextCodec(path)


def encode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """``id_col``, ``ids array<int>`` of each row's whole text and, if asked, ``decoded``.

    One narrow pass: no shuffle, so no key can be hot, and a lost task reruns alone. Memory
    is a slice of rows and a cache of CACHE_UNITS units a worker.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>" + ", decoded string" * with_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = c.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, "<i4"), pa.int32())
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
                if with_decoded:
                    columns.append(pa.array([c.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded`` for a table of token ids (null ids: the empty text)."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            texts = [c.decode(np.array(ids or [], dtype="<i4")) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return df.select(id_col, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)
