"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut at the vocabulary's added tokens, normalised (NFC, lower case) and split into pieces
by the vocabulary's pattern (texts with characters newer than some tables: by the library's own); each piece's UTF-8 bytes become symbols, the last one marked as a
word's end. The tree has a leaf for each adjacent pair, holding its merge rank and place, and each
inner node the least of its children; the root is the leftmost pair of the lowest rank. A merge
changes three leaves and their ancestors, so a piece of n bytes takes n log n steps, however long.
Pieces recur, so a task keeps the ids of some, up to ``CACHED`` bytes; its Python worker, which waits
for other stages' tasks beside the executor's heap, keeps none.

Rows are encoded where they lie, in Arrow batches; nothing is shuffled. Each worker reads the
vocabulary file (a tokenizers JSON file, by path) once. Null texts count as empty and give no ids.
Ids are a binary column, four bytes each. Repeated rows give equal ids. Other columns pass through; the result's column is replaced.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import small_batches

CACHED = 40 << 20  # bytes of pieces and their ids
ENTRY = 160  # what an entry takes besides
CACHED_BYTES = 64
BATCH = 256  # texts worked on at once
NONE = 1 << 62
PLACE = (1 << 32) - 1
#: Characters that every version of Unicode classes alike; texts with others are normalised and
#: split by the tokenizers library, whose character tables may be older or newer than Python's.
SETTLED = re.compile("[\x00-\u024f\u0400-\u0481\u2010-\u2027\u3041-\u3096\u4e00-\u9fa5\uac00-\ud7a3]*").fullmatch
SPACES = r"\x09-\x0d\x20\x85\xa0"  # the settled characters that are white space


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def char_class(kinds: str) -> str:
    """What settled characters of the given categories become in lower case, as a character class."""
    lower = {c for x in map(chr, range(0xD800)) if SETTLED(x) for c in x.lower()}
    found = sorted(c for c in lower if unicodedata.category(c)[0] in kinds)
    runs: list[list[str]] = []
    for c in found:
        if runs and ord(c) == ord(runs[-1][1]) + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(x)}-{re.escape(y)}" for x, y in runs)


class Vocabulary:
    """A BPE vocabulary from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids = model["vocab"]
        self.width = len(ids) + len(spec["added_tokens"]) + 1
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(ids[left] * self.width + ids[right], rank)
            self.merged.append(ids[left + right])
        end = model["end_of_word_suffix"] or ""
        self.inner = [ids[s] for s in byte_symbols()]
        self.last = [ids[s + end] for s in byte_symbols()]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (ids | self.added).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        settled = pattern.replace(r"\p{L}", char_class("L")).replace(r"\p{N}", char_class("N")).replace(r"\s", SPACES)
        self.pieces = re.compile(settled).findall
        ascii_only = pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\x20\x09-\x0D")
        self.ascii_pieces = re.compile(ascii_only).findall
        self.known = Cache(self)
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.path = path

    @functools.cached_property
    def library(self):
        """The library's tokenizer, loaded when a text needs its character tables."""
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    def merge(self, piece: str) -> list[int]:
        """The ids of one piece.

        ``nodes`` is the segment tree: leaf ``size + i`` holds rank and place of the pair that starts
        at symbol i, an inner node the lesser of its children, node 1 the leftmost least of all.
        """
        data = piece.encode("utf-8", "surrogatepass")
        inner, width, ranks, merged = self.inner, self.width, self.ranks, self.merged
        symbols = [inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        n = len(symbols)
        size = 1 << (n - 1).bit_length()
        nodes = [NONE] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(symbols[i] * width + symbols[i + 1])
            if rank is not None:
                nodes[size + i] = rank << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = nodes[2 * k], nodes[2 * k + 1]
            nodes[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := nodes[1]) != NONE:
            i = root & PLACE
            gone = after[i]
            symbols[i], symbols[gone] = merged[root >> 32], -1
            then = after[i] = after[gone]
            changed = [(gone, None), (i, None)]
            if then < n:
                before[then] = i
                changed[1] = (i, ranks.get(symbols[i] * width + symbols[then]))
            if (back := before[i]) >= 0:
                changed.append((back, ranks.get(symbols[back] * width + symbols[i])))
            for at, rank in changed:
                k = size + at
                nodes[k] = NONE if rank is None else rank << 32 | at
                while k > 1:
                    k >>= 1
                    a, b = nodes[2 * k], nodes[2 * k + 1]
                    least = a if a < b else b
                    if nodes[k] == least:
                        break
                    nodes[k] = least
        return [s for s in symbols if s >= 0]

    def plain(self, text: str) -> bytes:
        if text.isascii():
            return b"".join(map(self.known.__getitem__, self.ascii_pieces(text.lower())))
        if SETTLED(text):
            return b"".join(map(self.known.__getitem__, self.pieces(unicodedata.normalize("NFC", text).lower())))
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join(self.known[bytes(self.byte_of[c] for c in p).decode("utf-8")] for p, _ in pieces)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut is None or "<|" not in text:
            return self.plain(text)
        parts = self.cut.split(text)
        return b"".join(self.added[p].to_bytes(4, "little") if k % 2 else self.plain(p) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Cache(dict):
    """Pieces to their ids as bytes, computed when missing."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.held = vocabulary, 0

    def __missing__(self, piece: str) -> bytes:
        found = np.array(self.vocabulary.merge(piece), dtype="<u4").tobytes()
        if len(piece) <= CACHED_BYTES:
            self.held += ENTRY + len(piece) + len(found)
            if self.held > CACHED:
                self.forget()
            self[piece] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.held = 0


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def over_rows(work, kind: str):
    """An Arrow function that applies ``work(vocabulary, value)`` to each row of a batch."""

    def udf(value: Column, path: str) -> Column:
        @F.arrow_udf(kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            words = vocabulary(path)
            try:
                for batch in small_batches(batches, BATCH):
                    yield work(words, (x.as_py() for x in batch))
            finally:
                words.known.forget()
                pa.default_memory_pool().release_unused()

        return run(value)

    return udf


def both_ways(words: Vocabulary, texts: Iterator[str | None]) -> pa.Array:
    ids, back = [], []
    for text in texts:
        ids.append(words.encode(text or ""))
        back.append(words.decode(ids[-1]))
    return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(back, pa.string())], ["ids", "decoded"])


encoded = over_rows(lambda words, texts: pa.array([words.encode(t or "") for t in texts], pa.binary()), "binary")
decoded = over_rows(lambda words, ids: pa.array([words.decode(x or b"") for x in ids], pa.string()), "string")
round_trips = over_rows(both_ways, "ids binary, decoded string")


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row with its token ids, packed as little-endian unsigned 32-bit integers."""
    return docs.withColumn(ids, encoded(F.col(text), path))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Every row with the text of its packed ids: its tokens joined by a space."""
    return docs.withColumn(text, decoded(F.col(ids), path))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that a task needs one Python worker only."""
    rows = docs.withColumn("__both", round_trips(F.col(text), path))
    return rows.withColumns({ids: F.col("__both.ids"), back: F.col("__both.decoded")}).drop("__both")
