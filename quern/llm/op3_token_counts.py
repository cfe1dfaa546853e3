"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary is a ``tokenizers`` JSON file with a word-end suffix. A word's count is its number of
initial symbols minus the merges made; no identifiers are produced.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a very long text is counted whole, in
windows that end before a space; a text of just the limit is not over it; repeated rows are counted each
by itself and get equal values; an empty table gives an empty result; columns other than the key and the
text are not read, so their names may be any. Special strings (``<|endoftext|>`` and the like) inside a
text count as one token each.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import named, released, text_batches

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Pieces, and runs between white space, whose counts a worker remembers, each in two generations: about 0.2 KB
#: each, as longer ones than REMEMBERED_CHARS are not remembered.
REMEMBERED = 200_000
REMEMBERED_CHARS = 48
#: Characters of a text that are counted in one go.
WINDOW = 1 << 20
#: Pieces of more bytes are merged in arrays, which take less memory than lists.
LONG_PIECE = 1 << 12


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def heap_merges(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> int:
    """How many merges byte-pair encoding makes of these symbols.

    ``ranks``: (left << 16 | right) -> rank; ``merged``: the symbol that each rank makes. The heap holds
    rank << 32 | place, so the lowest rank goes first and the leftmost of equal ones; entries whose pair
    has been merged away meanwhile are passed over.
    """
    n = len(symbols)
    row = list if n < LONG_PIECE else partial(array, "i")
    symbols, before, after = row(symbols), row(range(-1, n - 1)), row(range(1, n + 1))
    after[-1] = -1
    rank_of = ranks.get
    heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbols[i] << 16 | symbols[i + 1])) is not None]
    heapify(heap)
    made = 0
    while heap:
        top = heappop(heap)
        rank, i = top >> 32, top & 0xFFFFFFFF
        j = after[i]
        if j < 0 or symbols[i] < 0 or rank_of(symbols[i] << 16 | symbols[j]) != rank:
            continue
        symbols[i], symbols[j] = symbol, _ = merged[rank], -1
        made += 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := rank_of(symbol << 16 | symbols[k])) is not None:
                heappush(heap, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := rank_of(symbols[h] << 16 | symbol)) is not None:
            heappush(heap, r << 32 | h)
    return made


class PieceCounts(dict):
    """Token counts of pieces, filled in as they are asked for."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        super().__init__()
        self.older: dict[str, int] = {}
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 entries")
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + suffix] for x in letters]
        self.merged = [vocab[a + b] for a, b in merges]
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            self.ranks.setdefault(vocab[a] << 16 | vocab[b], rank)

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            data = piece.encode()
            symbols = [self.inner[b] for b in data]
            symbols[-1] = self.last[data[-1]]
            n = len(symbols) - heap_merges(symbols, self.ranks, self.merged)
        if len(piece) > REMEMBERED_CHARS:
            return n
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = n
        return n


class ChunkCounts(dict):
    """Token counts of what stands between white space: it is split into pieces once, then remembered."""

    def __init__(self, counts: PieceCounts, pieces) -> None:
        super().__init__()
        self.older: dict[str, int] = {}
        self.counts, self.pieces = counts, pieces

    def __missing__(self, chunk: str) -> int:
        n = self.older.get(chunk)
        if n is None:
            n = sum(map(self.counts.__getitem__, self.pieces(chunk)))
        if len(chunk) > REMEMBERED_CHARS:
            return n
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[chunk] = n
        return n


class Counter:
    """Counts the tokens of whole texts as the library with this file does, without added begin and end."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        counts = PieceCounts(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]], model["end_of_word_suffix"])
        pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        #: No piece crosses white space, so texts are cut there first.
        self.counts = ChunkCounts(counts, pieces)
        #: What str.split() takes as white space and the pattern does not.
        self.odd = re.compile("[\x1c-\x1f]").search
        self.spaced = regex.compile(r"\S+").findall
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        n, first = 0, 0
        while len(text) - first > WINDOW and (at := text.find(" ", first + WINDOW)) >= 0:
            n, first = n + self(text[first:at]), at
        if first:
            text = text[first:]
        parts = self.special.split(text) if self.special else [text]
        n += len(parts) - 1
        for part in parts:
            if not part.isascii():
                # letters are lowered one by one, without the rule for a final sigma
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            chunks = self.spaced(part) if self.odd(part) else part.split()
            n += sum(map(self.counts.__getitem__, chunks))
        return n

    def forget(self) -> None:
        """Drops what was remembered of texts: kept from task to task it costs a waiting worker memory."""
        for memory in (self.counts, self.counts.older, self.counts.counts, self.counts.counts.older):
            memory.clear()


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every row. ``path``: the vocabulary file, present on every executor."""
    path = path or public_tokenizers.path(VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n_tokens = pa.array((of(x.as_py() or "") for x in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], names=[key, "n_bytes", "n_tokens"])
        of.forget()

    text_batches(docs.sparkSession)
    slim = docs.select(named(key).alias(key), named(text).alias("text"))
    counted = slim.mapInArrow(released(count), f"`{key}` {slim.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE_SQL: dict[str, str] = {}
