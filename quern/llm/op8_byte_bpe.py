"""Byte-level BPE encoding and decoding by longest matches and backtracking.

Bytes are mapped to Latin-1 letters so that an Aho-Corasick automaton (pyahocorasick) can find every
vocabulary entry in one pass over a piece. Encoding starts from the longest match at each place and
steps back whenever two adjacent tokens are not what plain merging would give for their joint bytes;
that test is remembered per pair, and places that turned out dead are never tried again, so the time
is linear in the piece and the result equals the exact merges.

Defined results: a null text counts as empty (no ids, digest of no bytes); a very long text is encoded
whole, in windows that end where a piece ends; repeated rows are encoded each by itself and get equal
values; an empty table gives an empty result; other columns than key and text are not read, so their
names may be any.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._store import named, released, text_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Runs up to a space, and pieces without one, that a worker remembers within a task, each in two generations: about
#: 0.3 KB each, as longer ones than REMEMBERED_CHARS are not remembered.
REMEMBERED = 200_000
REMEMBERED_CHARS = 48
#: Token pairs that a worker remembers.
REMEMBERED_PAIRS = 200_000
#: Characters of a text, and of texts together, that are encoded in one go.
WINDOW = 1 << 20
#: Pieces of more bytes are handled in arrays, which take less memory than lists.
LONG_PIECE = 1 << 12
_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def plain_merges(piece: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """The defining algorithm: merge the adjacent pair of the lowest rank, leftmost first, until none has a rank or ``until`` parts are left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > until:
        best, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
        if best == _NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Merges:
    """Encodes single pieces."""

    def __init__(self, path: str) -> None:
        self.ranks = ranks = read_ranks(path)
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.widths = [len(t) for t in self.tokens]
        self.pairs: dict[int, bool] = {}
        #: The two tokens that an entry is merged from; only entries that merging gives for their own bytes can be part of an encoding.
        self.head, self.tail = [-1] * size, [-1] * size
        #: Whether entries are always merged from entries of lower ranks, as in any trained vocabulary.
        self.rising = True
        for rank, token in enumerate(self.tokens):
            if len(token) > 1:
                self._split(rank, token)
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * size
        own = {t for r, t in enumerate(self.tokens) if len(t) == 1 or self.head[r] >= 0}
        for token in own:
            rank = ranks[token]
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in own), -1)
        self.automaton.make_automaton()
        #: Entries of one byte match everywhere and are left out of the automaton.
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]

    def _split(self, rank: int, token: bytes) -> None:
        ranks, usable = self.ranks, lambda r: r is not None and (self.widths[r] == 1 or r < rank and self.head[r] >= 0)
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if usable(a) and usable(b) and self._stay_apart(a, b, rank):
                self.head[rank], self.tail[rank] = a, b
                return
        parts = plain_merges(token, ranks, 2)
        if len(parts) == 2 and all(x in ranks for x in parts):
            self.head[rank], self.tail[rank] = ranks[parts[0]], ranks[parts[1]]
            self.rising = False

    def _stay_apart(self, x: int, y: int, before: int = _NEVER) -> bool:
        """Whether no merge of a rank below ``before`` crosses from x to y.

        Merges are undone from the latest on, so that (x, y) is each pair of tokens that ever met at the border. Such a pair
        would be merged if its rank came before the merges that x (further left, so first of equal ranks) and y go into.
        """
        ranks, tokens, widths = self.ranks, self.tokens, self.widths
        x_goes = y_goes = before
        while True:
            joint = ranks.get(tokens[x] + tokens[y], _NEVER)
            if joint < x_goes and joint <= y_goes and joint < before:
                return False
            if widths[x] > 1 and (x > y or widths[y] == 1):
                x_goes, x = x, self.tail[x]
            elif widths[y] > 1:
                y_goes, y = y, self.head[y]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint bytes of two tokens gives just these two."""
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        a, b = self.tokens[left], self.tokens[right]
        known = self.pairs[left << 32 | right] = self._stay_apart(left, right) if self.rising else plain_merges(a + b, self.ranks) == [a, b]
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.backtrack(piece)

    def backtrack(self, piece: bytes) -> Iterable[int]:
        n, widths, shorter, pairs = len(piece), self.widths, self.shorter, self.pairs
        longest = [*map(self.single.__getitem__, piece)] if n < LONG_PIECE else array("i", map(self.single.__getitem__, piece))
        for end, (before, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - before] = rank  # later ends are longer
        dead = b"" if n < LONG_PIECE else bytearray(n + 1)
        ids = [] if n < LONG_PIECE else array("i")
        place, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                end = place + widths[token]
                if not dead or not dead[end]:
                    if last < 0:
                        break
                    fits = pairs.get(last << 32 | token)
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                if end == n:
                    return ids
                place, last, token = end, token, longest[end]
            else:
                if not ids:
                    raise ValueError(f"no encoding for {piece[:40]!r}")
                dead = dead or bytearray(n + 1)
                dead[place] = 1
                token = ids.pop()
                place -= widths[token]
                last = ids[-1] if ids else -1


class Memory(dict):
    """What was learnt, in two generations."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}

    def recall(self, key: str) -> bytes | None:
        found = self.get(key)
        if found is None and (found := self.older.get(key)) is not None:
            self[key] = found
        return found

    def age(self, most: int) -> None:
        if len(self) >= most:
            self.older = {k: v for k, v in self.items() if len(k) <= REMEMBERED_CHARS}
            self.clear()

    def forget(self) -> None:
        self.older = {}
        self.clear()


class Encoder:
    """Encodes texts to int32 arrays; remembers what follows a space, up to the next one, with the ids that it has with that space.

    The pattern always ends a piece where white space follows other text, and within a run of white
    space only the last character can belong to what follows. So a text may be cut before each space
    that has other text on at least one side; other texts are cut before each run of white space.
    """

    def __init__(self, path: str, pattern: str, most: int) -> None:
        self.most = most
        self.merges = Merges(path)
        self.tokens, self.ranks = self.merges.tokens, self.merges.ranks
        self.chunks, self.rest = Memory(), Memory()
        self.pieces = regex.compile(pattern).findall
        self.wide = regex.compile(r"\s \s|  |\s \Z").search
        self.runs = regex.compile(r"\s*\S+|\s+").findall
        self.cut = pattern == public_tokenizers.PATTERN
        widths = np.array(self.merges.widths, np.int64)
        self.flat, self.widths, self.starts = np.frombuffer(b"".join(self.tokens), np.uint8), widths, np.cumsum(widths) - widths
        self.names = np.array([f"{i} " for i in range(len(widths))], "S")

    def forget(self) -> None:
        """Drops what was remembered of texts: kept from task to task it costs a waiting worker memory."""
        self.chunks.forget()
        self.rest.forget()
        self.merges.pairs.clear()

    def _new(self, piece: str) -> bytes:
        return array("i", self.merges.encode(piece.encode())).tobytes()

    def _piece(self, piece: str) -> bytes:
        memory, key = (self.chunks, piece[1:]) if piece[0] == " " else (self.rest, piece)
        found = memory.get(key) or memory.recall(key)
        if found is None:
            found = memory[key] = self._new(piece)
        return found

    def whole(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.pieces(text)))

    def learn(self, chunks: set[str]) -> None:
        """Makes these chunks known."""
        memory, older, plain = self.chunks, self.chunks.older, []
        for x in chunks:
            if x not in memory:
                if x in older:
                    memory[x] = older[x]
                elif x and not x[0].isspace():
                    plain.append(x)
                else:
                    memory[x] = self.whole(f" {x}")
        if not plain:
            return
        # one search for all: each chunk's first piece begins with its space
        pieces = self.pieces(f" {' '.join(plain)}")
        heads = [k for k, x in enumerate(pieces) if x[0] == " "]
        if len(heads) != len(plain):
            raise ValueError("the pattern joins chunks")
        for x, a, b in zip(plain, heads, chain(heads[1:], (len(pieces),)), strict=True):
            memory[x] = self._new(pieces[a]) if b == a + 1 else b"".join(map(self._piece, pieces[a:b]))

    def _windows(self, text: str) -> Iterator[str]:
        """``text``, cut before spaces that stand between other characters."""
        first = 0
        while self.cut and len(text) - first > WINDOW:
            at = text.find(" ", first + WINDOW)
            while at >= 0 and (text[at - 1].isspace() or text[at + 1 : at + 2].isspace() or at + 1 == len(text)):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[first:at]
            first = at
        yield text[first:]

    def _parts(self, text: str) -> tuple[str, list[str]]:
        """The start of a text, and its chunks; "" and [] where it has to be encoded as it is."""
        if not self.cut or self.wide(text):
            return "", []
        head, *chunks = text.split(" ")
        return head, chunks

    def _group(self, texts: list[str]) -> list[bytes]:
        """The ids of each of some texts, which are about WINDOW characters together."""
        parts = [self._parts(x) for x in texts]
        self.learn(set().union(*(chunks for _, chunks in parts)))
        known, out = self.chunks.__getitem__, []
        for text, (head, chunks) in zip(texts, parts, strict=True):
            if chunks:
                out.append((self.whole(head) if head else b"") + b"".join(map(known, chunks)))
            elif self.cut and " " in text:
                runs = self.runs(text)
                self.learn({x[1:] for x in runs if x[0] == " "})
                out.append(b"".join(known(x[1:]) if x[0] == " " else self.whole(x) for x in runs))
            else:
                out.append(self.whole(text))
        self.chunks.age(self.most)
        self.rest.age(self.most)
        return out

    def encode_all(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text."""
        owners: list[int] = []
        group: list[str] = []
        done: list[list[bytes]] = []
        size = 0

        def flush() -> None:
            for i, found in zip(owners, self._group(group), strict=True):
                done[i].append(found)
            owners.clear()
            group.clear()

        for i, text in enumerate(texts):
            done.append([])
            for part in self._windows(text):
                owners.append(i)
                group.append(part)
                size += len(part)
                if size >= WINDOW:
                    flush()
                    size = 0
        flush()
        return [np.frombuffer(x[0] if len(x) == 1 else b"".join(x), np.int32) for x in done]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of some ids."""
        ids = np.asarray(ids, np.int64)
        out = []
        for first in range(0, len(ids), WINDOW):
            some = ids[first : first + WINDOW]
            widths = self.widths[some]
            out.append(self.flat[np.arange(widths.sum()) + np.repeat(self.starts[some] - np.cumsum(widths) + widths, widths)].tobytes())
        return b"".join(out)

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimals, joined by spaces."""
        return b"".join(self.names[ids[k : k + WINDOW]].tobytes().replace(b"\0", b"") for k in range(0, len(ids), WINDOW))[:-1]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, remembered: int = REMEMBERED) -> Encoder:
    return Encoder(path, pattern, remembered)


def _mapped(docs: DataFrame, key: str, text: str, path: str | None, pattern: str | None, make, schema: str, remembered: int = REMEMBERED) -> DataFrame:
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern, remembered)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):  # what a batch makes may be much larger than its texts
                part = batch.slice(first, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), *make(code, part.column(1))], names=names)
        code.forget()

    text_batches(docs.sparkSession)
    slim = docs.select(named(key).alias(key), named(text).alias("text"))
    schema = f"`{key}` {slim.schema[0].dataType.simpleString()}, {schema}"
    names = [key, *(x.split()[0] for x in schema.split(", ")[1:])]
    return slim.mapInArrow(released(run), schema)


def _list_array(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    if offsets[-1] >= 1 << 31:
        raise OverflowError("an Arrow batch holds less than 2**31 ids")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))


def _encoded(code: Encoder, texts: pa.Array) -> list[np.ndarray]:
    return code.encode_all([x.as_py() or "" for x in texts])


def _decoded(code: Encoder, lists: pa.Array) -> list[pa.Array]:
    return [pa.array([code.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in lists], pa.binary())]


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, ids array<int> of every row."""
    return _mapped(docs, key, text, path, pattern, lambda code, texts: [_list_array(_encoded(code, texts))], "ids array<int>")


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, data binary of every row of ids; null ids decode to no bytes."""
    return _mapped(encoded, key, ids, path, pattern, _decoded, "data binary")


def _facts(code: Encoder, lists: list[np.ndarray]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Numbers of ids, and the digests of the decimal ids and of the bytes that they decode to."""
    of_ids = [hashlib.sha256(code.decimal(x)).hexdigest() for x in lists]
    of_bytes = [hashlib.sha256(code.decode(x)).hexdigest() for x in lists]
    return pa.array([len(x) for x in lists], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())


def _digests(code: Encoder, texts: pa.Array) -> list[pa.Array]:
    return [*_facts(code, _encoded(code, texts))]


def _all(code: Encoder, texts: pa.Array) -> list[pa.Array]:
    lists = _encoded(code, texts)
    counts, *digests = _facts(code, lists)
    return [counts, _list_array(lists), *digests]


def encoding_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, n_tokens and the digests of the decimal ids and of the bytes that the ids decode to."""
    return _mapped(docs, key, text, path, pattern, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, n_tokens, ids and the digests of encoding_digests."""
    return _mapped(docs, key, text, path, pattern, _all, "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
