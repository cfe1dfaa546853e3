"""Media columns: texts kept as baseline JPEG images, read back as DC-only luminance thumbnails.

A payload's bytes become flat 8 x 8 blocks, 24 a row, whose quantised DC values are the bytes less
128, so the thumbnail of DC values is the payload itself. Each row is a restart interval. Payloads
beyond 8184 rows go into several images, one after the other. The Huffman codes are chosen so that a
block takes two whole bytes; the table's own compression (Zstandard) makes up for their length.

Defined results: a null text counts as empty, which is 576 bytes of 255; a very long text is stored
whole, as several images, and read one image at a time; repeated rows are stored each by itself and get
equal values; an empty table gives an empty result; other columns are not read, so their names may be
any. A media value that is not a baseline JPEG raises ValueError; null or no bytes are no image.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ._jpeg import BLOCKS_WIDE, MOST_ROWS, encode, luminance, parse
from ._store import named, released, shared_folder, stored, text_batches
from ._text import slices

UNIT = 576
FILL = 255
TAIL = 32
#: Stored bytes that are decoded in one go.
READ_BYTES = 1 << 21


def store(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The stored form of each row of a slice: its payload's images, one after the other."""
    media, most = [], MOST_ROWS * BLOCKS_WIDE // UNIT * UNIT
    for a, b in zip(offsets, offsets[1:], strict=False):
        images, padded = [], max(-(-(b - a) // UNIT), 1) * UNIT
        for first in range(0, padded, most):
            samples = np.full(min(most, padded - first), FILL, np.uint8)
            part = data[a + first : min(b, a + first + most)]
            samples[: len(part)] = part
            images.append(encode(samples))
        media.append(b"".join(images))
    return media


def thumbnails(media: list[bytes]) -> list[list[np.ndarray]]:
    """The luminance thumbnails of all images of each stored value."""
    images, owners, at = [], [], 0
    for i, value in enumerate(media):
        begin = 0
        while begin < len(value):
            image = parse(value, begin)
            begin = image.end + 2
            image.begin, image.end = image.begin + at, image.end + at
            images.append(image)
            owners.append(i)
        at += len(value)
    out: list[list[np.ndarray]] = [[] for _ in media]
    if images:
        for i, thumb in zip(owners, luminance(np.frombuffer(media[0] if len(media) == 1 else b"".join(media), np.uint8), images), strict=True):
            out[i].append(thumb)
    return out


def feature(thumbs: list[np.ndarray]) -> str:
    """Dimensions, and a 64-bit hash: which cells of an 8 x 8 grid over the thumbnail are brighter than their median."""
    if not thumbs:
        return "0x0:"
    if len({x.shape[1] for x in thumbs}) > 1:
        thumbs = thumbs[:1]
    whole = np.concatenate(thumbs) if len(thumbs) > 1 else thumbs[0]
    height, width = whole.shape
    rows, columns = np.arange(8) * height // 8, np.arange(8) * width // 8
    tall = np.maximum(np.append(rows[1:], height), rows + 1)
    sums = np.add.reduceat(np.stack([whole[a:b].sum(0, np.int64) for a, b in zip(rows, tall, strict=True)]), columns, 1)
    cells = np.diff(np.append(rows, height))[:, None] * np.diff(np.append(columns, width))[None, :]
    means = sums / np.maximum(cells, 1)
    bright = means > np.median(means)
    return f"{width * 8}x{height * 8}:{np.packbits(bright).tobytes().hex()}"


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media binary of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(np.diff(offsets)), pa.array(store(data, offsets), pa.binary())], names=[key, "n_bytes", "media"])

    text_batches(docs.sparkSession)
    slim = docs.select(named(key).alias(key), named(text).alias("text"))
    return slim.mapInArrow(released(run), f"`{key}` {slim.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def media_facts(media: list[bytes]) -> list[pa.Array]:
    """Size and digests of what the stored bytes hold, of themselves, and the feature, for each value."""
    facts = []
    for value, thumbs in zip(media, thumbnails(media), strict=True):
        digest, tail, size = hashlib.sha256(), b"", 0
        for x in thumbs:
            payload = x.tobytes()
            digest.update(payload)
            tail, size = (tail + payload[-TAIL:])[-TAIL:], size + len(payload)
        facts.append((size, digest.hexdigest(), zlib.crc32(tail), len(value), hashlib.sha256(value).hexdigest(), feature(thumbs)))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return [pa.array(x, kind) for x, kind in zip(zip(*facts, strict=True) if facts else [[]] * len(kinds), kinds, strict=True)]


FACTS = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
FACT_KINDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(table: DataFrame, key: str = "doc_id", media: str = "media", also: Sequence[str] = ()) -> DataFrame:
    """key, the columns ``also`` and FACTS of stored values; null counts as no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            for run in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(ends // READ_BYTES)) + 1):
                *own, values = b.slice(run[0] if len(run) else 0, len(run)).columns
                yield pa.RecordBatch.from_arrays([*own, *media_facts([x.as_py() or b"" for x in values])], names=[key, *also, *FACTS])

    text_batches(table.sparkSession)
    slim = table.select(*(named(c).alias(c) for c in (key, *also)), named(media).alias("_media"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1])
    return slim.mapInArrow(released(run), f"{kinds}, {FACT_KINDS}")


def media_round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and FACTS: each row is stored and its stored bytes are read back, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in slices(b.column(1), READ_BYTES // 2):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(np.diff(offsets)), *media_facts(store(data, offsets))], names=[key, "n_bytes", *FACTS])

    text_batches(docs.sparkSession)
    slim = docs.select(named(key).alias(key), named(text).alias("text"))
    return slim.mapInArrow(released(run), f"`{key}` {slim.schema[0].dataType.simpleString()}, n_bytes long, {FACT_KINDS}")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of a media column that is written as a table and read again."""
    media = stored(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), shared_folder(spark), "media", "zstd")
    return read_media(media, "doc_id", "media", ["n_bytes"])


QUERIES = {"op9_media": op9_media}
ORACLE_SQL: dict[str, str] = {}
