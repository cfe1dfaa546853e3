"""Quality rules: gradient-boosted trees over document statistics, behind a few fixed base rules.

Statistics come from vectorised passes over UTF-8 bytes. The trees are fitted on a bounded sample of
labelled rows (``TRAIN_ROWS``), flattened into node arrays and applied to all rows at once; more
symbols, repeated lines, repeated words or capitals can only lower a score.

Defined results: a null or empty text has no words, so it fails the base rule; a very long text is
judged whole, in pieces; repeated rows are judged each by itself and get equal values; a row at a limit
(20 words, 30 per cent, a quality of just KEEP_ABOVE) passes it; without labels, or with labels of one
class, the trees are a constant and pass as the base rate says; an empty table gives an empty result;
other columns are not read, so their names may be any. Words and lines are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._boost import Trees, fit
from ._sample import labelled
from ._store import named, released, text_batches
from ._text import FEED, IN_WORD, SPACE, chained, pieces, slices, span_hashes, words

TRAIN_ROWS = 4000
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
WINDOW = 8
#: A row is dropped when the trees give good quality less than this probability.
KEEP_ABOVE = 0.35
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_capitals", "n_marks", "n_lines")
#: Of FEATURES: the direction in which the score may go.
FEATURES = (("log_words", 0), ("mean_word", 0), ("symbols", -1), ("dup_lines", -1), ("repeats", -1), ("capitals", -1), ("marks", -1))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated_words(hashes: np.ndarray) -> int:
    """Words inside a window of WINDOW words that occurs at least twice."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    mixed = chained([hashes[k : k + n] for k in range(WINDOW)], WINDOW)
    order = np.argsort(mixed, kind="stable")
    mixed = mixed[order]
    same = mixed[1:] == mixed[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, np.int8)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    cover = np.zeros(len(hashes) + 1, np.int8)
    cover[:n] += twice
    cover[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(cover[:-1], dtype=np.int32) > 0).sum())


def _line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines with a word, and the index of the first of each row (n + 1 entries)."""
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feeds + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    row_ends = offsets[np.searchsorted(offsets, starts, "right")]
    ends = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, starts)], row_ends)
    filled = np.logical_or.reduceat(IN_WORD[data], starts)
    starts, ends = starts[filled], ends[filled]
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS and EXTRA of each row of a slice, int64."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(COUNTS) + len(EXTRA)), np.int64)
    parts, lines = [(data, offsets)], [(data, offsets)]
    if rows == 1:  # a long text goes in pieces
        parts, lines = ([(data[a:b], np.array([0, b - a])) for a, b in pieces(data, cut=cut)] for cut in (SPACE, FEED))
    hashes = [np.zeros(0, np.uint64)]
    for part, places in parts:
        starts, ends, first = words(part, places)
        counts = (np.diff(first), _per_row(IN_WORD[part] & ((part & 0xC0) != 0x80), places), _per_row(SYMBOLS[part], places), _per_row((part >= 65) & (part <= 90), places), _per_row((part == 33) | (part == 63), places))
        for column, x in zip((0, 1, 2, 5, 6), counts, strict=True):
            out[:, column] += x
        hashes.append(span_hashes(part, starts, ends))
    of_words, first = np.concatenate(hashes), np.concatenate([[0], np.cumsum(out[:, 0])])
    found = [_line_hashes(*x) for x in lines]
    of_lines = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in found)])
    line_row = found[0][1] if rows != 1 else np.array([0, len(of_lines)])
    out[:, 7] = np.diff(line_row)
    for i in np.flatnonzero(out[:, 0]):
        own = of_lines[line_row[i] : line_row[i + 1]]
        if len(own) > 1:
            out[i, 3] = len(own) - len(np.unique(own))
        out[i, 4] = _repeated_words(of_words[first[i] : first[i + 1]])
    return out


def features(counts: np.ndarray) -> np.ndarray:
    n, chars, symbols, dup, repeats, capitals, marks, lines = counts.T.astype(float)
    some, letters = np.maximum(n, 1), np.maximum(chars, 1)
    return np.stack([np.log1p(n), chars / some, symbols / letters, dup / np.maximum(lines, 1), repeats / some, capitals / letters, marks / some], 1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def text_statistics(texts: pa.Array) -> np.ndarray:
    found = [statistics(data, offsets) for _, _, data, offsets in slices(texts)]
    return np.concatenate(found) if found else np.zeros((0, len(COUNTS) + len(EXTRA)), np.int64)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> Trees:
    """Trees for the label, from at most ``most`` labelled rows. Their statistics, not their texts, come to the driver."""
    rows = labelled(docs, labels, label, most=most)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(text_statistics(b.column(1)).tolist(), pa.list_(pa.int64()))], names=["doc_id", "label", "counts"])

    found = rows.mapInArrow(measure, f"doc_id {rows.schema[0].dataType.simpleString()}, label int, counts array<long>").toPandas().sort_values("doc_id", kind="stable")
    counts = np.array(found["counts"].tolist(), np.int64).reshape(len(found), len(COUNTS) + len(EXTRA))
    return fit(features(counts), found["label"].to_numpy(float), np.array([m for _, m in FEATURES]))


def judge(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text", keep_above: float = KEEP_ABOVE) -> DataFrame:
    """key, the five counts, base_failed, quality (0..1) and kept of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = text_statistics(b.column(1))
            failed, quality = base_failed(counts), trees.score(features(counts))
            columns = [b.column(0), *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(failed), pa.array(quality), pa.array(~failed & (quality >= keep_above))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *COUNTS, "base_failed", "quality", "kept"])

    text_batches(docs.sparkSession)
    slim = docs.select(named(key).alias(key), named(text).alias("text"))
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return slim.mapInArrow(released(run), f"`{key}` {slim.schema[0].dataType.simpleString()}, {kinds}, base_failed boolean, quality double, kept boolean")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL: dict[str, str] = {}
