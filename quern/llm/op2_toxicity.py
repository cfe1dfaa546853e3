"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams (of the lower-cased UTF-8 bytes) that it has at least once, each
worth its log ratio of smoothed counts in texts of label 1 and label 0; logistic regression weighs
them. Only the ``KEPT`` n-grams of the largest ratios take part, so scoring finds them by one table
lookup at each place of a text. Training reads a bounded sample of labelled rows (``TRAIN_ROWS``);
counts of n-grams and the chosen n-grams of these rows, not their texts, come to the driver.

Defined results: a null or empty text has no n-gram and scores what the intercept gives; a very long
text is scored whole, in pieces; repeated rows are scored each by itself and get equal scores; a score of
just 0.5 predicts 1; without labels of both classes every score is the smoothed base rate; an empty table
gives an empty result; other columns are not read, so their names may be any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._sample import labelled
from ._store import named, released, shared_folder, stored, text_batches
from ._text import pieces, slices

ORDERS = (4, 5, 6)
BITS = 20
KEPT = 8000
#: Texts that must have an n-gram for it to be kept.
LEAST_TEXTS = 3
TRAIN_ROWS = 6000
#: Text bytes whose n-grams the fit holds at a time.
FIT_BYTES = 1 << 18
#: Tasks that the sample is read in, and buckets (a power of 2) whose counts go together.
SAMPLE_TASKS = 8
BLOCK_BITS = 14
FOLDS = 5
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte (those cut off by the end are left out)."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    low = _LOWER[data]
    mixed = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        mixed += low[k : k + n]
        mixed *= np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(15)
    return mixed >> np.uint32(32 - BITS)


def present(data: np.ndarray, offsets: np.ndarray, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs: features are buckets, or what ``slot`` maps them to where that is at least 0."""
    pairs = [np.zeros(0, np.int64)]
    # a long text goes in pieces, which overlap so that no n-gram is lost
    parts = [(data, offsets)] if len(offsets) != 2 else [(data[a : b + max(ORDERS) - 1], np.array([0, min(b + max(ORDERS) - 1, len(data)) - a])) for a, b in pieces(data)]
    for part, places in parts:
        found = []
        for order in ORDERS:
            buckets = grams(part, order)
            at = np.arange(len(buckets)) if slot is None else np.flatnonzero(slot[buckets] >= 0)
            row = np.searchsorted(places, at, "right") - 1
            whole = at + order <= places[row + 1]
            found.append(row[whole] << 32 | (buckets if slot is None else slot[buckets])[at[whole]].astype(np.int64))
        pairs.append(np.unique(np.concatenate(found)))
    every = np.unique(np.concatenate(pairs)) if len(pairs) != 2 else pairs[1]
    return every >> 32, every & 0xFFFFFFFF


@dataclass
class Model:
    slot: np.ndarray  # of each bucket: its place in weights, or -1
    weights: np.ndarray
    intercept: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = []
        for first, end, data, offsets in slices(texts):
            rows, found = present(data, offsets, self.slot)
            out.append(self.intercept + np.bincount(rows, self.weights[found], end - first) if len(self.weights) else np.full(end - first, self.intercept))
        margin = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def gram_rows(texts: pa.Array) -> np.ndarray:
    """In how many of some texts each bucket occurs."""
    counts = np.zeros(1 << BITS, np.int32)
    for _, _, data, offsets in slices(texts, FIT_BYTES):
        counts += np.bincount(present(data, offsets)[1], minlength=1 << BITS).astype(np.int32)
    return counts


def choose(counts: np.ndarray, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that take part, and the log-count ratio of each. ``counts``: texts with each bucket, of label 0 and of label 1."""
    q, p = counts + 1.0
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    evidence = np.where(p + q - 2 >= LEAST_TEXTS, np.abs(ratio) * np.sqrt(p + q - 2), 0)
    chosen = np.argsort(-evidence, kind="stable")[:kept]
    chosen = np.sort(chosen[evidence[chosen] > 0])
    return chosen, ratio[chosen]


def slots(chosen: np.ndarray) -> np.ndarray:
    slot = np.full(1 << BITS, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    return slot


def fit(rows: np.ndarray, found: np.ndarray, label: np.ndarray, ratio: np.ndarray, penalty: float = 5e-4, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression on the (row, chosen n-gram) pairs, by accelerated gradient steps; the same input gives the same model."""
    rate = (label.sum() + 1) / (len(label) + 2)
    b = last_b = float(np.log(rate / (1 - rate)))
    if not 0 < label.sum() < len(label):
        return np.zeros(len(ratio)), b
    values = ratio[found]
    norm = np.bincount(rows, values**2, len(label)).max() or 1.0
    w, last_w = np.zeros(len(ratio)), np.zeros(len(ratio))
    step = 4.0 / (norm + 1)
    for k in range(steps):
        ahead = k / (k + 3)
        at_w, at_b = w + ahead * (w - last_w), b + ahead * (b - last_b)
        margin = at_b + np.bincount(rows, values * at_w[found], len(label))
        error = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label
        last_w, last_b = w, b
        w = at_w - step * (np.bincount(found, values * error[rows], len(ratio)) + penalty * len(label) * at_w)
        b = at_b - step * error.sum()
    return w * ratio, float(b)


def fold(key: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_ROWS, where: Column | None = None) -> Model:
    """A model from at most ``most`` labelled rows outside fold 0 (or those whose _key meets ``where``)."""
    rows = labelled(docs, labels, label, most=most, where=fold(F.col("_key")) != 0 if where is None else where)
    sample = stored(rows.repartition(SAMPLE_TASKS, F.xxhash64("doc_id")), shared_folder(docs.sparkSession), "sample")
    text_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            own = b.column(2).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                counts[k] += gram_rows(b.column(1).filter(pa.array((own == 1) == k)))
        blocks = counts.reshape(2 << BITS - BLOCK_BITS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int32)
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    kinds = "block long, counts binary"
    blocks = sample.mapInArrow(released(count), kinds).groupBy("block").applyInArrow(add, kinds).orderBy("block").collect()
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.counts, np.int64) for r in blocks)]).reshape(-1, 1 << BITS)
    chosen, ratio = choose(counts) if len(counts) else (np.zeros(0, np.int64), np.zeros(0))
    slot = slots(chosen)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in slices(b.column(1)):
                row, found = present(data, offsets, slot)
                ends = np.searchsorted(row, np.arange(end - first + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), b.column(2).slice(first, end - first), lists], names=["doc_id", "label", "found"])

    kind = sample.schema[0].dataType.simpleString()
    found = sample.mapInArrow(released(find), f"doc_id {kind}, label int, found array<int>").toArrow().sort_by("doc_id").combine_chunks()
    lists = found.column("found").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int32()))
    row = np.repeat(np.arange(found.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)) if found.num_rows else np.zeros(0, np.int64)
    weights, intercept = fit(row, lists.flatten().to_numpy(zero_copy_only=False), (found.column("label").to_numpy() == 1).astype(np.int64), ratio)
    return Model(slot, weights, intercept)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)))], names=[key, "score"])

    text_batches(docs.sparkSession)
    slim = docs.select(named(key).alias(key), named(text).alias("text"))
    return slim.mapInArrow(released(run), f"`{key}` {slim.schema[0].dataType.simpleString()}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
