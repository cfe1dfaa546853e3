"""The corpus pipeline: documents in, token ids of a deduplicated, mixed training corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined results: null and empty texts, and texts without a letter, have no certain language and go in the
first stage; very long texts are handled whole by each stage; where documents repeat a key, rows of that key
share the decisions of the near-duplicate and mixture stages (of equal sets of shingles the least key stays, a
row without a key is never named by another); a null source is a source of its own; nulls in other columns pass
through; extra columns pass through under any names, up to the last stage; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import op1_mixture, op5_jaccard_join, op6_language_id, op8_byte_bpe, op10_line_dedup
from quern.llm._store import discard, made, named, shared_folder, spare, stored

#: Intermediate tables of the last stage.
_tables: list[str] = []


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage``, removing the intermediate tables of the stage before, unless ``docs`` still reads them."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _tables else []
        for folder in _tables:
            name = folder.rsplit("/", 1)[-1]
            if not any(name in x for x in files):
                discard(spark, folder)
        before = made(spark)
        result = stage(spark, docs, sf_dir)
        _tables[:] = [x for x in made(spark) if x not in before]
        return result

    return run


#: A line in more than this share of a source's distinct documents is boilerplate.
LINE_RATIO = 0.1


@_tidy
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not certain; the source is the host."""
    judged = op6_language_id.identify(docs, op6_language_id.train(docs), host=F.col("source"))
    return judged.filter("kept").select(*map(named, docs.columns))


@_tidy
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are boilerplate of their source; counts the letters left. Copies, and documents of nothing else, are left to the next stage."""
    cleaned = op10_line_dedup.without_boilerplate(docs, "source", ratio=LINE_RATIO, spare_copies=True)
    letters = F.when(F.col("_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", letters).select(*map(named, docs.columns))


@_tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of each component that names it."""
    found = op5_jaccard_join.near_duplicates(docs)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    gone = stored(gone, shared_folder(spark), "gone")
    key, = spare(docs.columns, "_gone")
    return docs.join(gone.withColumnRenamed("doc_id", key), F.col("doc_id") == F.col(key), "left_anti")


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the mix does not take, repeats those it takes twice, in the order of training."""
    mixed = op1_mixture.curriculum(docs).filter("taken > 0")
    passes = F.when(F.col("again_at").isNull(), F.array("position")).otherwise(F.array("position", "again_at"))
    key, laps, at = spare(docs.columns, "_key", "_passes", "_at")
    mixed = mixed.groupBy(F.col("doc_id").alias(key)).agg(F.first(passes).alias(laps))
    mixed = stored(mixed, shared_folder(spark), "mixed")
    rows = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col(key)))
    return rows.withColumn(at, F.explode(laps)).orderBy(at, "doc_id").select(*map(named, docs.columns))


@_tidy
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and their digests, for each training pass of a document."""
    return op8_byte_bpe.encode_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("byte_bpe", encode),
]

#: Language ID, near duplicates and encoding cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of ``sf_dir``."""
    folder = shared_folder(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
        if last:
            discard(spark, f"{folder}/{last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
