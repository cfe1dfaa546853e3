"""Language ID by fusing evidence: text, declared markup language, address suffix and host priors.

Each row's text has a likelihood under each language's model of hashed byte n-grams (naive Bayes, from
a bounded sample of rows of each known language). A declared language and a country suffix count with
the trust put in them. The prior comes from the host: grouped sums of the rows' evidence-only
posteriors, without the row's own, smoothed towards the domain's, these towards those of all rows.
Every text is scored once; what is known of it is stored before the priors are.

Defined results: a null text counts as empty; a text without a letter tells nothing, so the other
evidence decides and the row is not kept; a very long text is scored whole, in pieces; a null host is a
host of its own, a null declaration or suffix no evidence; equal posteriors go to the first language by
name; repeated rows are judged each by itself, and count each towards their host; languages with fewer
than LEAST_ROWS rows have no model; without rows of a known language every language is null and nothing
is kept; an empty table gives an empty result; other columns pass through, and ``language``,
``confidence`` and ``kept`` replace columns of these names, however written.
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
from .op10_line_dedup import host as host_of
from .op10_line_dedup import html_lines

ORDER = 3
BITS = 16
#: Rows of each language that the fit reads at most.
TRAIN_ROWS = 750
LEAST_ROWS = 5
#: n-grams that a long text's evidence is scaled down to: they overlap and are not independent.
GRAMS_COUNTED = 120
TRUST_DECLARED = 0.9
TRUST_SUFFIX = 0.7
#: Text bytes whose n-grams the fit holds at a time.
FIT_BYTES = 1 << 20
#: Rows that each level's prior weighs in the level below.
SMOOTHING = 10.0
KEEP_ABOVE = 0.6
#: Country suffixes and their languages.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log probability of each bucket (rows) in each language, float32


def _buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams, and whether each has a letter."""
    n = len(data) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    low, letter = _LOWER[data], _LETTER[data]
    mixed, used = np.zeros(n, np.uint32), np.zeros(n, bool)
    for k in range(ORDER):
        mixed = (mixed ^ low[k : k + n]) * np.uint32(0x85EBCA6B)
        used |= letter[k : k + n]
    return mixed >> np.uint32(32 - BITS), used


def gram_counts(texts: pa.Array) -> np.ndarray:
    """How often each bucket occurs in some texts."""
    counts = np.zeros(1 << BITS, np.int64)
    for _, _, data, _ in slices(texts, FIT_BYTES):
        buckets, used = _buckets(data)
        counts += np.bincount(buckets[used], minlength=1 << BITS)
    return counts


def model_of(counts: dict[str, np.ndarray]) -> Model:
    """The model of the languages with these counts."""
    languages = sorted(counts)
    smoothed = np.stack([counts[x] + 0.5 for x in languages], 1) if languages else np.zeros((1 << BITS, 0))
    return Model(languages, np.log(smoothed / smoothed.sum(0)).astype(np.float32))


def likelihoods(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Scaled log likelihoods (rows x languages) and whether each text has an n-gram with a letter."""
    found, has = [np.zeros((0, len(model.languages)))], [np.zeros(0, bool)]
    for first, end, data, offsets in slices(texts, 1 << 20):
        rows = end - first
        parts = [(data, offsets)]
        if rows == 1:  # a long text goes in pieces, which overlap so that no n-gram is lost
            parts = [(data[a : b + ORDER - 1], np.array([0, min(b + ORDER - 1, len(data)) - a])) for a, b in pieces(data, 1 << 20)]
        out, n = np.zeros((rows, len(model.languages))), np.zeros(rows)
        for part, places in parts:
            buckets, used = _buckets(part)
            starts = np.minimum(places[:-1], len(buckets))
            ends = np.maximum(np.minimum(places[1:] - ORDER + 1, len(buckets)), starts)
            total = np.zeros(len(buckets) + 1)
            np.cumsum(used, out=total[1:])
            n += total[ends] - total[starts]
            for k in range(len(model.languages)):
                np.cumsum(np.where(used, model.table[buckets, k], 0), dtype=np.float64, out=total[1:])
                out[:, k] += total[ends] - total[starts]
        found.append(out * (np.minimum(n, GRAMS_COUNTED) / np.maximum(n, 1))[:, None])
        has.append(n > 0)
    return np.concatenate(found), np.concatenate(has)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", most: int = TRAIN_ROWS) -> Model:
    """A model from at most ``most`` rows of each known language. Counts, not texts, come to the driver: one row a language."""

    def count(table: pa.Table) -> pa.Table:
        counts = gram_counts(table.column("text").combine_chunks())
        return pa.table({"language": table.column("label").slice(0, 1), "n": pa.array([table.num_rows], pa.int64()), "counts": pa.array([counts.tobytes()], pa.binary())})

    rows = labelled(docs, docs, language, key, text, most, kind="string", of_each=True)
    found = rows.groupBy("label").applyInArrow(count, "language string, n long, counts binary").filter(F.col("n") >= LEAST_ROWS).collect()
    return model_of({r.language: np.frombuffer(r.counts, np.int64) for r in found})


def _trusted(value: Column, languages: list[str], trust: float) -> Column:
    """Log likelihoods of a declaration: trust if it names the language, else its share of the rest."""
    others = (1 - trust) / max(len(languages) - 1, 1)
    each = [F.when(value == x, float(np.log(trust))).otherwise(float(np.log(others or 1e-9))) for x in languages]
    return F.when(value.isin(languages), F.array(*each)).otherwise(F.array(*[F.lit(0.0)] * len(languages)))


def _softmax(logs: Column) -> Column:
    powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _sum(*columns: Column) -> Column:
    total = columns[0]
    for x in columns[1:]:
        total = F.zip_with(total, x, lambda a, b: a + b)
    return total


def _less(counts: Column, own: Column) -> Column:
    return F.zip_with(counts, own, lambda c, p: F.greatest(c - p, F.lit(0.0)))


def _smooth(counts: Column, towards: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, towards, lambda c, p: (c + SMOOTHING * p) / (total + SMOOTHING))


def host_counts(rows: DataFrame, n: int) -> tuple[DataFrame, list[float]]:
    """of_host, in_host, in_domain of (_host, _domain, _posterior): sums of the posteriors of a host and of its domain; and those of all rows."""
    hosts = rows.groupBy("_host", "_domain").agg(*(F.sum(F.col("_posterior")[k]).alias(f"c{k}") for k in range(n)))
    hosts = stored(hosts, shared_folder(rows.sparkSession), "hosts")
    pack = lambda: F.array(*(F.coalesce(F.sum(f"c{k}"), F.lit(0.0)) for k in range(n)))
    domains = hosts.groupBy("_domain").agg(pack().alias("in_domain")).withColumnRenamed("_domain", "_of")
    of_all = hosts.agg(pack().alias("of_all")).first()[0]  # one number a language
    found = hosts.join(domains, F.col("_domain").eqNullSafe(F.col("_of")))
    return found.select(F.col("_host").alias("of_host"), F.array(*(F.col(f"c{k}") for k in range(n))).alias("in_host"), "in_domain"), of_all


def identify(rows: DataFrame, model: Model, text: str = "text", host: Column | None = None, declared: Column | None = None, suffix: Column | None = None, keep_above: float = KEEP_ABOVE, columns: list[str] | None = None) -> DataFrame:
    """``rows`` (all columns, or ``columns``) with language, confidence (its posterior) and kept."""
    languages = model.languages
    own = [c for c in columns or rows.columns if c.lower() not in ("language", "confidence", "kept")]
    if not languages:
        return rows.select(*map(named, own), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("kept"))
    # columns go under names of their own, so that no others can clash with what is added
    passed = [f"c{k}" for k in range(len(own))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs, has = likelihoods(model, b.column(b.num_columns - 1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(logs) + 1) * len(languages), pa.int32()), pa.array(logs.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), flat, pa.array(has)], names=[*b.schema.names[:-1], "_likelihoods", "_has"])

    none = F.lit(None).cast("string")
    text_batches(rows.sparkSession)
    slim = rows.select(
        *(named(c).alias(x) for c, x in zip(own, passed, strict=True)), (none if host is None else host).alias("_host"), (none if declared is None else F.lower(declared)).alias("_declared"),
        (none if suffix is None else F.lower(suffix)).alias("_suffix"), named(text).alias("_text"),
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1])
    found = slim.mapInArrow(released(run), f"{kinds}, _likelihoods array<double>, _has boolean")
    by_suffix = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))[F.coalesce("_suffix", F.lit(""))]
    evidence = _sum(F.col("_likelihoods"), _trusted(F.col("_declared"), languages, TRUST_DECLARED), _trusted(by_suffix, languages, TRUST_SUFFIX))
    domain = F.regexp_extract(F.col("_host"), r"([^.]+\.[^.]+)$", 1)
    found = found.select(*passed, "_host", F.when(domain != "", domain).otherwise(F.col("_host")).alias("_domain"), evidence.alias("_evidence"), "_has")
    scored = stored(found, shared_folder(rows.sparkSession), "scored").withColumn("_posterior", _softmax(F.col("_evidence")))

    counts, of_all = host_counts(scored, len(languages))
    counts = stored(counts, shared_folder(rows.sparkSession), "counts")
    judged = scored.join(counts, F.col("_host").eqNullSafe(F.col("of_host")), "left")
    even = F.array(*[F.lit(1.0 / len(languages))] * len(languages))
    less = lambda counts: _less(counts, F.col("_posterior"))
    prior = _smooth(less(F.col("in_host")), _smooth(less(F.col("in_domain")), _smooth(less(F.array(*map(F.lit, of_all))), even)))
    judged = judged.withColumn("_prior", prior)
    posterior = _softmax(F.zip_with("_evidence", "_prior", lambda a, p: a + F.log(p)))
    judged = judged.withColumn("_fused", posterior).withColumn("_most", F.array_max("_fused"))
    name = F.array(*map(F.lit, languages))[(F.array_position("_fused", F.col("_most")) - 1).cast("int")]
    given = [F.col(x).alias(c) for c, x in zip(own, passed, strict=True)]
    return judged.select(*given, name.alias("language"), F.col("_most").alias("confidence"), (F.col("_has") & (F.col("_most") >= keep_above)).alias("kept"))


DECLARED = r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})"


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, language, confidence, kept of (page_id, url, html)."""
    address = host_of(F.col("url"))
    rows = pages.select("page_id", address.alias("_address"), F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1).alias("_lang"), html_lines(F.col("html")).alias("_body"))
    suffix = F.regexp_extract(F.col("_address"), r"\.([a-z]+)(?::\d+)?$", 1)
    return identify(rows, model, "_body", F.col("_address"), F.col("_lang"), suffix, columns=["page_id"])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables with texts: documents, whose host is their source, and pages with markup and addresses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    of_docs = identify(docs, model, host=F.col("source"), columns=["doc_id"])
    of_pages = identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)
    result = ["language", "confidence", "kept"]
    none = F.lit(None).cast("long")
    return of_docs.select("doc_id", none.alias("page_id"), *result).unionAll(of_pages.select(none.alias("doc_id"), "page_id", *result))


QUERIES = {"op6_language_id": op6_language_id}
ORACLE_SQL: dict[str, str] = {}
