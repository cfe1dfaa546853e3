"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Every source has a weight and a schedule: a piecewise linear weight over training time 0..1, whose
integral gives the source's share. The integrated schedule is the source's cumulative token demand; a
document that starts after ``c`` words of its source's stream is due when the demand reaches ``c``,
which is found by inverting the integral in closed form. A last range sort by that position gives the
training order.

Prefix sums within a source are taken in two levels (buckets of the shuffled order, then rows of a
bucket), with about as many buckets as buckets have rows, so a source of any size is spread over tasks.

Defined results: null text or size counts 0 words; a very long text counts whole, and is taken in part where
its source's target ends; a null source is a source of its own, last in order; rows that repeat a key are separate
documents, and equal rows share the order's ties without changing the result; an empty table gives an empty result;
other columns are not read, so their names may be any. The document at which a source's target ends is taken in part,
so takes add up to the target rounded to words. Sources are ranked in one task, one row each.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import named, shared_folder, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
#: Knots (time, relative weight) of the schedules, dealt to the sources in turn: rising, even, falling.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_turn(values: list[Column], place: Column) -> Column:
    """values[(place - 1) mod n]; place counts from 1."""
    return F.array(*values)[((place - 1) % len(values)).cast("int")]


def integrated(knots: tuple[tuple[float, float], ...]) -> Column:
    """The schedule's pieces: start, weight there, slope, integral up to there, integral in all."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        if t1 <= t0 or min(w0, w1) < 0:
            raise ValueError("knots need rising times and weights of 0 or more")
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), total))
        total += (w0 + w1) / 2 * (t1 - t0)
    if knots[0][0] != 0 or knots[-1][0] != 1 or total <= 0:
        raise ValueError("a schedule goes from time 0 to time 1 and weighs something")
    return F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip((*p, total), ("t", "w", "slope", "sum", "total"), strict=True))) for p in pieces))


def inverted(pieces: Column, part: Column) -> Column:
    """The time at which the integrated schedule reaches ``part`` (0..1) of its total."""
    due = part * pieces[0]["total"]
    piece = F.element_at(F.filter(pieces, lambda p: p["sum"] <= due), -1)
    rest = due - piece["sum"]
    below = piece["w"] + F.sqrt(F.greatest(piece["w"] * piece["w"] + 2 * piece["slope"] * rest, F.lit(0.0)))
    return F.when(below > 0, piece["t"] + 2 * rest / below).otherwise(piece["t"])


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """source, place, source_size, target of each source of (source, size): one row each.

    The share of all words is split by weight; no target exceeds ``most`` times its source, and what is
    over goes to the others by weight. Sources are ordered by most / weight: the first of them that stay
    below their bound leave all later ones below theirs, so the bound ones form a prefix.
    """
    every = Window.partitionBy()
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    sources = sources.withColumn("weight", in_turn([F.lit(float(w)) for w in weights], F.col("place")))
    bound = F.col("source_size") * float(most)
    by_need = Window.orderBy(bound / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.coalesce(F.sum(x).over(by_need), F.lit(0.0))
    sources = sources.select(
        "*",
        bound.alias("bound"),
        (F.sum("source_size").over(every) * share - before(bound)).alias("words_left"),
        (F.sum("weight").over(every) - before(F.col("weight"))).alias("weight_left"),
    )
    sources = sources.withColumn("full", F.col("words_left") * F.col("weight") >= F.col("bound") * F.col("weight_left"))
    free = lambda x: F.max(F.when(~F.col("full"), F.col(x))).over(every)
    target = F.when(F.col("full"), F.col("bound")).otherwise(F.col("weight") * free("words_left") / free("weight_left"))
    return sources.select("source", "place", "source_size", target.alias("target"))


def curriculum(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_PASSES,
    schedules: tuple = SCHEDULES,
) -> DataFrame:
    """key, size, source_size, target, taken, position, again_at: every row, in training order.

    ``size``: words of a row (of the column ``text`` if not given). ``position``: time (0..1) of the
    first pass, ``again_at`` of the second, null where the pass takes nothing of the row. Rows that are not taken come last.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    if most > 2:
        raise ValueError("a document has two positions, so a source is passed twice at most")
    spread = F.md5(F.coalesce(named(key).cast("string"), F.lit("")))
    sized = docs.select(named(key).alias("key"), named(source).alias("source"), (word_count(F.col("text")) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"), spread.alias("spread"))
    sized = stored(sized, folder, "sized")
    sources = stored(source_targets(sized, weights, share, most), folder, "sources")

    buckets = isqrt(sized.count()) + 1
    bucket = F.floor(F.conv(F.substring("spread", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).alias("bucket")
    placed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("key", "size", "spread", "place", "source_size", "target", bucket)
    sums = placed.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    row = Window.partitionBy("place", "bucket").orderBy("spread", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.join(sums, ["place", "bucket"]).withColumn("start", F.col("base") + F.sum("size").over(row) - F.col("size"))

    due = F.floor(F.col("target") + 0.5).cast("long")

    def part(lap: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), due - F.col("source_size") * lap - F.col("start")))

    laps = range(max(2, -int(-most // 1)))
    pieces = in_turn([integrated(x) for x in schedules], F.col("place"))
    when = lambda lap: F.when(part(lap) > 0, inverted(pieces, (F.col("start") + F.col("source_size") * lap) / F.col("target")))
    order = F.coalesce(when(0), 1 + F.col("start") / F.greatest(F.col("source_size"), F.lit(1)))
    mixed = placed.select(
        F.col("key").alias(key), "size", "source_size", "target", sum((part(lap) for lap in laps[1:]), part(0)).alias("taken"),
        when(0).alias("position"), when(1).alias("again_at"), order.alias("_order"), F.col("spread").alias("_spread"),
    )
    return mixed.orderBy("_order", "_spread").drop("_order", "_spread")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS spread
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS bound FROM sources),
rests AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(bound) OVER w, 0) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left
  FROM weighed WINDOW w AS (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, words_left * weight >= bound * weight_left AS is_full FROM rests),
targets AS (
  SELECT *, CASE WHEN is_full THEN bound ELSE weight * max(words_left) FILTER (WHERE NOT is_full) OVER ()
                 / max(weight_left) FILTER (WHERE NOT is_full) OVER () END AS target FROM capped),
placed AS (
  SELECT s.doc_id, s.size, t.place, t.source_size, t.target, floor(t.target + 0.5::DOUBLE)::BIGINT AS due,
         (sum(s.size) OVER (PARTITION BY t.place ORDER BY s.spread, s.doc_id, s.size ROWS UNBOUNDED PRECEDING))::BIGINT - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
parts AS (
  SELECT *, greatest(0, least(size, due - start)) AS p0, greatest(0, least(size, due - source_size - start)) AS p1,
         CASE (place - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS w,
         CASE (place - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS slope,
         start / target AS u0, (start + source_size) / target AS u1
  FROM placed)
SELECT doc_id, size, source_size, target, (p0 + p1)::BIGINT AS taken,
       CASE WHEN p0 > 0 THEN 2 * u0 / (w + sqrt(greatest(w * w + 2 * slope * u0, 0))) END AS position,
       CASE WHEN p1 > 0 THEN 2 * u1 / (w + sqrt(greatest(w * w + 2 * slope * u1, 0))) END AS again_at
FROM parts
"""

QUERIES = {"op1_mixture": op1_mixture}
ORACLE_SQL = {"op1_mixture": SQL}
