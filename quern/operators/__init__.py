"""DataFrame helpers for what SQL cannot spell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_column(df: DataFrame, column: str, other: DataFrame, values: str, negated: bool = False) -> DataFrame:
    """Rows whose ``column`` is (not) among ``values`` of the whole other table; null is never among them."""
    keys = other.select(F.col(values).alias("_in")).dropna().distinct()
    return df.join(keys, F.col(column) == F.col("_in"), "left_anti" if negated else "left_semi")


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key. Spark keeps only k rows a key and task before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Each left row with ``columns`` of the latest right row of its keys at or before its time (null if none).

    Both sides are put in one sorted stream per key, so no pair of rows is formed.
    """
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_value"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*columns).alias("_value"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_last", F.last("_value", True).over(w)).filter("_side = 1").select("_row.*", "_last.*")


def lateral_json(df: DataFrame, column: str, alias: str = "j") -> DataFrame:
    """A row for each member of a JSON object in ``column``: ``<alias>_key`` and ``<alias>_value`` (text); none for null, broken text and arrays."""
    return df.select("*", F.explode(F.from_json(column, "map<string,string>")).alias(f"{alias}_key", f"{alias}_value"))
