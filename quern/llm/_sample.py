"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import named


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", most: int = 4000, where: Column | None = None, kind: str = "int", of_each: bool = False) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled rows (of each label, if ``of_each``), those whose keys have the smallest MD5.

    A key with several labels counts with the largest, so as 1 if any is 1; rows without key or label are left out, and rows
    that repeat a key count once, with the largest text. Only the chosen keys, whose number is bounded, are sent to the scan
    of the texts. ``where`` is a condition on the key, named _key. A first cut by the digest leaves about three times as many
    rows as are wanted (four times at most where there are few), whatever the number of labelled rows.
    """
    picked = labels.select(named(key).alias("_key"), named(label).cast(kind).alias("_label")).dropna()
    if where is not None:
        picked = picked.filter(where)
    picked = picked.groupBy("_key").agg(F.max("_label").alias("_label"))
    # more than enough of the smallest, so that few rows have to be put in order
    digest = F.md5(F.col("_key").cast("string"))
    part = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / (1 << 32)
    if of_each:
        sizes = picked.groupBy("_label").agg(F.count("*").alias("_rows"))
        picked = picked.join(sizes, "_label").filter((F.col("_rows") <= 4 * most) | (part * F.col("_rows") < 3 * most))
        place = F.row_number().over(Window.partitionBy("_label").orderBy(digest, "_key"))
        picked = picked.withColumn("_place", place).filter(F.col("_place") <= most).select("_key", "_label")
    else:
        n = picked.count()
        picked = (picked if n <= 4 * most else picked.filter(part * n < 3 * most)).orderBy(digest, "_key").limit(most)
    rows = docs.select(named(key).alias("_key"), named(text).alias("_text")).join(F.broadcast(picked), "_key")
    rows = rows.groupBy("_key", "_label").agg(F.max(F.coalesce("_text", F.lit(""))).alias("_text"))
    return rows.select(F.col("_key").alias("doc_id"), F.col("_text").alias("text"), F.col("_label").alias("label"))
