"""Line dedup by site-relative frequency.

Rows are grouped by site; the rows that have a line are divided by the site's rows, and lines above
the boilerplate ratio go. Only those lines travel back to the rows: a site has at most (mean lines of
a row / ratio) of them, however many rows it has.

Defined results: rows of a null site form one site; a null text stays null and has no lines; lines
are compared by a 64-bit hash without the spaces around them, and blank lines are never counted or dropped; a line that
a row repeats counts once for it and goes with all its repetitions; a line whose share is just the ratio stays, and so
does a line on fewer than ``least_rows`` rows of its site, whatever the ratio; very long
texts are read whole; repeated rows count each; an empty table gives an empty result. Other columns pass through under
any names; ``_lines`` and ``_dropped`` replace columns of these names, however written. With
``spare_copies``, rows of a site that have the same lines count as one row, also towards ``least_rows``,
and a row of nothing but boilerplate keeps its text, so that no text is dropped whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import named, shared_folder, spare, stored

#: Menu and ad lines of real hosts are on fewer pages than half.
RATIO = 0.1
#: A line has to be on this many rows of a site to be boilerplate.
LEAST_ROWS = 2


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(rows: DataFrame, site: str, text: str, ratio: float = RATIO, least_rows: int = LEAST_ROWS, spare_copies: bool = False) -> DataFrame:
    """site, lines array<long>: the hashes of each site's lines above the ratio; sites without one are left out."""
    lines = F.array_distinct(F.transform(F.filter(F.split(named(text), "\n"), lambda x: F.trim(x) != ""), _key))
    counted = rows.select(named(site).alias("site"), lines.alias("lines"))
    if spare_copies:
        counted = counted.distinct()
    seen = counted.select("site", F.explode("lines").alias("line")).groupBy("site", "line").agg(F.count("*").alias("n"))
    seen = seen.filter(F.col("n") >= least_rows)
    sites = counted.groupBy("site").agg(F.count("*").alias("rows"))
    often = seen.join(sites, seen["site"].eqNullSafe(sites["site"])).filter(F.col("n") > ratio * F.col("rows"))
    return often.groupBy(seen["site"]).agg(F.collect_list("line").alias("lines"))


def without_boilerplate(rows: DataFrame, site: str, text: str = "text", ratio: float = RATIO, least_rows: int = LEAST_ROWS, spare_copies: bool = False) -> DataFrame:
    """``rows`` with the text rid of its site's boilerplate, and ``_lines`` and ``_dropped`` counts (long) after it."""
    found = stored(boilerplate(rows, site, text, ratio, least_rows, spare_copies), shared_folder(rows.sparkSession), "boilerplate")
    of_site, bad_lines = spare(rows.columns, "_site", "_found")
    found = found.select(F.col("site").alias(of_site), F.col("lines").alias(bad_lines))
    whole, bad = named(text), named(bad_lines)
    lines = F.split(whole, "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(bad, _key(x)))
    filled = lambda xs: F.coalesce(F.size(F.filter(xs, lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
    n = F.when(whole.isNull(), F.lit(0).cast("long")).otherwise(filled(lines))
    dropped = F.when(bad.isNull() | whole.isNull(), F.lit(0).cast("long")).otherwise(filled(lines) - filled(kept))
    if spare_copies:
        dropped = F.when(dropped < n, dropped).otherwise(F.lit(0).cast("long"))
    joined = rows.join(found, named(site).eqNullSafe(named(of_site)), "left")
    own = [c for c in rows.columns if c.lower() not in ("_lines", "_dropped")]
    columns = [F.when(dropped > 0, F.array_join(kept, "\n")).otherwise(whole).alias(text) if c == text else named(c).alias(c) for c in own]
    return joined.select(*columns, n.alias("_lines"), dropped.alias("_dropped"))


#: Patterns that RE2 and Java read alike.
UNSEEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BLOCK = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|nav|section|header|footer|title|head|body|html|main|aside)\b[^>]*>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def html_lines(html: Column) -> Column:
    """The text of a page, with a line for each block."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), BLOCK, "\n"), TAG, " ")
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.regexp_replace(text, r" ?\n[ \n]*", "\n")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = stored(pages.select("page_id", host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text")), shared_folder(spark), "texts")
    cleaned = without_boilerplate(texts, "host")
    return cleaned.select("page_id", "host", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), "text")


SQL = rf"""
WITH t AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '{UNSEEN}', ' ', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', ' ', 'g'), '[ \t\r\f]+', ' ', 'g'),
      ' ?\n ?', chr(10), 'g'), '\n+', chr(10), 'g') AS text
  FROM pages),
lines AS (SELECT host, page_id, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS line FROM t),
sites AS (SELECT host, count(*) AS n FROM t GROUP BY host),
bad AS (
  SELECT host, list(line) AS bad FROM (
    SELECT host, line FROM lines JOIN sites USING (host) GROUP BY host, line, n HAVING count(*) > {RATIO} * n AND count(*) >= {LEAST_ROWS}) GROUP BY host),
split AS (
  SELECT page_id, host, text, string_split(text, chr(10)) AS ls,
    list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(coalesce(bad, []), trim(x))) AS kept
  FROM t LEFT JOIN bad USING (host)),
counted AS (SELECT *, coalesce(len(list_filter(ls, lambda x: trim(x) <> '')), 0)::BIGINT AS n, coalesce(len(list_filter(kept, lambda x: trim(x) <> '')), 0)::BIGINT AS k FROM split)
SELECT page_id, host, n AS n_lines, n - k AS n_dropped, CASE WHEN n > k THEN array_to_string(kept, chr(10)) ELSE text END AS text FROM counted
"""

QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE_SQL = {"op10_line_dedup": SQL}
