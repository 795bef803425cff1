"""Operator 7: line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it, divided by the number of
the host's pages; lines whose ratio exceeds ``ratio`` are boilerplate and are dropped from every page of the host. A
line of a single page repeats nothing, so ``least_pages`` is two; otherwise every line of a small host would go. Lines are compared by their whole content (MD5); blank lines (blanks
only) are neither counted nor dropped.

The lines to drop are few for a host whatever its size: their ratios sum to its mean number of distinct lines a page
at most, so there are at most that number / ``ratio`` of them. The array of a host's lines is joined to its pages, by
broadcast only where all hosts' lines together are below ``broadcast_lines``, else by a shuffle that adaptive
execution splits where a host is large.

Defined cases: a null host is one host of its own; null texts stay null and contain no line, but count as pages; empty
texts stay empty; repeated rows are pages each; an empty table gives no rows; further columns are kept as they are, but
for columns named like the report's, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


@dataclass(frozen=True)
class LineConfig:
    ratio: float = 0.1
    least_pages: int = 2
    broadcast_lines: int = 100_000


def _lines(text):
    return F.split(text, "\n", -1)


def _key(line):
    return F.unhex(F.md5(line.cast("binary")))


def _blank(line):
    return F.trim(line) == ""


def boilerplate(pages: DataFrame, host: str = "source", cfg: LineConfig = LineConfig()) -> DataFrame:
    """(host, line, pages, total): the lines to drop, by their keys."""
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), _key))
    each = pages.select(F.col(host).alias("host"), F.explode(keys).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= cfg.least_pages)
    # One row for each host, and few lines on several pages: the totals are joined to the counts, not to the lines.
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("total"))
    joined = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return joined.where(F.col("pages") > F.lit(cfg.ratio) * F.col("total")).select("c.host", "line", "pages", "total")


def strip_lines(pages: DataFrame, host: str = "source", cfg: LineConfig = LineConfig(), report: bool = True) -> DataFrame:
    """The pages with boilerplate lines left out of text; with report, n_lines and n_dropped besides."""
    lines = stash(boilerplate(pages, host, cfg), "boilerplate")
    by_host = lines.groupBy(F.col("host").alias("__host")).agg(F.collect_list("line").alias("__drop"))
    if lines.count() <= cfg.broadcast_lines:
        by_host = F.broadcast(by_host)
    joined = pages.join(by_host, pages[host].eqNullSafe(F.col("__host")), "left")
    all_lines = _lines(F.col("text"))
    stay = F.when(F.col("__drop").isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: _blank(x) | ~F.array_contains(F.col("__drop"), _key(x))))
    out = joined.withColumn("__stay", stay)
    text = F.when(F.col("text").isNotNull(), F.array_join("__stay", "\n"))
    made = ("n_lines", "n_dropped") if report else ()
    kept = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in pages.columns if c not in made]
    if not report:
        return out.select(*kept)
    n = F.coalesce(F.size(all_lines), F.lit(0)).cast("long")
    left = F.coalesce(F.size("__stay"), F.lit(0)).cast("long")
    return out.select(*kept, n.alias("n_lines"), (n - left).alias("n_dropped"))


def clean_lines(documents: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """op7: the cleaned text of every document, the source being the host."""
    return strip_lines(documents.select("doc_id", "source", "text"), "source", cfg).select("doc_id", "source", "n_lines", "n_dropped", "text")


ORACLE = """
WITH l AS (
  SELECT doc_id, source, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents
), c AS (
  SELECT source, line, count(*) AS pages FROM (SELECT source, unnest(list_distinct(ls)) AS line FROM l) GROUP BY ALL
), t AS (SELECT source, count(*) AS total FROM documents GROUP BY ALL),
d AS (
  SELECT c.source, list(line) AS drops FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
  WHERE pages >= 2 AND pages > 0.1e0 * total GROUP BY ALL
), s AS (
  SELECT l.doc_id, l.source, l.text, string_split(text, chr(10)) AS al, d.drops,
    list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(coalesce(d.drops, []), x)) AS stay
  FROM l LEFT JOIN d ON l.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, source, CAST(coalesce(len(al), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(al) - len(stay), 0) AS BIGINT) AS n_dropped,
  CASE WHEN text IS NOT NULL THEN array_to_string(stay, chr(10)) END AS text
FROM s
"""
