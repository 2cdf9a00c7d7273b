"""Boilerplate lines by their frequency within a site. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _key(line):
    """128 bits of a trimmed line."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def _trim(line):
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(docs: DataFrame, text_col: str, host_col: str, max_ratio: float, min_pages: int, max_hosts: int) -> DataFrame:
    """(host, lines): digests of the lines that exceed the ratio, one row a host.

    A line is on more than max_ratio of a host's pages, so a host has fewer such
    lines than its mean number of lines a page divided by max_ratio: the array is
    bounded by that, whatever the host's size.
    """
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), _trim), lambda x: x != "")
    pages = docs.select(F.col(host_col).alias("host"), F.array_distinct(F.transform(lines, _key)).alias("keys"))
    totals = settle(pages.groupBy("host").agg(F.count("*").alias("pages")))
    counts = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = _by_host(counts, totals, "host", "key", max_hosts).where(F.col("n") > max_ratio * F.col("pages"))
    return often.groupBy("host").agg(F.array_sort(F.collect_list("key")).alias("lines"))


def _by_host(rows: DataFrame, per_host: DataFrame, host: str, salt_of, max_rows: int, salts: int = 64) -> DataFrame:
    """rows with what per_host (one row a host) has for their host, nulls included. per_host is
    broadcast if counted at max_rows or fewer; else hosts are dealt over `salts` keys."""
    same = F.col(f"r.{host}").eqNullSafe(F.col(f"h.{host}"))
    others = [F.col(f"h.{c}") for c in per_host.columns if c != host]
    if per_host.count() <= max_rows:
        return rows.alias("r").join(F.broadcast(per_host.alias("h")), same).select("r.*", *others)
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"))
    each = per_host.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.alias("r").join(each.alias("h"), same & (F.col("r.__deal") == F.col("h.__deal"))).select(*[F.col(f"r.{c}") for c in rows.columns], *others)


def drop_boilerplate(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    max_ratio: float = 0.05,
    min_pages: int = 3,
    keep_pages: bool = False,
    broadcast_lines: int = 500_000,
    max_hosts: int = 1_000_000,
    salts: int = 64,
) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and n_lines, n_dropped (long).

    Lines end at a line feed and are compared without spaces, tabs and carriage
    returns at their ends. A line is dropped if more than max_ratio of its host's
    pages (rows), and at least min_pages, have it (of a host of one or two pages
    a ratio says nothing). Blank lines are never dropped. With keep_pages, a page on
    which every line that isn't blank would go keeps them all. A null text stays
    null with no lines, an empty one is one blank line, texts of any length count as
    a whole; rows with a null host form a host of their own; repeated rows are pages
    of their own. An empty table gives no rows. Columns named n_lines or n_dropped
    are replaced.

    Only digests of lines are shuffled, never texts, unless the host table is
    too large to broadcast; then hosts are dealt over `salts` keys.
    """
    often = settle(boilerplate(docs, text_col, host_col, max_ratio, min_pages, max_hosts))
    host, salt, drop, kept, own, met = ("__line_host", "__line_salt", "__line_drop", "__line_kept", "__line_all", "__line_met")
    often = often.select(F.col("host").alias(host), F.col("lines").alias(drop))
    same = F.col(host_col).eqNullSafe(F.col(host))
    small = (often.agg(F.sum(F.size(drop))).first()[0] or 0) <= broadcast_lines
    if small:
        joined = docs.join(F.broadcast(often), same, "left")
    else:
        often = often.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = docs.withColumn("__line_deal", F.pmod(F.xxhash64(F.col(text_col)), F.lit(salts)).cast("int"))
        joined = dealt.join(often, same & (F.coalesce("__line_deal", F.lit(0)) == F.col(salt)), "left").drop("__line_deal", salt)
    lines = F.split(F.col(text_col), "\n")
    joined = joined.withColumn(own, lines)
    # the page's lines that may go, by half of the digest: a hash lookup, so that a host's list is not searched for each line
    joined = joined.withColumn(met, F.array_intersect(F.transform(own, lambda x: F.xxhash64(_trim(x))), F.transform(drop, lambda k: k["h1"])))
    stays = F.filter(own, lambda x: (_trim(x) == "") | ~F.array_contains(F.col(met), F.xxhash64(_trim(x))) | ~F.array_contains(F.col(drop), _key(_trim(x))))
    joined = joined.withColumn(kept, F.when(F.coalesce(F.size(met), F.lit(0)) < 1, F.col(own)).otherwise(stays))
    if keep_pages:
        joined = joined.withColumn(kept, F.when(F.exists(kept, lambda x: _trim(x) != ""), F.col(kept)).otherwise(F.col(own)))
    text = F.when(F.size(kept) == F.size(own), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumns(
        {
            text_col: F.when(F.col(text_col).isNotNull(), text),
            "n_lines": F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(own)), F.lit(0)).cast("long"),
            "n_dropped": F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(own) - F.size(kept)), F.lit(0)).cast("long"),
        }
    )
    return out.drop(host, drop, kept, own, met)


#: The same in SQL, over documents.
ORACLE = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
k AS (SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))) AS line FROM d),
n AS (SELECT source, line, count(*) AS n FROM k GROUP BY ALL HAVING count(*) >= 3),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (SELECT n.source, list(line) AS often FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source WHERE n > 0.05e0 * pages GROUP BY n.source),
j AS (SELECT d.*, list_filter(lines, lambda x: trim(x, ' ' || chr(9) || chr(13)) = '' OR NOT list_contains(coalesce(often, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source),
r AS (SELECT doc_id, text, lines, kept FROM j)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
  coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped
FROM r
"""
