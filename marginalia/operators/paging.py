"""Pages and ranges: global row numbers without a global sort task, sitemaps, visible rows, committed prefixes, byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[Column], block: Column) -> DataFrame:
    """df with `row` from 1 on. block never falls along the order: rows are ranked within a block, and only the counts of
    blocks go through one task."""
    marked = df.withColumn("_block", block)
    counts = marked.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_block", before.alias("_before"))
    ranked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy("_block").orderBy(*order)))
    return ranked.join(starts, "_block").withColumn("row", F.col("_before") + F.col("_rank")).drop("_block", "_before", "_rank")


#: The sitemap format.
SITEMAP_HEAD, SITEMAP_TAIL = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>"


def sitemap_pages(df: DataFrame, ident: str, changed: str, block: Column, base: str, size: int = 5000) -> DataFrame:
    """(page, n, xml): public rows by id, so many a page; ids of other than letters, digits, - and _ are an error."""
    name = F.col(ident).cast("string")
    safe = F.when(name.rlike("^[A-Za-z0-9_-]{1,200}$"), name).otherwise(F.raise_error(F.concat(F.lit("invalid sitemap row "), name)))
    when = F.date_format(F.col(changed).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    url = F.concat(F.lit(f"<url><loc>{base}"), safe, F.lit("</loc><lastmod>"), when, F.lit("</lastmod></url>"))
    rows = numbered(df.select(ident, url.alias("_url"), block.alias("_by")), [F.col(ident)], F.col("_by"))
    paged = rows.groupBy(F.floor((F.col("row") - 1) / size).alias("_p")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("row", "_url"))).alias("_urls"))
    body = F.array_join(F.transform("_urls", lambda u: u["_url"]), "")
    return paged.select((F.col("_p") + 1).alias("page"), "n", F.concat(F.lit(SITEMAP_HEAD), body, F.lit(SITEMAP_TAIL)).alias("xml"))


def visible_rows(offset: Column, loaded: Column, height: int = 174, window: int = 36, overscan: int = 8) -> Column:
    """struct(start, end): the rows to draw at a scroll offset, some before the first visible one; empty without rows."""
    first = F.greatest(F.lit(0).cast("long"), F.least(loaded - 1, F.floor(F.greatest(F.lit(0), offset) / height) - overscan))
    return F.struct(F.when(loaded > 0, first).otherwise(0).alias("start"), F.when(loaded > 0, F.least(loaded, first + window)).otherwise(0).alias("end"))


def committed_prefix(pages: DataFrame, by: str, offset: str, ok: str) -> DataFrame:
    """Pages before the first failed offset of each request: a page that came while an earlier one failed is not shown."""
    failed = pages.where(~F.coalesce(F.col(ok), F.lit(False))).groupBy(by).agg(F.min(offset).alias("_failed"))
    return pages.join(failed, by, "left").where(F.col("_failed").isNull() | (F.col(offset) < F.col("_failed"))).drop("_failed")


def next_range(next_byte: Column, length: Column, chunk: int = 8 * 1024 * 1024) -> Column:
    """struct(start, end), end included: the range after a checkpoint, null when the whole is there; a checkpoint outside is an error."""
    bad = F.raise_error(F.concat(F.lit("invalid checkpoint "), next_byte.cast("string")))
    checked = F.when(next_byte.between(0, length), next_byte).otherwise(bad.cast("long"))
    return F.when(checked < length, F.struct(checked.alias("start"), (F.least(length, checked + chunk) - 1).alias("end")))


def phrase_anchor(sizes: Column, candidates: Column, many: int = 2000, most: int = 160 * 1024 * 1024) -> Column:
    """struct(anchor, more): the index of the smallest posting, the first of equals, and whether the next smallest is worth
    reading: with many candidates and a size within bounds."""
    anchor = F.array_position(sizes, F.array_min(sizes)) - 1
    second = F.element_at(F.array_sort(sizes), 2)
    return F.struct(anchor.alias("anchor"), F.coalesce((F.size(sizes) > 1) & (candidates > many) & (second <= most), F.lit(False)).alias("more"))
