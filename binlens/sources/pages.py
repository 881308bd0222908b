"""Listing pages (A13, A14): anchors of stored HTML as (page_id, pos, name, href, abs_url).

The reference scraped live result cards with a browser; here the pages are already stored, so
the scrape is a batch job: regex extraction per page, then "last duplicate name wins" as a
grouped ``max_by`` per (page, name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANCHOR = r'<a href="([^"]*)"[^>]*>([^<]*)</a>'


def anchors(pages: DataFrame) -> DataFrame:
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(ANCHOR), 1)
    names = F.regexp_extract_all(F.col("html"), F.lit(ANCHOR), 2)
    return (pages.select("page_id", "url", F.posexplode(F.arrays_zip(hrefs.alias("href"), names.alias("name"))).alias("pos", "a"))
            .select("page_id", "url", F.col("pos").cast("int").alias("pos"), F.col("a.name").alias("name"), F.col("a.href").alias("href")))


def absolute_url(url, href):
    """Site origin + href for site-relative links; other hrefs unchanged."""
    origin = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    return F.when(href.startswith("/"), F.concat(origin, href)).otherwise(href)


def page_links(pages: DataFrame) -> DataFrame:
    """One link per (page, name): the last occurrence on the page wins."""
    a = anchors(pages)
    last = a.groupBy("page_id", "name").agg(F.max_by(F.struct("pos", "href", "url"), "pos").alias("l"))
    return last.select("page_id", "name", F.col("l.pos").alias("pos"), F.col("l.href").alias("href"),
                       absolute_url(F.col("l.url"), F.col("l.href")).alias("abs_url"))
