"""Line de-duplication relative to the site: lines on a large share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargohold.llm.common import staged
from cargohold.llm.url_filter import host_of

#: A line goes if it is on more than RATIO of its host's pages, and on MIN_PAGES or more.
RATIO, MIN_PAGES = 0.1, 5
#: Parts into which each host's pages are dealt for the lookup of its lines.
PARTS = 64
_HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_BREAK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
_TAG = r"<[^>]*>"
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def tidy(line: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def html_lines(html: Column) -> Column:
    """The lines of a page: its text between block elements, in order, without empty ones."""
    text = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _HIDDEN, ""), _BREAK, "\n"), _TAG, "")
    for reference, char in _REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(char))
    return F.array_remove(F.transform(F.split(text, "\n"), tidy), "")


def text_lines(text: Column) -> Column:
    return F.array_remove(F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), tidy), "")


def without_site_lines(rows: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped and text of (page_id, host, lines) rows.

    A line counts once for a page. A host has at most (lines of a mean page) / ratio boilerplate lines, so they travel
    as one array; each host's pages are dealt over PARTS parts for this join, and counting adds up in the map tasks, so
    that a host with a third of all pages is not one task. Lines are known by their 64-bit hash.
    """
    hashed = F.transform("lines", lambda x: F.xxhash64(x))
    rows = staged(rows.select("page_id", "host", "lines", hashed.alias("hashes")), "lines")
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    seen = rows.select("host", F.explode(F.array_distinct("hashes")).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    gone = seen.join(totals, "host").filter(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("h").alias("gone"))
    gone = staged(gone, "site-lines").select("host", "gone", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    part = F.pmod(F.xxhash64("hashes", "page_id"), F.lit(PARTS)).cast("int")
    found = rows.withColumn("part", part).join(gone, ["host", "part"], "left")
    stays = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", F.get("hashes", i))))
    found = found.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), stays.alias("kept"))
    return found.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def page_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """`without_site_lines` over web pages.

    A null or odd url has the empty host, which is a site like others. Null html has no lines and an empty text, but
    its page counts. Repeated rows are pages of their own; other columns are ignored.
    """
    return without_site_lines(pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), html_lines(F.col(html_col)).alias("lines")), **options)
