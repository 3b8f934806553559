"""Line dedup by site-relative frequency.

A line of a page is boilerplate if more than ``ratio`` of the pages of its host hold it (and at least
``least`` of them do: with one page alone there is nothing to compare). Boilerplate lines are dropped from every page of the host.

Distinct lines are counted per host with map-side combine; a host's boilerplate is a short list, at most
(mean distinct lines of its pages) / ``ratio`` of them, so it joins the pages as one row per host. Pages stay
where they are while all lists together are small enough to be broadcast; else the join is on the
host, where AQE splits a large one.

Lines are compared after trimming blanks, by a 128-bit hash; blank lines are kept and not counted. Pages
of HTML are cut into lines at line breaks and at block tags, tags are removed.

Rows: a null or unreadable url is a host of its own, ``''``; null html has no lines; repeated page rows
count as pages of their own; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.shared import column, stage

BLOCKS = "p|div|li|ul|ol|nav|h1|h2|h3|h4|h5|h6|br|hr|tr|td|th|table|article|section|header|footer|aside|main|title|head|body|html|pre|blockquote|form"

BROADCAST_LINES = 100_000  # of about 50 bytes each


def host_of(url: Column) -> Column:
    """Lower-case host, without user and port."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def html_lines(html: Column) -> Column:
    """Trimmed text lines: scripts, styles and comments go, block tags break lines, other tags vanish."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return F.transform(F.split(text, r"\n+"), lambda line: F.trim(line))


def drop_site_lines(
    pages: DataFrame,
    ratio: float = 0.3,
    least: int = 2,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text): text of the lines that stay, one row per page."""
    cut = pages.select(
        column(id_col).alias("page_id"),
        host_of(column(url_col)).alias("host"),
        F.filter(html_lines(column(html_col)), lambda line: line != "").alias("lines"),
    )
    lines = stage(cut, "site-pages")  # read three times: HTML is cut once
    hashed = lines.select("host", F.array_distinct(F.transform("lines", lambda line: F.md5(line))).alias("keys"))
    totals = lines.groupBy("host").agg(F.count("*").alias("pages"))
    counted = hashed.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    common = counted.join(totals, "host").filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    listed = stage(common.groupBy("host").agg(F.collect_list("key").alias("common")), "site-lines")
    if (listed.agg(F.sum(F.size("common"))).first()[0] or 0) <= BROADCAST_LINES:
        listed = F.broadcast(listed)
    kept = F.filter("lines", lambda line: ~F.array_contains(F.coalesce(F.col("common"), F.array().cast("array<string>")), F.md5(line)))
    out = lines.join(listed, "host", "left").select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select(
        "page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text")
    )
