"""Lines that a site repeats on many of its pages.

For each host the pages that hold a line are divided by all pages of the host; a line above the
ratio is boilerplate there and is dropped from every page of that host, and only there.

A line travels as two 64-bit hashes, not as text, and counts are summed before the shuffle. The lines a
host loses fit an array: a line above the ratio r is on more than r of the pages, so there are at most
(mean lines of a page) / r of them, however large the host is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import BROADCAST_ROWS, SPACES, stage, text_or_empty

RATIO, MIN_PAGES = 0.2, 3
#: Tags that end a line of the shown text.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
HIDDEN = [r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>"]
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, block tags become line ends, other tags nothing."""
    for pattern in HIDDEN:
        html = F.regexp_replace(html, pattern, "")
    html = F.regexp_replace(html, rf"(?i)</?(?:{BLOCKS})(?:[\s/][^>]*)?>", "\n")
    return F.regexp_replace(html, r"<[^>]*>", "")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES))), lambda line: line != "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def drop_boilerplate(pages: DataFrame, id_col: str, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page: ``id_col``, host, host_pages, n_lines, n_dropped and text (kept lines).

    Lines are trimmed and empty ones left out. A line goes if at least ``min_pages`` pages of the
    host hold it and these are more than ``ratio`` of the host's pages. Repeated rows are pages of their own.

    A page without a host keeps all its lines, and its host_pages is null. A null or empty text has no
    lines. Other columns of ``pages`` are not read. An empty table gives an empty result.
    """
    parsed = pages.select(F.col(id_col), host.alias("host"), _lines(F.coalesce(text, F.lit(""))).alias("lines"))
    sited = parsed.filter("host is not null")
    totals = sited.groupBy("host").agg(F.count("*").alias("host_pages"))
    spread = sited.select("host", F.explode(F.array_distinct(F.transform("lines", _key))).alias("line"))
    often = spread.groupBy("host", "line").agg(F.count("*").alias("on_pages")).filter(F.col("on_pages") >= min_pages)
    hosts = stage(totals, "hosts")
    flagged = stage(often.join(hosts, "host").filter(F.col("on_pages") / F.col("host_pages") > ratio).select("host", "line"), "boilerplate")

    sites = hosts.join(flagged.groupBy("host").agg(F.collect_list("line").alias("drop")), "host", "left")
    if hosts.unionByName(flagged, allowMissingColumns=True).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sites = F.broadcast(sites)
    kept = F.filter("lines", lambda line: ~F.array_contains(F.col("drop"), _key(line)))
    joined = parsed.join(sites, "host", "left").withColumn("kept", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(kept))
    return joined.select(
        id_col, "host", "host_pages", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def page_text_without_boilerplate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """:func:`drop_boilerplate` over raw web pages, by the host of their URL."""
    return drop_boilerplate(pages, id_col, host_of(F.col(url_col)), html_text(text_or_empty(html_col)), **options)
