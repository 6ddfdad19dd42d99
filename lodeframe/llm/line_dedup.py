"""Boilerplate lines by their share of a site's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise

#: Sites with fewer pages, and lines on fewer pages, say nothing about boilerplate.
MIN_PAGES, MIN_COPIES = 5, 3
#: Hashes of boilerplate lines that a broadcast may hold (8 bytes each); beyond it the join is shuffled.
BROADCAST_LINES = 2_000_000
#: How a page becomes lines: scripts, styles and comments go, tags inside a line go, other tags break lines, blanks around breaks go.
VISIBLE = (
    (r"(?is)<script\b.*?</script[\x20\x09-\x0D]*>|<style\b.*?</style[\x20\x09-\x0D]*>|<!--.*?-->", ""),
    (r"(?i)</?(?:a|b|i|em|strong|span|u|code|small|sub|sup)(?:[\x20\x09-\x0D][^>]*)?>", ""),
    (r"<[^>]*>", "\n"),
    (r"[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*", "\n"),
)
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)"
BLANK = "\x20\t\n\x0b\x0c\r"


def host_of(url: Column) -> Column:
    """The lower-case host of an address, without user and port; the whole address where it has none."""
    found = F.regexp_extract(url, HOST, 1)
    return F.lower(F.when(found == "", url).otherwise(found))


def page_lines(html: Column) -> Column:
    """The visible text of a page, a line for each run of text between tags."""
    for pattern, by in VISIBLE:
        html = F.regexp_replace(html, pattern, by)
    return html


def page_texts(pages: DataFrame, url: str = "url", html: str = "html", keep: str = "page_id") -> DataFrame:
    """(keep, host, text) of pages, parsed once and written to the shared folder: line counts and the lines' removal both read it. Null addresses and pages stay null."""
    return materialise(pages.select(keep, host_of(F.col(url)).alias("host"), page_lines(F.col(html)).alias("text")), "page-texts")


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def _key(line: Column) -> Column:
    return F.xxhash64(_bare(line))


def drop_site_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.1, min_pages: int = MIN_PAGES, min_copies: int = MIN_COPIES, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """Drops the lines that more than max_ratio of a host's pages contain.

    Lines are split at newlines and compared without outer blanks (space and ASCII controls from tab to carriage return); a page counts once for each line it has. Returns docs with
    `text` without these lines and, after the other columns, the two `counts` (long): lines and dropped lines. Lines without a word are never dropped. A line needs
    min_copies pages and its host min_pages.

    A null text stays null with counts of 0, an empty one has one line; null hosts are one host. Repeated rows are pages of their own. Extra columns stay whatever their
    names; a column that is already named like one of `counts` is an error (give other names, or None for no counts). An empty table gives no rows. Texts of any length are taken whole.

    The count is by (host, line hash) with partial sums, so neither a host with a third of all pages nor
    a line on every page meets in one task before it is summed. At most (lines a page) / max_ratio lines of a host can exceed the ratio, which
    bounds the list that each page is held against.
    """
    if counts and set(counts) & set(docs.columns):
        raise ValueError(f"the table has a column named like one of {counts}")
    kept = docs.columns
    # every column of docs goes under a name of ours, so none can clash
    own = {c: f"c{k}" for k, c in enumerate(kept)}
    rows = docs.toDF(*own.values()).withColumn("host", F.coalesce(F.col(own[host]).cast("string"), F.lit("\0null")))
    value = F.col(own[text])
    lines = F.filter(F.split(F.coalesce(value, F.lit("")), "\n"), lambda x: F.length(_bare(x)) > 0)
    keys = rows.select("host", F.explode(F.array_distinct(F.transform(lines, _key))).alias("key"))
    pages = rows.groupBy("host").agg(F.count("*").alias("pages"))
    seen = keys.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_copies)
    bad = seen.join(pages, "host").filter((F.col("pages") >= min_pages) & (F.col("n") > max_ratio * F.col("pages")))
    bad = materialise(bad.groupBy("host").agg(F.collect_list("key").alias("bad")), "boilerplate")
    small = (bad.agg(F.sum(F.size("bad")).alias("n")).first()["n"] or 0) <= BROADCAST_LINES
    out = rows.join(F.broadcast(bad) if small else bad, "host", "left")
    split = F.split(value, "\n")
    left = F.when(F.col("bad").isNull(), split).otherwise(F.filter(split, lambda x: (F.length(_bare(x)) == 0) | ~F.array_contains(F.col("bad"), _key(x))))
    both = let(F.struct(split.alias("all"), left.alias("left")), lambda x: F.struct(F.array_join(x["left"], "\n").alias("text"), F.size(x["all"]).alias("n"), (F.size(x["all"]) - F.size(x["left"])).alias("d")))
    out = out.withColumn("cleaned", F.when(value.isNotNull(), both))
    columns = [F.when(value.isNotNull(), F.col("cleaned.text")).alias(c) if c == text else F.col(own[c]).alias(c) for c in kept]
    numbers = [F.coalesce(F.col(f"cleaned.{k}"), F.lit(0)).cast("long").alias(c) for k, c in zip("nd", counts or (), strict=False)]
    return out.select(*columns, *numbers)
