"""Line deduplication by site-relative frequency, with DataFrame functions only.

A line is boilerplate of its host when the share of the host's pages that contain it exceeds a ratio. Lines are
told apart by a 64-bit hash while counting. The boilerplate lines of one host are at most its mean number of
distinct lines a page divided by the ratio, so they fit an array by host; each page then filters its own lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_names

RATIO = 0.2
MIN_PAGES = 3
#: op5 and the pipeline's stage: a line goes by either rule of (share of the host's different pages, least number of them).
STAGE_RULES = ((RATIO, MIN_PAGES), (0.01, 10))

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
#: Markup without text, and tags that end a line of the rendered page.
_UNSEEN = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->|<head\b[^>]*>.*?</head>"
_BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
_TAGS = r"<[^>]*>"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def visible_lines(html: Column) -> Column:
    """Text of a page with a line break at each block tag; other tags go."""
    s = F.regexp_replace(html, _UNSEEN, "\n")
    return F.regexp_replace(F.regexp_replace(s, _BREAKS, "\n"), _TAGS, "")


def _lines(text: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x != "")


def drop_boilerplate(rows: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, out: str = "text", more_rules: tuple = (), copies_once: bool = False, added: tuple[str, str, str] = ("host", "n_lines", "n_dropped")) -> DataFrame:
    """``rows`` with the kept lines as ``out`` and the columns ``added``: host, number of lines, number of dropped lines.

    Columns of ``rows`` with these four names are replaced; all others stay as they are, whatever their names.
    Lines are trimmed and blank ones are no lines. A line goes from all pages of a host when more than
    ``ratio`` of the host's pages have it and at least ``min_pages`` do. Null hosts are one host (''), null texts
    have no lines; a page left without lines stays with the text ''. Very long texts and lines count whole. Repeated rows are pages of their own, the
    order of lines stays, an empty table gives an empty result. ``more_rules`` are further (ratio, least pages) by
    which a line goes. With ``copies_once``, pages of a host with the same lines count as one page of it, so that a
    text does not become boilerplate by its copies; lines go from all rows all the same.
    """
    scratch = Scratch(rows.sparkSession, "lines")
    at, lines, hashes, common, kept = free_names(rows, "_host", "_lines", "_hashes", "_common", "_kept")
    base = rows.withColumns({at: F.coalesce(host, F.lit("")), lines: _lines(text)})
    line_hashes = F.transform(lines, lambda x: F.xxhash64(x))
    if copies_once:
        counted = base.groupBy(F.col(at).alias("host"), F.xxhash64(lines).alias("page")).agg(F.first(F.array_distinct(line_hashes)).alias("own"))
    else:
        counted = base.select(F.col(at).alias("host"), F.array_distinct(line_hashes).alias("own"))
    rules = [(ratio, min_pages), *more_rules]
    # the null in front counts the page itself
    seen = counted.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "own")).alias("h"))
    counts = seen.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("h").isNull() | (F.col("n") >= min(least for _, least in rules)))
    counts = scratch.write(counts, "counts")
    pages = scratch.write(counts.where("h IS NULL").select("host", F.col("n").alias("pages")), "pages")
    over = [(F.col("n") >= least) & (F.col("n") > F.col("pages") * F.lit(share)) for share, least in rules]
    found = counts.where("h IS NOT NULL").join(pages, "host").where(reduce(Column.__or__, over))
    found = scratch.write(found.groupBy(F.col("host").alias(at)).agg(F.collect_list("h").alias(common)), "common")
    marked = base.join(found, at, "left").withColumn(hashes, line_hashes)
    # the intersection is by hash table and leaves only the page's own few common lines to look through
    marked = marked.withColumn(common, F.array_intersect(hashes, F.coalesce(common, F.array().cast("array<bigint>"))))
    gone = lambda x: F.array_contains(common, F.xxhash64(x))
    marked = marked.withColumn(kept, F.when(F.size(common) == 0, F.col(lines)).otherwise(F.filter(lines, lambda x: ~gone(x))))
    result = dict(zip(added, (F.col(at), F.size(lines).cast("long"), (F.size(lines) - F.size(kept)).cast("long")))) | {out: F.array_join(kept, "\n")}
    return marked.withColumns(result).drop(at, lines, hashes, common, kept)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = drop_boilerplate(pages, host_of(F.col("url")), visible_lines(F.col("html")), *STAGE_RULES[0], more_rules=STAGE_RULES[1:], copies_once=True)
    return found.select("page_id", "host", "n_lines", "n_dropped", "text")


_OVER = " OR ".join(f"(c.n >= {least} AND c.n > t.pages * CAST({share} AS DOUBLE))" for share, least in STAGE_RULES)

OP5_SQL = f"""
WITH p AS (
  SELECT page_id,
         coalesce(lower(regexp_extract(url, '{_HOST}', 1)), '') AS host,
         string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_UNSEEN}', chr(10), 'g'),
           '{_BREAKS}', chr(10), 'g'), '{_TAGS}', '', 'g'), chr(10)) AS parts
  FROM pages),
l AS (SELECT page_id, host, list_filter(list_transform(parts, lambda x: trim(x)), lambda x: x <> '') AS lines FROM p),
d AS (SELECT DISTINCT host, lines FROM l),
u AS (SELECT host, unnest(list_distinct(lines)) AS line FROM d),
c AS (SELECT host, line, count(*) AS n FROM u GROUP BY host, line),
t AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
b AS (SELECT c.host, list(c.line) AS common FROM c JOIN t ON c.host = t.host
      WHERE {_OVER} GROUP BY c.host),
k AS (SELECT l.page_id, l.host, l.lines,
      CASE WHEN b.common IS NULL THEN l.lines ELSE list_filter(l.lines, lambda x: NOT list_contains(b.common, x)) END AS kept
      FROM l LEFT JOIN b ON l.host = b.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS text
FROM k
"""
