"""Blocking keys of pages from their paths and stylesheets. Only (idx, host, paths, stylesheetHrefs) is read, never the HTML.

Everything is built-in expressions and equi-joins; what is counted is counted with map-side combine. resolve_blocks() writes the narrow
rows once after each step that the next reads several times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.sources.tables import written

EPSILON = 1e-9
MAX_AUTO_DEPTH, AUTO_FROM_PAGES = 5, 20
REASSIGNED = "orphan-merge:"


def path_key(paths: Column, depth: int = 1) -> Column:
    if not isinstance(depth, int) or depth < 1:
        raise ValueError(f"the depth is a positive integer, not {depth}")
    return F.array_join(F.slice(F.filter(paths, lambda p: p != ""), 1, depth), "/")


def stylesheet_key(hrefs: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.array_sort(F.array_distinct(hrefs))), 256), 1, 16)


def url_host(url: Column) -> Column:
    """Host with its port, lower case; null if the URL has none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    return F.when(host != "", F.lower(host))


def with_url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and paths, from their URL."""
    path = F.regexp_replace(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/", "")
    return pages.withColumns({"host": url_host(F.col(url)), "paths": F.split(path, "/")})


def dominant_host(pages: DataFrame) -> DataFrame:
    """One row: the host that most pages' stylesheets name (each host once a page), of equals the one seen first."""
    hosts = pages.select("idx", F.explode("stylesheetHrefs").alias("href")).select("idx", url_host(F.col("href")).alias("h")).where("h is not null").distinct()
    return hosts.groupBy("h").agg(F.count("*").alias("n"), F.min("idx").alias("first")).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "h")).alias("b")).select(F.col("b.h").alias("dominant"))


def first_party(pages: DataFrame) -> DataFrame:
    """Keeps stylesheet hrefs of the page's own host, else of the dominant one; with neither known, all that are URLs."""
    dominant = (dominant_host(pages).first() or [None])[0]
    own = F.coalesce(F.lower("host"), F.lit(dominant).cast("string"))
    return pages.withColumn("stylesheetHrefs", F.filter("stylesheetHrefs", lambda h: own.isNull() | (url_host(h) == own)))


def auto_path_depth(pages: DataFrame, cut) -> int:
    """The depth at which new distinct keys stop to come in numbers: the walk ends at the first increment that reaches the auto-cut."""
    row = pages.agg(F.count("*").alias("n"), *[F.countDistinct(path_key(F.col("paths"), d)).alias(f"d{d}") for d in range(1, MAX_AUTO_DEPTH + 1)]).first()
    if row.n < AUTO_FROM_PAGES:
        return 1
    counts = [row[f"d{d}"] for d in range(1, MAX_AUTO_DEPTH + 1)]
    steps = [(b - a) / row.n for a, b in zip(counts, counts[1:])]
    limit = cut(steps, 1)
    depth = 1
    for step in steps:
        if step >= limit or not step:
            break
        depth += 1
    return depth


def block_keys(pages: DataFrame, depth: int = 1, min_group: int = 2, common: float = 0.9) -> DataFrame:
    """pages with block_key: css:… where at least min_group pages share their distinctive stylesheets, else path:…; and the distinctive hrefs."""
    if min_group < 2 or not 0 < common <= 1:
        raise ValueError("a css group has two pages or more, and the common share lies in (0, 1]")
    hrefs = pages.select(F.explode(F.array_distinct("stylesheetHrefs")).alias("href"))
    total = pages.where(F.size("stylesheetHrefs") > 0).count()
    # at most (sheets a page) / common of them
    usual = [r.href for r in hrefs.groupBy("href").agg(F.count("*").alias("df")).where(F.col("df") >= common * total - EPSILON).select("href").collect()]
    own = F.array_sort(F.array_except(F.array_distinct("stylesheetHrefs"), F.array(*map(F.lit, usual)).cast("array<string>")))
    keyed = pages.withColumn("distinctive", F.when(F.size(own) > 0, own)).withColumn("css", F.when(F.size("distinctive") > 0, stylesheet_key(F.col("distinctive"))))
    shared = keyed.where("css is not null").groupBy("css").agg(F.count("*").alias("n")).where(F.col("n") >= min_group).select("css", F.lit(True).alias("shared"))
    path = path_key(F.col("paths"), depth)
    return keyed.join(shared, "css", "left").withColumns({"path_key": path, "block_key": F.when(F.col("shared"), F.concat(F.lit("css:"), "css")).otherwise(F.concat(F.lit("path:"), path))}).drop("shared", "css")


def reassign_orphans(keyed: DataFrame) -> DataFrame:
    """Pages without stylesheets on a path key join the css blocks that lie within exactly that path; all of them take the key orphan-merge:<path>."""
    confined = keyed.where(F.col("block_key").startswith("css:")).groupBy("block_key").agg(F.min("path_key").alias("lo"), F.max("path_key").alias("hi")).where("lo = hi").select("block_key", F.col("lo").alias("confined"))
    orphan = F.col("block_key").startswith("path:") & (F.size("stylesheetHrefs") == 0)
    paths = keyed.where(orphan).select("path_key").distinct().join(confined.select(F.col("confined").alias("path_key")), "path_key", "left_semi").withColumn("merges", F.lit(True))
    whole = keyed.join(confined, "block_key", "left").join(paths, "path_key", "left")
    moved = F.col("merges") & (orphan | (F.col("confined") == F.col("path_key")))
    return whole.withColumn("block_key", F.when(moved, F.concat(F.lit(REASSIGNED), "path_key")).otherwise(F.col("block_key"))).drop("confined", "merges")


def blocking_reason() -> Column:
    """Why a page (of block_keys, reassigned or not) is in its block."""
    kind = F.when(F.col("block_key").startswith("css:"), "css").when(F.col("block_key").startswith(REASSIGNED), "orphanMerge").otherwise("path")
    return F.struct(kind.alias("kind"), F.when(kind == "css", F.col("distinctive")).alias("distinctiveStylesheetHrefs"), F.when(kind != "css", F.col("path_key")).alias("pathKey"))


def resolve_blocks(pages: DataFrame, depth: int = 1) -> DataFrame:
    """First-party filter, keys, orphans: (idx, block_key, reason and the inputs)."""
    kept = written(first_party(pages), "pages-first-party")
    return reassign_orphans(written(block_keys(kept, depth), "pages-keyed")).withColumn("reason", blocking_reason())
