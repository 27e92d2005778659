"""Links of crawled pages: which are followed, and what a crawl reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.session import materialize

# What the crawlers leave out.
SKIP_PREFIXES, SKIP_PARTS, SKIP_ENDS = ("/nyheder",), ("localLink", "#"), (".pdf", ".png")
LEGACY_PREFIXES = ("/english", "/nyheder", "#")
# End of fixed values.


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_followed(href: Column, prefixes=SKIP_PREFIXES, parts=SKIP_PARTS, ends=SKIP_ENDS) -> Column:
    """Root-relative, outside the skipped paths, no anchor and no file of a skipped kind; case matters. False for null."""
    skipped = _any([href.startswith(p) for p in prefixes] + [href.contains(p) for p in parts] + [href.endswith(e) for e in ends])
    return F.coalesce(href.startswith("/") & ~skipped, F.lit(False))


def is_followed_legacy(href: Column, prefixes=LEGACY_PREFIXES) -> Column:
    return F.coalesce(href.startswith("/") & ~_any([href.startswith(p) for p in prefixes]), F.lit(False))


def without_anchor(href: Column) -> Column:
    """Without the anchor and a closing slash."""
    return F.regexp_replace(F.split_part(href, F.lit("#"), F.lit(1)), r"/+$", "")


def joined(base: str, path: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/")), path)


def reached(edges: DataFrame, start: str, seen: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of all that is reached from `start` over edges (src, dst), breadth first.

    `start` itself counts only if something links to it, at the depth at which that happens. Nodes of `seen` are known
    from before: they are not expanded and not returned. Each round joins only the newest nodes.
    """
    spark = edges.sparkSession
    edges = materialize(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    front = spark.createDataFrame([(start,)], "node string")
    known = front.select("node").limit(0) if seen is None else seen.select("node").distinct()
    found, depth = None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = edges.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti")
        new = materialize(new, "frontier")
        if new.isEmpty():
            break
        level = new.withColumn("depth", F.lit(depth))
        found = level if found is None else found.unionByName(level)
        known = known.unionByName(new)
        front = new
    return found if found is not None else spark.createDataFrame([], "node string, depth int")
