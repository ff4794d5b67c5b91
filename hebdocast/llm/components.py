"""Connected components of a stored link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, tasks_for, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame, tasks: int) -> DataFrame:
    return written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", tasks)


def _state(edges: DataFrame):
    """Number and fingerprint of the links."""
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count(F.lit(1)), F.sum((h % 1000003).cast("decimal(38,0)")),
                  F.sum(((h / 1000003) % 1000033).cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``links`` (``u, v``), ``root`` the smallest node it reaches.

    Each step joins the links to the smallest neighbour of one end. That neighbour table is written
    first, so both sides of the join are plain exchanges and a node with very many links is split.
    """
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        tasks = tasks_for(now[0])
        both = _both(edges)
        least = _least(both, tasks)  # large star: larger neighbours move to the smallest neighbour
        star = written(both.filter("v > u").join(least.hint("merge"), "u")
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large", tasks)
        low = _least(star, tasks)  # small star: every link points down; smaller neighbours move as well
        small = star.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = written(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small", tasks)
        discard(edges, least, star, low)
        edges = fresh
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
