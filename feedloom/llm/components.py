"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import store


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Connect each node's larger (or smaller) neighbours to the smallest node it knows.

    Minima are aggregated before the shuffle and joined back, so that no neighbourhood is gathered in one place.
    """
    if large:
        sides = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    moved = sides.join(least, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): each linked node with the smallest node of its component as (node, component).

    Nulls and self links are left out; repeated links count once; no links give no rows. Every round is written to the
    shared folder; rounds end when a round changes nothing, which is after a logarithmic number of them.
    """
    now = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or mark == tuple(seen):
            break
        mark = tuple(seen)
        now = store(_star(_star(now, large=True), large=False), "components")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
