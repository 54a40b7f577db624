"""Connected components of links, by alternating star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialise


def _stars(links: DataFrame) -> DataFrame:
    """One round: link larger neighbours to the least one, then everything to the least below."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("low"))
    small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return small.unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Columns a, component for every node that has a link: the least node it
    reaches. `links` has long columns a and b in either order."""
    links = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        facts = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(facts) == seen:
            return links.select("a", F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("a"), F.col("b").alias("component")).distinct()
            )
        seen = tuple(facts)
        links = materialise(_stars(links), "links")
