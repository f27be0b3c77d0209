"""Connected components of a link table, by rounds of joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of links (a, b): root is the smallest node of the component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), whose link count never grows, until the
    links no longer change. Nodes without links are absent; loops count as links of a node to itself.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = Table(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links").read()
    before = None
    while True:
        ways = links.filter("u <> v").unionByName(links.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Table(ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least").read()  # stored, so that the join on a hub can be split
        large = ways.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        loops = links.filter("u = v")
        large = large.unionByName(loops).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = Table(small, "links").read()
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
