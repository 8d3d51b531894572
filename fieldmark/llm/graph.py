"""Connected components of a table of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``edges(a, b)``; comp is the component's least node.

    Alternates the two star contractions: every node hands its larger neighbours, then its smaller
    ones, to the least node it sees, until the links no longer change.  Each step is a minimum per
    node (combined before the shuffle) and a join of stored tables, whose exchange can be split at a hub of any degree.
    Nulls and self-links are ignored.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    print_of = F.struct(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)))
    last = e.agg(print_of.alias("p")).first()["p"]
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stored(large, "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(before, least, large, low)
        now = e.agg(print_of.alias("p")).first()["p"]
        if now == last:
            break
        last = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
