"""Connected components of a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed


def _stars(links: DataFrame, lesser_only: bool) -> DataFrame:
    """Every neighbour (lesser ones only, or the greater ones) of a node is linked to
    the least of them. `links` is (u, v), aggregated before it is joined back."""
    if lesser_only:
        around = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        out = around.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return around.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with a link: root is the least node it is connected
    with. Large and small stars in turn, each round written to the shared folder,
    until a round changes nothing; the rounds grow as the logarithm of a component."""
    links = checkpointed(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        links = checkpointed(_stars(_stars(links, False), True))
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
