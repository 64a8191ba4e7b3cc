"""Children of containers: the closure over derived files."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed


def closure(roots: DataFrame, children_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All sources reachable from the roots, each once, with depth and parent.

    `children_of(level)` gives (source_id, parent_source_id, ...) for one level;
    the whole level is one job. Each level is checkpointed, so neither lineage
    nor work grows with depth; the loop ends when a level brings nothing new."""
    level = checkpointed(roots.withColumn("depth", F.lit(0)))
    seen = level
    depth = 0
    while True:
        depth += 1
        found = children_of(level)
        fresh = found.join(seen.select("source_id"), "source_id", "left_anti")
        # One parent per child: the smallest, whatever order tasks finish in.
        rest = [c for c in fresh.columns if c not in ("source_id", "parent_source_id")]
        one = fresh.groupBy("source_id").agg(F.min("parent_source_id").alias("parent_source_id"), *[F.min(c).alias(c) for c in rest])
        level = checkpointed(one.withColumn("depth", F.lit(depth)).select(*seen.columns))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def lineage(sources: DataFrame) -> DataFrame:
    """Each source with its parent's file name."""
    parents = sources.select(F.col("source_id").alias("parent_source_id"), F.col("source_file").alias("parent_file"))
    return sources.join(parents, "parent_source_id", "left")
