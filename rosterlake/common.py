"""Helpers every operator shares: rules, group facts, positions, checkpoints."""
from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import contains_any, let

SHEET = ["source_id", "sheet_idx"]
ROW = SHEET + ["row_idx"]
COLUMN = SHEET + ["col_idx"]
ORDER = ["parent_source_id", "source_type", "source_file", "source_id", "sheet_idx", "row_idx"]


def rule_match(text: Column, groups) -> Column:
    """Every group has a word in the text. `=w` means the whole text is `w`,
    `!w` means `w` does not occur."""
    out = None
    for group in groups:
        exact = [w[1:] for w in group if w.startswith("=")]
        absent = [w[1:] for w in group if w.startswith("!")]
        inside = [w for w in group if w[0] not in "=!"]
        tests = [contains_any(text, inside)] if inside else []
        tests += [text.isin(*exact)] if exact else []
        tests += [~contains_any(text, absent)] if absent else []
        hit = reduce(lambda a, b: a | b, tests)
        out = hit if out is None else out & hit
    return out


def first_rule(text: Column, rules) -> Column:
    """Key of the first matching rule, else ''. One CASE, no join; the text is
    folded once however many rules look at it."""

    def pick(t):
        out = F.lit("")
        for key, groups in reversed(rules):
            out = F.when(rule_match(t, groups), F.lit(key)).otherwise(out)
        return out

    return let(text, pick)


def attach(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Add per-group aggregates to every row.

    A grouped aggregate (partially combined before its shuffle) joined back,
    rather than a window: a window sends a whole group to one task, while this
    join can be broadcast or split by the adaptive skew rule."""
    facts = df.groupBy(*keys).agg(*aggs)
    return df.join(facts, keys, "left")


def best_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per group, the first in the given order.

    `min(struct(order, row))` combines before the shuffle, so a key held by a
    third of the table costs one row per map task."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*ranked)).alias("_r")
    )
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def first_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark cuts each map task's part of the
    group to k rows before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def positions(df: DataFrame, group: list[str], levels: list[str], order: list, name: str = "pos") -> DataFrame:
    """Exact 1-based position of each row in its group, without putting a group
    into one task and without a window over its rows.

    Rows are dealt out by range of (group, levels, order) and sorted once; the
    written table then knows each row's place in its range. What is added to it is
    the number of the group's rows in earlier ranges: a row a group and range."""
    keys = list(dict.fromkeys([*group, *levels, *order]))
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    dealt = checkpointed(dealt).withColumn("_range", F.shiftright("_place", 33))
    starts = dealt.groupBy(*group, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = starts.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).drop("_first", "_n")
    return dealt.join(shift, [*group, "_range"]).withColumn(name, F.col("_place") + F.col("_shift")).drop("_place", "_range", "_shift")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters find worked out, with all it is made of. A plain
    column would be put into the filter again with everything it mentions, and that filter
    below the columns, which are then worked out once more for the rows that pass."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`. Where that is unset, a
    session in one process (as in tests) gets a folder of its own; a cluster, whose
    executors would not see it, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the table to the shared folder and reading it
    back. Unlike a plain checkpoint the result carries its size, so Spark can
    still pick a broadcast join for what turns out small."""
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out evenly by their keys, for steps that cost by row: parts of a written
    table are cut by bytes, which leaves thousands of small files in one part beside a few
    large ones. The number of parts is given, so small parts are not put together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
