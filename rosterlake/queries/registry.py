"""Query registry: each entry is a Spark query over the given tables, most with
an independent SQL statement giving the same rows."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def sql(self, recipe: str) -> DataFrame:
        """Run a recipe; `{orders}` stands for a table."""
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in recipe}
        return self.spark.sql(recipe, **used)


def plain(recipe: str) -> str:
    """The recipe with bare table names."""
    return re.sub(r"\{(" + "|".join(TABLES) + r")\}", r"\1", recipe)


def query(name: str, oracle: str | None = None):
    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if oracle is not None:
            ORACLES[name] = plain(oracle)
        return fn

    return wrap
