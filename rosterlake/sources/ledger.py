"""Tables published by a manifest: readers see a whole result or the former one.

A run writes its tables beside those of earlier runs, each under a stamp of its own,
checks their sizes and then adds one small file to the manifest. Only stamps in the
manifest are read, so a run that fails before that leaves the former result as it is, and
a run of the same name replaces it whole: rows of two attempts are never mixed. One
writer at a time is assumed; readers need no lock. Data of failed and replaced attempts
stays on disk until its folders are removed."""
from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "seq bigint, run string, stamp string, name string, n bigint, columns string"
_MARKS = ("_run", "_stamp")


class NotPublished(ValueError):
    """No run has published the table."""


class WrongSize(ValueError):
    """A written table has other than the planned number of rows."""


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Every published table of every run, in order of `seq`; a row a table and run."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _marked(schema: StructType) -> StructType:
    out = StructType(list(schema.fields))
    for mark in _MARKS:
        out = out.add(mark, "string")
    return out


def publish(root: str, tables: dict[str, DataFrame], run: str = "job", planned: dict[str, int] | None = None) -> str:
    """Write the tables and publish them together under the run's name. `planned` holds
    the number of rows a table must have; where one differs nothing is published. Gives
    back the run's stamp. Columns must not be called `_run` or `_stamp`."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        clash = set(_MARKS) & set(df.columns)
        if clash:
            raise ValueError(f"{name}: columns {sorted(clash)} are the ledger's own")
    stamp, entries = uuid.uuid4().hex, []
    seq = (manifest(spark, root).agg(F.max("seq")).first()[0] or 0) + 1
    for name, df in tables.items():
        path = f"{root}/data/{name}"
        df.withColumn("_run", F.lit(run)).withColumn("_stamp", F.lit(stamp)).write.mode("append").partitionBy(*_MARKS).parquet(path)
        written = spark.read.schema(_marked(df.schema)).parquet(path).filter(F.col("_stamp") == stamp).count()
        if planned and planned.get(name, written) != written:
            raise WrongSize(f"{name}: {written} rows written, {planned[name]} planned; not published")
        entries.append((seq, run, stamp, name, written, df.schema.json()))
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return stamp


def published(spark: SparkSession, root: str, name: str, run: str | None = None, with_run: bool = False) -> DataFrame:
    """The rows of a table in the newest attempt of each run, or of one run only. Runs
    are matched to folders by a join that prunes partitions; `with_run` keeps `_run`."""
    entries = manifest(spark, root).filter(F.col("name") == name)
    entries = entries if run is None else entries.filter(F.col("run") == run)
    newest = entries.orderBy(F.desc("seq")).select("columns").first()
    if newest is None:
        raise NotPublished(name)
    live = entries.groupBy(F.col("run").alias("_run")).agg(F.max_by("stamp", F.struct("seq", "stamp")).alias("_stamp"))
    data = spark.read.schema(_marked(StructType.fromJson(json.loads(newest[0])))).parquet(f"{root}/data/{name}")
    out = data.join(live, list(_MARKS), "left_semi").drop("_stamp")
    return out if with_run else out.drop("_run")
