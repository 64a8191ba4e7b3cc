"""Spark-side shapes of the recipes: cells, records, maps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recipes as R
from .registry import Tables


def sheet_cells(t: Tables) -> DataFrame:
    """The sheets as cells: one pass over customer, values unpivoted in place."""
    rows = t.sql(R.SHEET_ROWS)
    body = rows.select(
        "source_id", "sheet_idx", "sheet_name", "row_idx", F.posexplode(F.array(*[f"v{i}" for i in range(6)])).alias("col_idx", "raw")
    )
    heads = (
        rows.select("source_id", "sheet_idx", "sheet_name", "variant").distinct()
        .join(F.broadcast(t.sql(R.SHEET_HEADERS)), "variant").select(*body.columns)
    )
    return body.unionByName(heads).filter("raw <> ''").withColumn("raw_type", F.lit("string"))


def _map(*pairs):
    return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v if not isinstance(v, str) else F.col(v) for _, v in pairs]))


def records(t: Tables) -> DataFrame:
    """The record rows with their maps; six shapes of keys."""
    rows = t.sql(R.RECORD_ROWS)
    rec = (
        F.when(F.col("variant") == 0, _map(("name", "nm"), ("id_number", "idn"), ("start_date", "dt"), ("部门", "prio")))
        .when(F.col("variant") == 1, _map(("姓名", "nm"), ("工号", "idn"), ("离职日期", "dt"), ("离职原因", "reason")))
        .when(F.col("variant") == 2, _map(("name", "nm"), ("id_number", "idn"), ("start_date", "dt")))
        .when(F.col("variant") == 3, _map(("name", "nm"), ("employee_id", "idn"), ("leave_date", "dt"), ("intent", F.lit("remove"))))
        .when(F.col("variant") == 4, _map(("员工姓名", "nm"), ("身份证号", "idn"), ("申报类型", "kind"), ("变动日期", "dt")))
        .otherwise(_map(("name", F.concat(F.lit("9"), F.col("o_custkey").cast("string"))), ("备用", "nm"), ("id_number", "iso_date"), ("编号", F.concat(F.lit("77"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))), ("termination_date", "dt")))
    )
    return rows.withColumn("rec", rec)


RECORD_COLS = ["source_id", "source_file", "source_type", "parent_source_id", "sheet_name", "sheet_idx", "row_idx", "rec"]
