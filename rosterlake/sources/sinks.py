"""Blocks, envelopes and result files."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def blocks(mails: DataFrame, exported: DataFrame | None = None, empty: bool = False) -> DataFrame:
    """Ordered fragments of each mail as (source_id, ord, type, content, meta); with `empty`
    also texts of nothing or blanks.

    mails has the header columns, text, html, body, cut_rule and used_body."""
    given = (lambda c: F.col(c).isNotNull()) if empty else T.is_non_empty
    headers = F.to_json(F.struct("from", "to", "cc", "bcc", "subject", "date", "message_id"))
    none = F.create_map().cast("map<string,string>")
    meta = F.create_map(F.lit("used_body"), F.col("used_body"), F.lit("cut_rule"), F.col("cut_rule"))
    items = F.filter(
        F.array(
            F.struct(F.lit("email_headers").alias("type"), headers.alias("content"), none.alias("meta")),
            F.when(given("text"), F.struct(F.lit("email_text").alias("type"), F.col("text").alias("content"), none.alias("meta"))),
            F.when(given("html"), F.struct(F.lit("email_html").alias("type"), F.col("html").alias("content"), none.alias("meta"))),
            F.struct(F.lit("email_body_text").alias("type"), F.col("body").alias("content"), meta.alias("meta")),
        ),
        lambda b: b.isNotNull(),
    )
    out = mails.select("source_id", F.posexplode(items).alias("i", "b")).select(
        "source_id", (F.col("i") + 1).alias("ord"), F.col("b")["type"].alias("type"), F.col("b")["content"].alias("content"), F.col("b")["meta"].alias("meta")
    )
    if exported is not None:
        files = exported.filter("NOT is_duplicate").select(
            "source_id", (F.col("part_idx") + 100).alias("ord"),
            F.when(F.col("is_image"), F.lit("eml_image_file")).otherwise(F.lit("eml_file_part")).alias("type"),
            F.to_json(F.struct("export_name", "content_type", "size_bytes", "sha256")).alias("content"), none.alias("meta"),
        )
        out = out.unionByName(files)
    return out


def sheet_envelopes(layout: DataFrame, coverage: DataFrame, counts: DataFrame) -> DataFrame:
    """One JSON envelope of metadata and warnings per sheet; the records stay a
    table of their own."""
    keys = ["source_id", "sheet_idx"]
    j = layout.join(coverage.select(*keys, "coverage"), keys, "left").join(counts, keys, "left")
    meta = F.struct(
        F.lit("schema_infer").alias("mode"), F.round(F.coalesce("coverage", F.lit(0.0)), 4).alias("coverage"), F.col("n_rows").alias("total_rows"),
        F.coalesce("records_count", F.lit(0)).alias("processed_rows"), "data_rows", "header_row_idx", "data_start_idx", "header_mode",
    )
    return j.select(*keys, F.to_json(F.struct(meta.alias("metadata"), "warnings")).alias("envelope"))


def write_results(path: str, summary: DataFrame, fills: DataFrame, sources: DataFrame, job_name: str = "result", stamp: str | None = None) -> str:
    """summary, fills and sources as JSON lines under one (time-stamped) folder;
    written by the executors, never gathered."""
    root = f"{path.rstrip('/')}/{job_name}" + (f"_{stamp}" if stamp else "")
    for name, df in (("summary", summary), ("fills", fills), ("sources", sources)):
        df.write.mode("overwrite").json(f"{root}/{name}")
    return root


def write_cells(cell_writes: DataFrame, path: str) -> None:
    """Addressed cells as parquet, one folder per form."""
    cell_writes.write.mode("overwrite").partitionBy("template_id").parquet(path)
