"""Facts, merged scalars, signatures, counts and other summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import best_per_group, first_k
from ..functions import text as T
from ..rules import NOT_MERGED_KEYS
from .intent import combined_type
from .resolve import RECORD_ORDER, source_keys


def with_lineage(records: DataFrame) -> DataFrame:
    """Source file, type and parent written into every record."""
    add = F.create_map(
        F.lit("__source_file__"), F.coalesce("source_file", F.lit("")), F.lit("__source_type__"), F.coalesce("source_type", F.lit("")),
        F.lit("__parent_source_id__"), F.coalesce("parent_source_id", F.lit("")),
    )
    bare = F.map_filter("rec", lambda k, v: ~k.isin("__source_file__", "__source_type__", "__parent_source_id__"))
    return records.withColumn("rec", F.map_concat(bare, add))


def facts(extracted: DataFrame) -> DataFrame:
    """extracted(source_id, source_file, payload MAP<STRING,STRING of JSON>) to
    one fact per key, with its source reference."""
    return extracted.select(
        F.explode("payload").alias("name", "value"), F.array(F.struct("source_id", F.col("source_file").alias("filename"))).alias("sources")
    )


def image_facts(images: DataFrame) -> DataFrame:
    """Image payloads: images(source_id, source_file, fields MAP, tables
    ARRAY<ARRAY<MAP>>, numbers ARRAY<STRUCT<type,text>>, other MAP) to a fact per
    field, table cell, number and other key."""
    ref = F.array(F.struct("source_id", F.col("source_file").alias("filename"))).alias("sources")
    one = F.lit(1)
    fields = images.select(F.explode("fields").alias("name", "value"), ref)
    others = images.select(F.explode("other").alias("name", "value"), ref)
    rows = images.select("source_id", "source_file", F.posexplode("tables").alias("t", "rows")).select(
        "source_id", "source_file", "t", F.posexplode("rows").alias("r", "row")
    )
    cells = rows.select("source_id", "source_file", "t", "r", F.explode("row").alias("c", "value")).select(
        F.concat(F.lit("table_"), (F.col("t") + one).cast("string"), F.lit("_row_"), (F.col("r") + one).cast("string"), F.lit("_"), "c").alias("name"),
        "value", ref,
    )
    nums = images.select("source_id", "source_file", F.posexplode("numbers").alias("n", "x")).select(
        F.concat(F.lit("number_"), (F.col("n") + one).cast("string"), F.lit("_"), F.coalesce(F.col("x")["type"], F.lit("unknown"))).alias("name"),
        F.coalesce(F.col("x")["text"], F.lit("")).alias("value"), ref,
    )
    return fields.unionByName(cells).unionByName(nums).unionByName(others)


def is_truthy_json(value) -> Column:
    """JSON scalar text that is not null, false, zero or an empty string."""
    v = F.coalesce(T.utrim(value), F.lit("null"))
    return ~(v.isin("null", "false", '""', "") | F.coalesce(v.try_cast("double") == 0.0, F.lit(False)))


def merged_scalars(extracted: DataFrame) -> DataFrame:
    """First truthy scalar per key over the sources in (parent, type, file)
    order, else the last value; container keys are left out."""
    spread = extracted.select(
        "parent_source_id", "source_type", "source_file", "source_id", F.explode("payload").alias("key", "value")
    ).filter(~F.col("key").isin(*NOT_MERGED_KEYS) & T.is_json_scalar("value"))
    order = F.struct("parent_source_id", "source_type", "source_file", "source_id")
    return spread.groupBy("key").agg(
        F.coalesce(
            F.min_by("value", F.when(is_truthy_json("value"), order)), F.max_by("value", order)
        ).alias("value")
    )


def sorted_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.coalesce("parent_source_id", F.lit("")), F.coalesce("source_type", F.lit("")), F.coalesce("source_file", F.lit("")), "source_id")


def canonical_record(rec) -> Column:
    """Key-sorted JSON text of a record."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(T.col(rec)))))


def signatures(records: DataFrame) -> DataFrame:
    """Order-free content signature per source.

    Record hashes are counted, then combined in a tree (six, then three hex
    digits, then the source), so no step gathers more than a few thousand
    hashes per group whatever the size of a source."""
    hashed = records.groupBy(
        "source_id", F.sha2(canonical_record("rec"), 256).alias("h")
    ).agg(F.count(F.lit(1)).alias("n"))
    join = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    deep = hashed.groupBy("source_id", F.substring("h", 1, 6).alias("p")).agg(join(F.concat_ws(":", "h", F.col("n").cast("string"))).alias("h"))
    mid = deep.groupBy("source_id", F.substring("p", 1, 3).alias("q")).agg(join(F.concat_ws(":", "p", "h")).alias("h"))
    return mid.groupBy("source_id").agg(join(F.concat_ws(":", "q", "h")).alias("signature"))


def total_signature(per_source: DataFrame, sources: DataFrame) -> DataFrame:
    """One signature over all sources, again combined in a tree."""
    named = per_source.join(sources.select("source_id", "source_file", "source_type", "parent_source_id"), "source_id").select(
        F.sha2(F.concat_ws("|", "parent_source_id", "source_type", "source_file", "signature"), 256).alias("h")
    ).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    join = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    deep = named.groupBy(F.substring("h", 1, 6).alias("p")).agg(join(F.concat_ws(":", "h", F.col("n").cast("string"))).alias("h"))
    mid = deep.groupBy(F.substring("p", 1, 3).alias("q")).agg(join(F.concat_ws(":", "p", "h")).alias("h"))
    return mid.agg(join(F.concat_ws(":", "q", "h")).alias("signature"))


LIMBS = [f"s{k}" for k in range(8)]


def record_sums(records: DataFrame, *keys: str) -> DataFrame:
    """n and s0 to s7: the number of records and the sums, 32 bits at a time, of their 256-bit
    hashes (source and content), for each of `keys` or for all. Sums of two sets of records
    add up to those of both, whatever the order, so a changed source costs its own rows."""
    h = F.sha2(F.concat(F.col("source_id"), F.lit("|"), canonical_record("rec")), 256)
    limb = lambda k: F.coalesce(F.sum(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")), F.lit(0).cast("long"))
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[limb(k).alias(c) for k, c in enumerate(LIMBS)])


def changed_sums(total: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Sums after the records of `gone` (sums) were replaced by those of `come` (sums)."""
    signed = total.unionByName(come).unionByName(gone.select(*[(-F.col(c)).alias(c) for c in ("n", *LIMBS)]))
    return signed.agg(*[F.sum(c).alias(c) for c in ("n", *LIMBS)])


def sum_signature(sums: DataFrame) -> DataFrame:
    """`sums` with their signature."""
    return sums.withColumn("signature", F.sha2(F.concat_ws(",", "n", *LIMBS), 256))


# ------------------------------------------------------------------- counts
def source_summary(sources: DataFrame) -> DataFrame:
    return sources.groupBy(F.coalesce("source_type", F.lit("unknown")).alias("source_type")).agg(
        F.count(F.lit(1)).alias("n_sources"), F.sum(F.when(F.col("error").isNotNull(), 1).otherwise(0)).alias("n_errors")
    )


def source_errors(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("error").isNotNull()).select("source_file", "source_type", "error")


def record_counts(records: DataFrame) -> DataFrame:
    """Records per source, sheet and type (add, remove, unknown)."""
    kind = combined_type("rec", "sheet_name")
    return records.select("source_id", "source_file", "sheet_name", F.coalesce(F.when(kind.isin("add", "remove"), kind), F.lit("unknown")).alias("record_type")).groupBy(
        "source_id", "source_file", "sheet_name", "record_type"
    ).agg(F.count(F.lit(1)).alias("n_records"))


def contributing_files(records: DataFrame) -> DataFrame:
    return records.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_records"))


def constant_fields(records: DataFrame, keys: list[str]) -> DataFrame:
    """Keys holding one and the same non-blank value in every record."""
    pairs = records.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(T.utrim(F.try_element_at("rec", F.lit(k))), F.lit("")).alias("v")) for k in keys])).alias("p")).select("p.key", "p.v")
    per = pairs.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return per.filter((F.col("lo") == F.col("hi")) & (F.col("lo") != "")).select("key", F.col("lo").alias("value"))


def usage_totals(calls: DataFrame) -> DataFrame:
    """calls(step, input_tokens, output_tokens) summed per step."""
    return calls.groupBy("step").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.count(F.lit(1)).alias("requests"),
    )


def source_profiles(records: DataFrame, max_keys: int | None = None, samples: int = 2, max_fields: int | None = None) -> DataFrame:
    """Per source: its keys and a few sample records, cut down where the caller
    says so."""
    keys = source_keys(records)
    if max_keys is not None:
        keys = first_k(keys, ["source_id"], [F.col("seen"), F.col("key")], max_keys)
    names = keys.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "key"))), lambda x: x["key"]).alias("record_keys"))
    fields = F.col("rec") if max_fields is None else T.first_fields("rec", max_fields)
    top = first_k(records, ["source_id"], [F.col(c) for c in RECORD_ORDER], samples)
    shown = top.groupBy("source_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.to_json(fields).alias("j")))), lambda x: x["j"]).alias("sample_records")
    )
    return names.join(shown, "source_id")


# ----------------------------------------------------------------- warnings
def distinct_warnings(warnings: DataFrame, order: list[str]) -> DataFrame:
    """Each (scope, code, detail) once, at its first place."""
    return best_per_group(warnings, ["scope", "code", "detail"], [F.col(o) for o in order])


# -------------------------------------------------------- two readings merged
def merge_fields(first: DataFrame, second: DataFrame) -> DataFrame:
    """(source_id, field, value) of two readers: the first wins per field, the
    second fills gaps."""
    a = first.select("source_id", "field", F.col("value").alias("v1"), F.lit(True).alias("in1"))
    b = second.select("source_id", "field", F.col("value").alias("v2"))
    return a.join(b, ["source_id", "field"], "full_outer").select(
        "source_id", "field", F.when(F.col("in1"), F.col("v1")).otherwise(F.col("v2")).alias("value"),
        F.when(F.col("in1"), F.lit("first")).otherwise(F.lit("second")).alias("reader"),
    )


def merge_tables(first: DataFrame, second: DataFrame) -> DataFrame:
    """(source_id, row_idx, rec) of two readers: the table with more rows."""
    count = lambda d, n: d.groupBy("source_id").agg(F.count(F.lit(1)).alias(n))
    sizes = count(first, "n1").join(count(second, "n2"), "source_id", "full_outer").fillna(0, ["n1", "n2"])
    take2 = sizes.filter("n2 > n1").select("source_id")
    return first.withColumn("reader", F.lit("first")).join(take2, "source_id", "left_anti").unionByName(
        second.withColumn("reader", F.lit("second")).join(take2, "source_id", "left_semi")
    )
