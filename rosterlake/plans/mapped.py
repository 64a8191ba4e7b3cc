"""Fill plans from an outside reader's mappings, for all forms at once.

A mapping is a row: its headers, constants, derived fields and record filter are map and
array columns. So every form's records are filtered, given derived fields, gated and placed
in one plan, whatever the number of forms; forms that treat records alike share them until
cells are made. Records meet forms in blocks of records: forms, which are few, are copied to
the blocks, and no key holds all records of an intent."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed
from ..functions import dates as D
from ..functions import text as T
from ..operators import intent as I
from ..operators import replies as Q
from ..options import FillOptions
from . import fill as P
from . import forms as FO

FEE_KEY = "__fee_month__"
DEFAULT_STYLE = "YYYY-MM"
_DERIVED = "array<struct<new_key: string, source_keys: array<string>, output_format: string>>"


def read_mappings(replies: DataFrame) -> DataFrame:
    """replies(template_id, reply) → one row per form: mapping and constants (header → key,
    value), derived, record_filter. What a reply does not say is empty; derived fields that
    break a rule are left out (`mapping_warnings` tells them)."""
    told = replies.select("template_id", Q.parse_reply("reply")["json"].alias("json"))
    good = _derived(told).filter("reject IS NULL").groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("idx", "new_key", "source_keys", "output_format"))).alias("d"))
    derived = F.transform("d", lambda x: F.struct(x["new_key"].alias("new_key"), x["source_keys"].alias("source_keys"), x["output_format"].alias("output_format")))
    return told.join(good, "template_id", "left").select(
        "template_id", F.coalesce(Q.column_mapping("json"), F.create_map().cast("map<string,string>")).alias("mapping"), Q.constant_values("json").alias("constants"),
        F.coalesce(derived, F.array().cast(_DERIVED)).alias("derived"), Q.record_filter("json").alias("record_filter"),
    )


def _derived(told: DataFrame) -> DataFrame:
    return Q.derived_fields(told.select(F.col("template_id").alias("source_id"), "json")).withColumnRenamed("source_id", "template_id")


def _entries(mappings: DataFrame, column: str, value: str) -> DataFrame:
    """(template_id, header, value, ord) of a map column."""
    listed = F.posexplode(F.map_entries(column)).alias("ord", "e")
    return mappings.select("template_id", listed).select("template_id", F.col("e")["key"].alias("header"), F.col("e")["value"].alias(value), "ord")


def _styles(columns: DataFrame) -> DataFrame:
    """Year-month style of each column's first sample that has one."""
    style = F.try_element_at(F.filter(F.transform("sample_values", D.year_month_style), lambda s: s.isNotNull()), F.lit(1))
    return columns.select("template_id", "col_index", "header_path", style.alias("style"))


def described(columns: DataFrame, forms: DataFrame, mappings: DataFrame, opts: FillOptions = FillOptions()) -> DataFrame:
    """One row per form with a mapping: its intent (told by the mapping, else by the form),
    the keys that count for gating, derived fields with their final style, the record filter
    (left out where it works against the intent, see `conflict`), and fee_style if a fee-month
    header is left open. forms(template_id, filename, intent)."""
    main = FO.main_region(columns)
    words = main.groupBy("template_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set("header_path"))).alias("words"))
    told = forms.select("template_id", "filename", F.col("intent").alias("form_intent")).join(mappings, "template_id").join(words, "template_id")
    told = told.withColumn("intent", F.coalesce(I.mapping_intent("constants", "mapping", "filename", "words", opts.words), "form_intent"))

    heads = _entries(mappings, "mapping", "key").unionByName(_entries(mappings, "constants", "key"))
    found = FO.lookup_headers(heads, FO.header_lookup(main)).filter("col_index IS NOT NULL").join(_styles(main), ["template_id", "col_index"])
    styled = found.filter("style IS NOT NULL").groupBy("template_id", "key").agg(F.min_by("style", "col_index").alias("style"))
    styled = styled.groupBy("template_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "style")))).alias("styles"))
    fee = _styles(FO.fee_month_columns(main, opts.words)).join(found.select("template_id", "header_path"), ["template_id", "header_path"], "left_anti")
    fee = fee.groupBy("template_id").agg(F.coalesce(F.min_by("style", F.when(F.col("style").isNotNull(), F.col("col_index"))), F.lit(DEFAULT_STYLE)).alias("fee_style"), F.min_by("header_path", "col_index").alias("fee_header"))

    out = told.join(styled, "template_id", "left").join(fee, "template_id", "left")
    style = lambda d: F.when(d["output_format"] == "from_template_sample", F.coalesce(F.try_element_at("styles", d["new_key"]), F.lit(DEFAULT_STYLE))).otherwise(d["output_format"])
    derived = F.transform("derived", lambda d: F.struct(d["new_key"].alias("new_key"), d["source_keys"].alias("source_keys"), style(d).alias("style")))
    made = F.transform("derived", lambda d: d["new_key"])
    wanted = F.col("record_filter")
    conflict = wanted.isNotNull() & I.filter_conflicts(wanted["values"], wanted["exclude"], F.coalesce("intent", F.lit("")), opts.words)
    return out.select(
        "template_id", "intent", "mapping", "constants", F.array_except(F.array_distinct(F.map_values("mapping")), made).alias("keys"), made.alias("made"), derived.alias("derived"),
        F.coalesce(conflict, F.lit(False)).alias("conflict"), F.when(~F.coalesce(conflict, F.lit(False)), wanted).alias("record_filter"), "fee_style", "fee_header",
    )


def passes(rec, record_filter) -> Column:
    """Whether a record passes a form's filter, both being columns: the field's value is (or,
    excluding, is not) in the list; a missing field passes only an excluding filter."""
    rec, told = T.col(rec), T.col(record_filter)
    value = F.lower(T.utrim(F.try_element_at(rec, told["field"])))
    inside = F.array_contains(F.transform(told["values"], lambda v: F.lower(T.utrim(v))), value)
    return told.isNull() | F.coalesce(inside != told["exclude"], told["exclude"])


def with_derived(rec, derived) -> Column:
    """The record with its form's derived fields, each from the first of its source keys that
    is not blank; later fields see earlier ones."""

    def add(known, d):
        texts = F.filter(F.transform(d["source_keys"], lambda k: T.none_if_blank(F.try_element_at(known, k))), lambda v: v.isNotNull())
        value = F.coalesce(D.format_year_month(D.year_month(F.try_element_at(texts, F.lit(1))), d["style"]), F.lit(""))
        return F.map_concat(F.map_filter(known, lambda k, v: k != d["new_key"]), F.create_map(d["new_key"], value))

    return F.aggregate(T.col(derived), T.col(rec), add)


#: What a form's records depend on; forms alike in it have the same records.
TREATMENT = ["intent", "keys", "made", "derived", "record_filter", "fee_style"]


def alike(described_forms: DataFrame) -> DataFrame:
    """(template_id, like): `like` is the first of the forms that treat records as this one does."""
    known = described_forms.select("template_id", F.sha2(F.to_json(F.struct(*TREATMENT)), 256).alias("_t"))
    return known.join(known.groupBy("_t").agg(F.min("template_id").alias("like")), "_t").select("template_id", "like")


def form_records(records: DataFrame, described_forms: DataFrame, opts: FillOptions = FillOptions()) -> DataFrame:
    """Each form's records: of its intent, past its filter, with derived fields and the fee
    month where a header asks for it, gated by the share of mapped keys they fill.

    What depends on a record alone (its intent signals) or on record and intent (its fee
    month) is worked out before records meet forms."""
    blocks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = {r.intent for r in described_forms.select("intent").distinct().limit(3).collect()}  # add, remove or none
    base = P.ordered(records)
    own = []
    if asked & {"add", "remove"}:
        known = checkpointed(I.with_intents(base, opts.words))
        own = [I.known_by_intent(known, i).withColumn("_intent", F.lit(i)) for i in ("add", "remove") if i in asked]
    own += [base.withColumn("_intent", F.lit(""))] if None in asked or not own else []
    month = lambda intent: P.fee_month("rec", intent, opts.words).alias("_month")
    rows = reduce(DataFrame.unionByName, [o.select(*P.RECORD_LEVELS, "rec", "_intent") for o in own])
    rows = checkpointed(rows.select("*", F.pmod(F.xxhash64(*P.RECORD_LEVELS), F.lit(blocks)).alias("_block"), month("_intent")))
    forms = described_forms.withColumn("_intent", F.coalesce("intent", F.lit(""))).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = rows.join(forms.select("template_id", "_intent", "_block", "keys", "made", "derived", "record_filter", "fee_style"), ["_intent", "_block"]).filter(passes("rec", "record_filter"))
    # A derived field may be what the fee month is read from.
    met = met.withColumn("rec", with_derived("rec", "derived"))
    found = F.when(F.size("derived") == 0, F.col("_month")).otherwise(P.fee_month("rec", "_intent", opts.words))
    met = met.withColumn("_fee", F.when(F.col("fee_style").isNotNull(), D.format_year_month(found, F.col("fee_style"))))
    met = met.withColumn("rec", F.when(F.col("_fee").isNull(), F.col("rec")).otherwise(F.map_concat(F.map_filter("rec", lambda k, v: k != FEE_KEY), F.create_map(F.lit(FEE_KEY), F.col("_fee")))))
    kept = checkpointed(met.select("template_id", *P.RECORD_LEVELS, "rec", "keys", "made", I.filled_share("keys").alias("filled_ratio")))
    return I.gate_scored(kept, opts.gate_ratio, opts.gate_top, ["template_id"]).drop("filled_ratio")


def mapped_plan(records: DataFrame, columns: DataFrame, forms: DataFrame, mappings: DataFrame, opts: FillOptions = FillOptions()) -> DataFrame:
    """cell_writes of all forms with a mapping. Derived keys with one value on all of a form's
    rows are written as constants; open fee-month and declare-type headers are filled as
    `auto_fields` and the records' own months allow.

    Records are chosen and placed once for all forms that treat them alike (`alike`); only
    cells are made form by form."""
    told = checkpointed(described(columns, forms, mappings, opts))
    same = checkpointed(alike(told))
    firsts = told.join(same.filter("template_id = like").select("template_id"), "template_id", "left_semi")
    # `like` from here on; what is found of a form's records goes back to all forms like it.
    placed = P.place_records(form_records(records, firsts, opts).drop("keys", "made").withColumnRenamed("template_id", "like"), ["like"])
    main = FO.main_region(columns)
    to_forms = lambda found: same.join(found, "like").drop("like")

    # Derived values are months: few, so distinct ones are taken before anything is compared.
    made = firsts.select(F.col("template_id").alias("like"), F.explode(F.array_distinct(F.concat(F.col("made"), F.array(F.lit(FEE_KEY))))).alias("key"))
    values = placed.join(made, "like").select("like", "key", F.coalesce(T.utrim(F.try_element_at("rec", F.col("key"))), F.lit("")).alias("v")).distinct()
    seen = to_forms(checkpointed(values.groupBy("like", "key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))))
    fixed = seen.filter((F.col("key") != FEE_KEY) & (F.col("lo") == F.col("hi")) & (F.col("lo") != "")).select("template_id", "key", F.col("lo").alias("value"))
    has_fee = seen.filter((F.col("key") == FEE_KEY) & (F.col("hi") != "")).select("template_id")

    mapping, constants = _entries(told, "mapping", "key"), _entries(told, "constants", "value")
    promoted = mapping.join(fixed, ["template_id", "key"]).select("template_id", "header", "value", "ord")
    promoted = promoted.join(constants.select("template_id", "header"), ["template_id", "header"], "left_anti")
    mapping = mapping.join(promoted.select("template_id", "header"), ["template_id", "header"], "left_anti")
    fee = told.join(has_fee, "template_id", "left_semi").filter("fee_header IS NOT NULL").select("template_id", F.col("fee_header").alias("header"), F.lit(FEE_KEY).alias("key"), F.lit(1 << 20).alias("ord"))
    mapping, constants = mapping.unionByName(fee), constants.unionByName(promoted)

    heads = mapping.select("template_id", "header").unionByName(constants.select("template_id", "header"))
    taken = FO.lookup_headers(heads, FO.header_lookup(main)).filter("col_index IS NOT NULL").join(main.select("template_id", "col_index", "header_path"), ["template_id", "col_index"]).select("template_id", "header_path").distinct()
    # Records have few lists of keys: each is taken once, by its first record. Written, so
    # that no test of the keys' names is moved below the grouping, to every record.
    shapes = placed.groupBy("like", F.map_keys("rec").alias("shape")).agg(F.min("pos").alias("pos"))
    keys = shapes.select("like", "pos", F.posexplode("shape").alias("idx", "key")).filter(F.col("key") != FEE_KEY).groupBy("like", "key").agg(F.min(F.struct("pos", "idx")).alias("seen"))
    keys = to_forms(checkpointed(keys))
    styles = told.select("template_id", F.coalesce("fee_style", F.lit(DEFAULT_STYLE)).alias("style"))
    mapped = main.join(told.select("template_id"), "template_id", "left_semi")
    auto = checkpointed(P.auto_fields(mapped, keys, records, styles, told.select("template_id", "intent"), taken, opts.words))
    mapping = mapping.unionByName(auto.filter("key IS NOT NULL").select("template_id", F.col("header_path").alias("header"), "key", ((1 << 21) + F.col("col_index")).alias("ord")))
    constants = constants.unionByName(auto.filter("key IS NULL").select("template_id", F.col("header_path").alias("header"), F.col("constant").alias("value"), ((1 << 21) + F.col("col_index")).alias("ord")))

    plan = checkpointed(P.column_plan(mapping, columns, constants, opts))
    return P.plan_cells(placed, plan.join(same, "template_id"), columns, by=("template_id", "like"))


def mapping_warnings(replies: DataFrame, columns: DataFrame, forms: DataFrame, opts: FillOptions = FillOptions()) -> DataFrame:
    """(scope, code, detail): derived fields that break a rule, mapped headers no form has,
    filters that work against the form's intent."""
    mappings = checkpointed(read_mappings(replies))
    told = replies.select("template_id", Q.parse_reply("reply")["json"].alias("json"))
    rejected = _derived(told).filter("reject IS NOT NULL").select(F.col("template_id").alias("scope"), F.lit("derived_field_rejected").alias("code"), F.concat_ws(": ", F.col("idx").cast("string"), "reject").alias("detail"))
    heads = _entries(mappings, "mapping", "value").unionByName(_entries(mappings, "constants", "value"))
    conflicts = described(columns, forms, mappings, opts).filter("conflict").select(F.col("template_id").alias("scope"), F.lit("record_filter_conflicts_with_intent").alias("code"), F.col("intent").alias("detail"))
    return rejected.unionByName(P.unknown_headers(heads, columns)).unionByName(conflicts)


def mapped_strategy(mappings: DataFrame, opts: FillOptions = FillOptions()) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """The strategy `plan_fill` takes for forms with these mappings."""
    return lambda records, columns, forms: mapped_plan(records, columns, forms, mappings, opts)
