"""Records to addressed cells: mappings, constants, placement, typed writes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import best_per_group, checkpointed, positions
from ..functions import dates as D
from ..functions import text as T
from ..options import FillOptions, IntentWords
from .forms import header_lookup, lookup_headers, main_region
from .matching import synonym_match

WORDS = IntentWords()
RECORD_LEVELS = ["parent_source_id", "source_type", "source_file", "source_id", "sheet_idx", "row_idx"]


def ordered(records: DataFrame) -> DataFrame:
    """Order columns without nulls, so every record has one exact place."""
    fill = {"parent_source_id": "", "source_type": "", "source_file": "", "sheet_idx": 0, "row_idx": 0}
    for c, v in fill.items():
        if c not in records.columns:
            records = records.withColumn(c, F.lit(v))
    return records.fillna(fill)


# ----------------------------------------------------------- derived fields
def add_month_field(records: DataFrame, new_key: str, keys: list[str], fmt) -> DataFrame:
    """Derived field: month of the first non-blank of the keys, written into the
    record. `fmt` is a style or a column holding one."""
    if isinstance(fmt, str):
        value = D.month_from_date("rec", keys, fmt)
    else:
        first = F.coalesce(*[T.none_if_blank(F.try_element_at("rec", F.lit(k))) for k in keys])
        value = F.coalesce(D.format_year_month(D.year_month(first), fmt), F.lit(""))
    rest = F.map_filter("rec", lambda k, v: k != new_key)
    return records.withColumn("rec", F.map_concat(rest, F.create_map(F.lit(new_key), value)))


def fee_month(rec, intent, words: IntentWords = WORDS) -> Column:
    """Month of a record: a direct fee field, then the intent's date fields in
    order, then any field named like a date or time."""
    rec = T.col(rec)
    direct = [T_.lower().replace(" ", "").replace("_", "").replace("-", "") for T_ in words.fee_month_keys]
    first = lambda entries: F.try_element_at(
        F.filter(F.transform(entries, lambda e: D.year_month(e["value"])), lambda v: v.isNotNull()), F.lit(1)
    )
    named = lambda test: F.filter(F.map_entries(rec), lambda e: test(e["key"]))
    in_order = lambda keys: F.coalesce(*[D.year_month(F.try_element_at(rec, F.lit(k))) for k in keys])
    by_intent = F.when(T.col(intent) == "remove", in_order(words.remove_dates)).otherwise(in_order(words.add_dates))
    return F.coalesce(first(named(lambda k: T.fold_text(k).isin(*direct))), by_intent, first(named(D.has_date_word)))


def loose_month(rec, words: IntentWords = WORDS) -> Column:
    """Month of a record read from loose text in date-like fields."""
    rec = T.col(rec)
    keys = [*words.fee_month_keys, "离职日期", "入职日期", "变动日期", "申报日期", "生效日期", "开始日期", "结束日期", "办理日期"]
    any_date = F.filter(F.map_entries(rec), lambda e: D.has_date_word(e["key"]))
    rest = F.filter(F.transform(any_date, lambda e: D.year_month_loose(e["value"])), lambda v: v.isNotNull())
    return F.coalesce(*[D.year_month_loose(F.try_element_at(rec, F.lit(k))) for k in keys], F.try_element_at(rest, F.lit(1)))


def auto_fields(columns: DataFrame, keys: DataFrame, records: DataFrame, styles: DataFrame, intents: DataFrame, taken: DataFrame, words: IntentWords = WORDS) -> DataFrame:
    """Fee-month and declare-type headers the mapping leaves open: a record key
    named alike, else a constant (the first month found; 增员 or 减员).

    keys(template_id, key, seen), styles(template_id, style), intents(template_id,
    intent), taken(template_id, header_path)."""
    heads = columns.filter("header_path != ''").join(taken.select("template_id", "header_path"), ["template_id", "header_path"], "left_anti")
    h = T.fold_text("header_path")
    fold = lambda ws: [w.lower().replace(" ", "").replace("_", "").replace("-", "") for w in ws]
    fee, decl = fold(words.fee_month_headers), fold(words.declare_headers)
    kind = F.when(T.contains_any(h, fee), F.lit("fee")).when(T.contains_any(h, decl), F.lit("declare"))
    heads = heads.select("template_id", "header_path", "col_index", kind.alias("kind")).filter("kind IS NOT NULL")

    def named(kind, cands):
        k = T.fold_text("key")
        hit = F.array_min(F.array(*[F.when((k == c) | F.contains(k, F.lit(c)) | F.contains(F.lit(c), k), F.lit(i)) for i, c in enumerate(cands)]))
        ranked = keys.withColumn("_h", hit).filter("_h IS NOT NULL")
        return ranked.groupBy("template_id").agg(F.min_by("key", F.struct("_h", "seen")).alias("key")).withColumn("kind", F.lit(kind))

    found = named("fee", fee).unionByName(named("declare", decl))
    order = F.struct(*RECORD_LEVELS)
    month = loose_month("rec", words)
    by_file = D.year_month_loose("source_file")
    months = ordered(records).select(*RECORD_LEVELS, month.alias("m"), by_file.alias("f")).agg(
        F.coalesce(F.min_by("m", F.when(F.col("m").isNotNull(), order)), F.min_by("f", F.when(F.col("f").isNotNull(), order))).alias("m")
    ).scalar()
    out = heads.join(found, ["template_id", "kind"], "left").join(styles, "template_id", "left").join(intents, "template_id", "left")
    const = (
        F.when(F.col("key").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("kind") == "fee", D.format_year_month(months, F.coalesce("style", F.lit("YYYY-MM"))))
        .when(F.col("intent") == "add", F.lit("增员")).when(F.col("intent") == "remove", F.lit("减员"))
    )
    return out.select("template_id", "header_path", "col_index", "key", const.alias("constant")).filter("key IS NOT NULL OR constant IS NOT NULL")


def promote_constants(mapping: DataFrame, constant: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mapped keys that are one constant become constant headers.
    constant(key, value) comes from `facts.constant_fields`."""
    hit = mapping.join(constant, "key")
    kept = mapping.join(constant.select("key"), "key", "left_anti")
    return kept, hit.select("template_id", "header", F.col("value"))


# ------------------------------------------------------------------ placement
def column_plan(mapping: DataFrame, columns: DataFrame, constants: DataFrame | None = None, opts: FillOptions = FillOptions()) -> DataFrame:
    """One row per form column to write: (template_id, col_index, col_letter,
    key, constant). mapping(template_id, header, key, ord), constants(template_id,
    header, value, ord). A key goes to its first column, a column takes the last
    key; forced columns override and allowed columns restrict the plan."""
    lookup = header_lookup(main_region(columns))
    found = lookup_headers(mapping.filter(T.is_non_empty("key")), lookup).filter("col_index IS NOT NULL")
    one = best_per_group(found.select("template_id", "key", "ord", "col_index", "col_letter"), ["template_id", "key"], [F.col("ord")])
    plan = one.select("template_id", "col_index", "col_letter", "key", F.lit(None).cast("string").alias("constant"), F.lit(0).alias("k"), "ord")
    if constants is not None:
        c = lookup_headers(constants.filter(T.is_non_empty("value")), lookup).filter("col_index IS NOT NULL")
        plan = plan.unionByName(c.select("template_id", "col_index", "col_letter", F.concat(F.lit("__const__"), "header").alias("key"), F.col("value").alias("constant"), F.lit(1).alias("k"), "ord"))
    plan = override_columns(plan, opts)
    picked = plan.groupBy("template_id", "col_index").agg(F.max_by(F.struct("col_letter", "key", "constant"), F.struct("k", "ord", "key")).alias("p"))
    return picked.select("template_id", "col_index", "p.*")


def override_columns(plan: DataFrame, opts: FillOptions) -> DataFrame:
    """Forced field → column letters, then only the allowed columns."""
    for key, letter in opts.forced_columns.items():
        forms = plan.select("template_id").distinct()
        rest = plan.filter(F.col("key") != key)
        up = letter.upper()
        extra = forms.select(
            "template_id", T.col_number(F.lit(up)).alias("col_index"), F.lit(up).alias("col_letter"), F.lit(key).alias("key"),
            F.lit(None).cast("string").alias("constant"), F.lit(2).alias("k"), F.lit(0).alias("ord"),
        )
        plan = rest.unionByName(extra)
    if opts.allowed_columns:
        plan = plan.filter(F.upper("col_letter").isin(*[c.upper() for c in opts.allowed_columns]))
    return plan


def unknown_headers(mapping: DataFrame, columns: DataFrame) -> DataFrame:
    gone = lookup_headers(mapping, header_lookup(main_region(columns))).filter("col_index IS NULL")
    return gone.select(F.col("template_id").alias("scope"), F.lit("template_header_not_found").alias("code"), F.col("header").alias("detail"))


def row_value(rec, key) -> Column:
    """Value of a record by a key column: exact, else a nested path."""
    rec, key = T.col(rec), T.col(key)
    parts = F.split(F.translate(key, "/", "."), r"\.")
    inner = F.call_function(
        "get_json_object", F.try_element_at(rec, F.try_element_at(parts, F.lit(1))),
        F.concat(F.lit("$."), F.array_join(F.slice(parts, 2, F.size(parts)), ".")),
    )
    nested = F.when(F.size(parts) > 1, inner)
    return F.when(F.map_contains_key(rec, key), F.try_element_at(rec, key)).otherwise(nested)


def place_records(records: DataFrame, group: list[str]) -> DataFrame:
    """Exact position of each record within its form, in source and row order."""
    return positions(ordered(records), group, RECORD_LEVELS, ["row_idx"])


def plan_cells(placed: DataFrame, plan: DataFrame, columns: DataFrame, skip_null: bool = False, by: tuple[str, ...] = ("template_id",)) -> DataFrame:
    """cell_writes: one row per record and planned column. `placed` has
    template_id, pos and rec; the plan is gathered per form (its width). With more
    columns in `by` a form has a plan for each of their values; records without
    template_id go to every form."""
    region = main_region(columns).groupBy("template_id").agg(F.max("sheet").alias("sheet"), F.max("data_row").alias("data_row"))
    wide = plan.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("col_index", "col_letter", "key", "constant"))).alias("plan"))
    # Written, so its size is known before the records are read: they stay where they are.
    wide = checkpointed(wide.join(region, "template_id"))
    out = placed.join(wide, [c for c in by if c in placed.columns]).select(
        "template_id", "sheet", (F.col("data_row") + F.col("pos") - 1).cast("int").alias("row"), "rec", F.explode("plan").alias("p")
    )
    value = F.coalesce(F.col("p")["constant"], row_value("rec", F.col("p")["key"]))
    if not skip_null:
        value = F.coalesce(value, F.lit(""))
    return out.select(
        "template_id", "sheet", "row", F.col("p")["col_index"].alias("col"), F.col("p")["col_letter"].alias("col_letter"),
        F.col("p")["key"].alias("key"), value.alias("value"),
    ).filter("value IS NOT NULL")


def clear_ranges(columns: DataFrame, counts: DataFrame, extra: int = 10) -> DataFrame:
    """Area emptied before writing: down to the region's end, at most the rows
    written plus some. counts(template_id, n_rows)."""
    region = main_region(columns).groupBy("template_id").agg(
        *[F.max(c).alias(c) for c in ("sheet", "data_row", "last_row", "first_col", "last_col")]
    )
    end = F.least("last_row", F.col("data_row") + F.col("n_rows") + extra)
    ref = F.concat(T.col_letter("first_col"), F.col("data_row").cast("string"), F.lit(":"), T.col_letter("last_col"), end.cast("string"))
    return region.join(counts, "template_id").select("template_id", "sheet", F.col("data_row").alias("first_row"), end.alias("last_row"), "first_col", "last_col", ref.alias("range"))


def clear_cells(ranges: DataFrame, formulas: DataFrame) -> DataFrame:
    """Cells of the ranges, formula cells left out."""
    rows = ranges.filter("last_row >= first_row").select("template_id", "sheet", F.explode(F.sequence("first_row", "last_row")).alias("row"), "first_col", "last_col")
    cells = rows.select("template_id", "sheet", "row", F.explode(F.sequence("first_col", "last_col")).alias("col"))
    return cells.join(formulas, ["template_id", "sheet", "row", "col"], "left_anti")


def typed_writes(writes: DataFrame, formulas: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Writes with typed values; formula cells are never touched. formats has
    (template_id, sheet, row, col, number_format)."""
    at = ["template_id", "sheet", "row", "col"]
    out = writes.join(formulas, at, "left_anti")
    if formats is not None:
        out = out.join(formats.select(*at, "number_format"), at, "left")
    else:
        out = out.withColumn("number_format", F.lit("General"))
    return out.withColumn("typed", D.typed_cell("value", F.coalesce("number_format", F.lit("General"))))


def last_write_wins(writes: DataFrame, order: list[str]) -> DataFrame:
    at = ["template_id", "sheet", "row", "col"]
    return best_per_group(writes, at, [-F.col(o) for o in order])


def written_counts(writes: DataFrame) -> DataFrame:
    return writes.groupBy("template_id").agg(F.count(F.lit(1)).alias("cells_written"), F.countDistinct("row").alias("rows_written"))


# ------------------------------------------------------------------ fallback
def fallback_cells(records: DataFrame, columns: DataFrame, planned: DataFrame, one_source: bool = False) -> DataFrame:
    """Writes for forms whose plan gave none: the records of all sources, headers
    matched by synonym with each record's own keys, by position if none matches.
    Sources may name their keys differently, so a form has a plan for each distinct
    list of keys. `one_source` takes the first source only, with the
    keys of its first record."""
    forms = columns.select("template_id").distinct().join(planned.select("template_id").distinct(), "template_id", "left_anti")
    recs = ordered(records)
    if one_source:
        first = F.min_by(F.struct("source_id", F.map_keys("rec").alias("shape")), F.struct(*RECORD_LEVELS))
        recs = recs.join(recs.agg(first.alias("h")).select("h.*"), "source_id")
    else:
        recs = recs.withColumn("shape", F.map_keys("rec"))
    scope = F.struct("template_id", "shape").alias("template_id")
    # Forms laid out alike are planned once, by the first of them. Layouts and lists of keys
    # are both few: neither forms nor records are crossed with the other's names.
    region = main_region(columns).join(forms, "template_id").select("template_id", "header_path", "col_index", "col_letter", "first_col")
    layouts = region.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("col_index", "col_letter", "header_path", "first_col"))).alias("heads"))
    layouts = layouts.select("template_id", F.sha2(F.to_json("heads"), 256).alias("layout"))
    alike = checkpointed(layouts.join(layouts.groupBy("layout").agg(F.min("template_id").alias("like")), "layout").select("template_id", "like"))
    open_forms = checkpointed(alike.select(F.col("like").alias("template_id")).distinct().crossJoin(recs.select("shape").distinct()))
    cols = region.join(open_forms, "template_id").select(scope, "header_path", "col_index", "col_letter", "first_col")
    keys = open_forms.select(scope, F.posexplode("shape").alias("key_idx", "key"))
    by_name = checkpointed(synonym_match(cols, keys))
    rest = cols.filter("header_path != ''").join(by_name.select("template_id").distinct(), "template_id", "left_anti")
    by_place = rest.withColumn("key_idx", F.col("col_index") - F.col("first_col")).join(keys, ["template_id", "key_idx"])
    pick = lambda d: d.select(F.col("template_id.template_id").alias("like"), "template_id.shape", "col_index", "col_letter", "key", F.lit(None).cast("string").alias("constant"))
    plan = pick(by_name).unionByName(pick(by_place)).join(alike, "like").drop("like")
    # The list of keys is in the record: it isn't dealt out and written beside it.
    placed = place_records(recs, []) if one_source else place_records(recs.drop("shape"), []).withColumn("shape", F.map_keys("rec"))
    return plan_cells(placed, plan, columns, skip_null=True, by=("template_id", "shape"))
