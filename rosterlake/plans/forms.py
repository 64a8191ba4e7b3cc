"""Target forms: grids of cells to described columns.

form_cells(template_id, filename, sheet_idx, sheet, row, col, raw, raw_type,
is_formula, number_format), rows and columns from 1. Forms are small (a few
hundred rows are looked at per sheet); they are kept as tables like all else.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import checkpointed, first_rule
from ..functions import dates as D
from ..functions import text as T
from ..rules import PROFILE_HEADERS

FORM = ["template_id", "sheet_idx"]
SAMPLE_ROWS = 3


def has_value(cells: DataFrame) -> DataFrame:
    """Cells with a value; blank text and a numeric zero count as none."""
    zero = F.coalesce((F.col("raw_type") == "number") & (F.col("raw").try_cast("double") == 0.0), F.lit(False))
    return cells.filter(T.is_non_empty("raw") & ~zero)


def sheet_frames(cells: DataFrame) -> DataFrame:
    """Per sheet: extent, header row and number of header lines.

    The header row is the one with most filled cells (the first of them), among the
    rows up to the first where three cells have been filled and the next row holds
    data. Rows become counts; the running maximum is a window over a sheet's rows."""
    zero = F.coalesce((F.col("raw_type") == "number") & (F.col("raw").try_cast("double") == 0.0), F.lit(False))
    filled = T.is_non_empty("raw") & ~zero
    rows = cells.filter("template_id IS NOT NULL AND sheet_idx IS NOT NULL").groupBy(*FORM, "row").agg(
        F.sum(F.when(filled, 1).otherwise(0)).cast("int").alias("n"), F.max("col").alias("max_col"), F.max("sheet").alias("sheet"), F.max("filename").alias("filename")
    )
    by_row = Window.partitionBy(*FORM).orderBy("row")
    after = F.when(F.lead("row").over(by_row) == F.col("row") + 1, F.lead("n").over(by_row)).otherwise(0)
    most = F.max("n").over(by_row)
    seen = rows.withColumn("after", after).withColumn("most", most)
    # A row may be empty in the table of cells: a stop there is the same as none.
    stop = F.when((F.col("most") >= 3) & (F.col("after") > 0), F.col("row"))
    gap = F.when((F.col("most") >= 3) & (F.lead("n").over(by_row) > 0) & (F.lead("row").over(by_row) > F.col("row") + 1), F.lead("row").over(by_row) - 1)
    # A sheet's rows lie together for the windows above: its stop is found there too.
    seen = seen.withColumn("stop", F.coalesce(stop, gap)).withColumn("stop", F.min("stop").over(Window.partitionBy(*FORM)))
    candidate = (F.col("row") >= 1) & (F.col("n") > 0) & (F.col("stop").isNull() | (F.col("row") <= F.col("stop")))
    per = seen.groupBy(*FORM).agg(
        F.max("sheet").alias("sheet"), F.max("filename").alias("filename"), F.max("row").alias("max_row"), F.max("max_col").alias("max_col"),
        F.min(F.when(candidate, F.struct((-F.col("n")).alias("less"), "row", "after"))).alias("h"),
    )
    row = F.col("h")["row"]
    return per.filter(-F.col("h")["less"] >= 2).select(
        *FORM, "sheet", "filename", "max_row", "max_col", row.alias("header_row"), ((F.col("h")["after"] >= 2) & (row + 1 <= F.col("max_row"))).alias("two_lines")
    )


def regions(cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Regions of every sheet: its named tables, else one found in the used
    range. tables(template_id, sheet_idx, table_name, ref)."""
    auto = sheet_frames(cells).select(
        *FORM, "sheet", "filename", F.concat(F.lit("region_"), F.col("header_row").cast("string")).alias("region_id"),
        F.col("header_row").alias("first_row"), F.col("max_row").alias("last_row"),
        F.lit(1).alias("first_col"), F.col("max_col").alias("last_col"), F.when(F.col("two_lines"), 2).otherwise(1).alias("header_lines"),
    )
    if tables is None:
        return auto
    ends = F.split(F.replace("ref", F.lit("$"), F.lit("")), ":")
    a, b = T.cell_ref(F.try_element_at(ends, F.lit(1))), T.cell_ref(F.try_element_at(ends, F.lit(-1)))
    named = tables.withColumn("a", a).withColumn("b", b).filter("a IS NOT NULL AND b IS NOT NULL").select(
        *FORM, F.concat(F.lit("table_"), "table_name").alias("region_id"), F.col("a")["row"].alias("first_row"),
        F.col("b")["row"].alias("last_row"), F.col("a")["col"].alias("first_col"), F.col("b")["col"].alias("last_col"),
    )
    inside = has_value(cells).select(*FORM, "row", "col").join(named, FORM).filter(
        (F.col("row") == F.col("first_row") + 1) & (F.col("row") <= F.col("last_row")) & F.col("col").between(F.col("first_col"), F.col("last_col"))
    ).select(*FORM, "region_id").distinct().withColumn("second", F.lit(True))
    titles = cells.groupBy(*FORM).agg(F.max("sheet").alias("sheet"), F.max("filename").alias("filename"))
    named = named.join(inside, [*FORM, "region_id"], "left").join(titles, FORM)
    named = named.withColumn("header_lines", F.when(F.col("second"), 2).otherwise(1)).select(*auto.columns)
    return named.unionByName(auto.join(named.select(*FORM).distinct(), FORM, "left_anti"))


def is_formula() -> Column:
    return F.coalesce("is_formula", F.lit(False)) | F.coalesce(F.startswith("raw", F.lit("=")), F.lit(False))


def parse_forms(cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """template_columns: one row per column of every region, with the joined
    header path, sample values and number format."""
    # A row a region, written: the sorts that find regions are done with their memory before
    # those that describe columns begin, and regions are found once for both joins below.
    regs = checkpointed(regions(cells, tables))
    r = regs.withColumn("data_row", F.col("first_row") + F.col("header_lines"))
    grid = r.select("*", F.explode(F.sequence("first_col", "last_col")).alias("col"))
    near = cells.filter(F.col("raw").isNotNull() | (F.col("number_format") != "General")).join(
        r.select(*FORM, "region_id", "first_row", "last_row", "data_row", "first_col", "last_col"), FORM
    ).filter(
        F.col("col").between(F.col("first_col"), F.col("last_col"))
        & F.col("row").between(F.col("first_row"), F.least(F.col("last_row"), F.col("data_row") + SAMPLE_ROWS - 1))
    )
    off = F.col("row") - F.col("first_row")
    head = off < F.col("data_row") - F.col("first_row")
    facts = near.groupBy(*FORM, "region_id", "col").agg(
        F.max(F.when(head & (off == 0), F.col("raw"))).alias("h1"), F.max(F.when(head & (off == 1), F.col("raw"))).alias("h2"),
        F.transform(F.array_sort(F.collect_list(F.when(~head & F.col("raw").isNotNull(), F.struct("row", "raw")))), lambda x: x["raw"]).alias("sample_values"),
        F.max(F.when((F.col("row") == F.col("data_row")) & (F.col("number_format") != "General"), F.col("number_format"))).alias("number_format"),
    )
    j = grid.join(facts, [*FORM, "region_id", "col"], "left")
    h1, h2 = F.coalesce("h1", F.lit("")), F.coalesce("h2", F.lit(""))
    second = F.when(h2 == "", h1).otherwise(h2)
    path = F.when(F.col("header_lines") == 1, h1).otherwise(
        F.array_join(F.filter(F.array(h1, second), lambda p: p != ""), "/")
    )
    return j.select(
        *FORM, "filename", "sheet", "region_id", T.col_letter("col").alias("col_letter"), F.col("col").alias("col_index"), path.alias("header_path"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"), F.coalesce("number_format", F.lit("General")).alias("number_format"),
        "first_row", "last_row", "data_row", "first_col", "last_col",
    )


def sample_rows(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Up to three example rows per region as header → value; formulas left out."""
    cols = columns.filter("header_path != ''").select(*FORM, "region_id", F.col("col_index").alias("col"), "header_path", "data_row", "last_row")
    j = cells.filter(~is_formula() & F.col("raw").isNotNull()).join(cols, [*FORM, "col"]).filter(
        F.col("row").between(F.col("data_row"), F.least(F.col("last_row"), F.col("data_row") + SAMPLE_ROWS - 1))
    )
    # The last of equal header paths wins within a row.
    one = j.groupBy(*FORM, "region_id", "row", "header_path").agg(F.max_by("raw", "col").alias("v"), F.min("col").alias("col"))
    return one.groupBy(*FORM, "region_id", "row").agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("col", "header_path", "v"))), lambda x: F.struct(x["header_path"], x["v"]))).alias("sample")
    )


def formula_cells(cells: DataFrame) -> DataFrame:
    return cells.filter(is_formula()).select("template_id", "sheet", "row", "col")


# --------------------------------------------------------------- inspection
def main_region(columns: DataFrame) -> DataFrame:
    """Columns of each form's first region that has any header, first sheet."""
    firsts = columns.groupBy("template_id").agg(F.min("sheet_idx").alias("sheet_idx"))
    named = columns.join(firsts, FORM, "left_semi").withColumn("has", F.col("header_path") != "")
    ok = named.groupBy(*FORM, "region_id").agg(F.max("has").alias("has"), F.min(F.struct("first_row", "first_col")).alias("o")).filter("has")
    pick = ok.groupBy(*FORM).agg(F.min_by("region_id", F.struct("o", "region_id")).alias("region_id"))
    return named.join(pick, [*FORM, "region_id"], "left_semi").drop("has")


def header_lookup(columns: DataFrame) -> DataFrame:
    """(template_id, variant) → column: exact path, folded, last level, folded
    last level; the leftmost column wins a variant."""
    path = F.col("header_path")
    last = T.utrim(F.element_at(F.split(path, "/"), -1))
    deep = F.contains(path, F.lit("/"))
    variants = F.array_distinct(F.filter(F.concat(
        F.array(path, T.fold_text(path)), F.when(deep, F.array(last, T.fold_text(last))).otherwise(F.array().cast("array<string>"))
    ), lambda v: v != ""))
    rows = columns.filter("header_path != ''").select("template_id", "col_index", "col_letter", "header_path", F.explode(variants).alias("variant"))
    return rows.groupBy("template_id", "variant").agg(F.min(F.struct("col_index", "col_letter", "header_path")).alias("c")).select(
        "template_id", "variant", "c.*"
    )


def lookup_headers(wanted: DataFrame, lookup: DataFrame) -> DataFrame:
    """wanted(template_id, header, ...) with its column, exact before folded;
    unknown headers keep a null column."""
    exact = lookup.select("template_id", F.col("variant").alias("header"), F.struct("col_index", "col_letter").alias("_e"))
    folded = lookup.select("template_id", F.col("variant").alias("_v"), F.struct("col_index", "col_letter").alias("_f"))
    j = wanted.join(exact, ["template_id", "header"], "left").withColumn("_v", T.fold_text("header")).join(folded, ["template_id", "_v"], "left")
    hit = F.coalesce("_e", "_f")
    return j.withColumn("col_index", hit["col_index"]).withColumn("col_letter", hit["col_letter"]).drop("_e", "_f", "_v")


def suffix_columns(columns: DataFrame, suffix: str) -> DataFrame:
    """Columns one of whose header variants ends with the suffix."""
    want = T.match_text(F.lit(suffix))
    return columns.filter(F.exists(T.header_variants("header_path"), lambda v: F.endswith(v, want)))


def is_insurance_form(columns: DataFrame) -> DataFrame:
    """Per form whether its main region ends headers with 姓名, 申报类型 and 费用年月."""
    path = T.utrim(F.replace("header_path", F.lit("　"), F.lit("")))
    has = lambda s: F.max(F.endswith(path, F.lit(s)))
    return main_region(columns).groupBy("template_id").agg((has("姓名") & has("申报类型") & has("费用年月")).alias("is_insurance"))


def header_contains(path, words) -> Column:
    return T.contains_any(T.fold_profile(path), words)


def header_ends_with(path, suffix: str) -> Column:
    return F.endswith(T.fold_profile(path), T.fold_profile(F.lit(suffix)))


def profile_columns(columns: DataFrame) -> DataFrame:
    """Roles of main-region columns: name, id, declare, fee_month, reason, with
    the order within the role and the fund section."""
    ends = {"name": "姓名", "id": "证件号码", "declare": "申报类型", "fee_month": "费用年月"}
    role = lambda r: F.when(
        header_contains("header_path", PROFILE_HEADERS[r]) | (header_ends_with("header_path", ends[r]) if r in ends else F.lit(False)), F.lit(r)
    )
    roles = F.filter(F.array(*[role(r) for r in PROFILE_HEADERS]), lambda r: r.isNotNull())
    out = main_region(columns).select("*", F.explode(roles).alias("role")).withColumn("section", T.section_tag("header_path"))
    w = Window.partitionBy("template_id", "role").orderBy("col_index")
    return out.withColumn("role_idx", F.row_number().over(w) - 1)


def detect_profiles(columns: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Per form: detected when three of the four signals are there, with a name
    and a declare type or fee month; fee month layout from the sample rows."""
    has = lambda r: F.max(F.col("role") == r)
    per = profile_columns(columns).groupBy("template_id").agg(
        has("name").alias("n"), has("id").alias("i"), has("declare").alias("d"), has("fee_month").alias("f"),
        F.max(F.col("role").isin("declare", "reason") & (F.col("section") == "social_security")).alias("has_social_security"),
        F.max(F.col("role").isin("declare", "reason") & (F.col("section") == "housing_fund")).alias("has_housing_fund"),
    )
    score = sum((F.when(F.col(c), 1).otherwise(0) for c in "nidf"), F.lit(0))
    out = per.select(
        "template_id", ((score >= 3) & F.col("n") & (F.col("d") | F.col("f"))).alias("detected"), "has_social_security", "has_housing_fund"
    )
    if samples is None:
        return out.withColumn("fee_month_format", F.lit("YYYYMM"))
    values = samples.select("template_id", "region_id", "row", F.posexplode(F.map_values("sample")).alias("i", "v"))
    style = F.when(F.col("v").rlike(r"^[0-9]{6}$"), F.lit("YYYYMM")).when(F.col("v").rlike(r"^[0-9]{4}-[0-9]{2}$"), F.lit("YYYY-MM"))
    first = values.groupBy("template_id").agg(F.min_by(style, F.when(style.isNotNull(), F.struct("row", "i"))).alias("style"))
    return out.join(first, "template_id", "left").withColumn("fee_month_format", F.coalesce("style", F.lit("YYYYMM"))).drop("style")


def fee_month_columns(columns: DataFrame, words) -> DataFrame:
    """Columns asking for a fee month, by their header words."""
    n = T.fold_text("header_path")
    exact = n.isin(*[w.lower() for w in words.fee_month_headers])
    loose = T.contains_any(n, ["年月", "月份"]) & T.contains_any(n, words.fee_month_anchors)
    return columns.filter(loose | exact)


def sample_style(samples: DataFrame, headers: DataFrame, default: str) -> DataFrame:
    """Year-month layout per form from the sample values of the given headers
    (template_id, header_path)."""
    values = samples.select("template_id", "row", F.explode("sample").alias("header_path", "v")).join(headers, ["template_id", "header_path"], "left_semi")
    style = D.year_month_style("v")
    found = values.groupBy("template_id").agg(F.min_by(style, F.when(style.isNotNull(), F.struct("row", "header_path"))).alias("style"))
    return headers.select("template_id").distinct().join(found, "template_id", "left").select("template_id", F.coalesce("style", F.lit(default)).alias("style"))


def role_of(header) -> Column:
    """First role of a header text, for single lookups."""
    return first_rule(T.fold_profile(header), tuple((r, (w,)) for r, w in PROFILE_HEADERS.items()))
