"""Sheets as a long table of cells: header detection, layout, profiles, rows.

cells(source_id, sheet_idx, sheet_name, row_idx, col_idx, raw, raw_type) is
sparse: a blank cell has no row. Rows and columns count from 0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import COLUMN, ROW, SHEET
from ..functions import text as T
from ..functions.checks import HAN, is_boolean_check
from ..functions.dates import trimmed_value
from ..options import SheetOptions

DATE_CELL = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?$"
NUMBER_CELL = r"^-?[0-9]+(?:\.[0-9]+)?$"
LONG_CELL = r"^[0-9]{6,}$"
ALPHA_CELL = rf"[A-Za-z]|{HAN}"


def cells_from_table(df: DataFrame, source_id, sheet_idx, sheet_name, row_idx, columns, header_row: int | None = None) -> DataFrame:
    """Unpivot any DataFrame into cells. `columns` maps a header text to a
    Column or column name, left to right; with `header_row` the header texts
    become a row of their own in every sheet."""
    names = list(columns)
    values = [T.col(columns[n]) for n in names]
    base = df.select(
        T.col(source_id).alias("source_id"), T.col(sheet_idx).cast("int").alias("sheet_idx"),
        T.col(sheet_name).alias("sheet_name"), T.col(row_idx).cast("int").alias("row_idx"),
        F.array(*[v.cast("string") for v in values]).alias("_v"),
    )
    body = base.select(
        "source_id", "sheet_idx", "sheet_name", "row_idx", F.posexplode("_v").alias("col_idx", "raw")
    )
    if header_row is not None:
        heads = base.select("source_id", "sheet_idx", "sheet_name").distinct().select(
            "source_id", "sheet_idx", "sheet_name", F.lit(header_row).alias("row_idx"),
            F.posexplode(F.array(*[F.lit(n) for n in names])).alias("col_idx", "raw"),
        )
        body = body.unionByName(heads)
    return body.filter(T.is_non_empty("raw")).withColumn("raw_type", F.lit("string"))


def with_text(cells: DataFrame) -> DataFrame:
    """Cell text; cells without text are dropped from the sparse table."""
    if "text" in cells.columns:
        return cells
    return cells.withColumn("text", T.cell_text("raw", "raw_type")).filter(F.col("text") != "")


def sheet_names(cells: DataFrame) -> DataFrame:
    return cells.select("source_id", "sheet_idx", "sheet_name").distinct()


def requested_sheets(cells: DataFrame, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells of the requested sheets, requested names a source does not have)."""
    spark = cells.sparkSession
    asked = spark.createDataFrame([(w,) for w in wanted], "sheet_name string")
    kept = cells.join(F.broadcast(asked), "sheet_name", "left_semi")
    per_source = cells.select("source_id").distinct().withColumn(
        "sheet_name", F.explode(F.array(*[F.lit(w) for w in wanted]))
    )
    missing = per_source.join(sheet_names(cells), ["source_id", "sheet_name"], "left_anti")
    return kept, missing


def sheet_shapes(cells: DataFrame) -> DataFrame:
    # A text's maximum needs sorted cells; beside the name as a key all is hashed.
    named = cells.groupBy(*SHEET, "sheet_name").agg(F.max("row_idx").alias("r"), F.max("col_idx").alias("c"))
    return named.groupBy(*SHEET).agg(
        F.max("sheet_name").alias("sheet_name"),
        (F.max("r") + 1).alias("n_rows"),
        (F.max("c") + 1).alias("n_cols"),
    )


# ------------------------------------------------------------- row features
def _kinds() -> list[Column]:
    t = F.col("text")
    date = t.rlike(DATE_CELL)
    long = ~date & t.rlike(LONG_CELL)
    number = ~date & ~long & t.rlike(NUMBER_CELL)
    words = ~date & ~long & ~number & t.rlike(ALPHA_CELL) & ~t.rlike(r"[0-9]")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return [
        F.count(F.lit(1)).alias("n"), one(date).alias("n_date"), one(long).alias("n_long"),
        one(date | long | number).alias("n_num"), one(words).alias("n_text"),
        one(t.rlike(NUMBER_CELL)).alias("n_pure"), one(t.rlike(LONG_CELL)).alias("n_digits"),
        one(t.rlike(ALPHA_CELL)).alias("n_alpha"),
    ]


def row_kinds(cells: DataFrame) -> DataFrame:
    """How many cells of each kind a row has: what layout and ranks look at."""
    return with_text(cells).groupBy(*ROW).agg(*_kinds())


def row_features(cells: DataFrame, shapes: DataFrame | None = None, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Shape ratios per row, header score and header tests. The row and column
    bounds are filters on the scan, not on the result."""
    part = with_text(cells)
    if rows is not None:
        part = part.filter(F.col("row_idx") < rows)
    if cols is not None:
        part = part.filter(F.col("col_idx") < cols)
    shapes = sheet_shapes(with_text(cells)) if shapes is None else shapes
    width = F.col("n_cols") if cols is None else F.least(F.col("n_cols"), F.lit(cols))
    feats = part.groupBy(*ROW).agg(*_kinds()).join(shapes.select(*SHEET, "n_cols"), SHEET)
    return add_scores(feats, width)


def add_scores(feats: DataFrame, width: Column) -> DataFrame:
    """Ratios, linear score, header-like test and the quick boolean test."""
    n = F.col("n")
    ratio = lambda c: F.col(c) / n
    out = feats.select(
        *ROW, "n", "n_date", "n_long", "n_num", "n_text", "n_pure", "n_digits", "n_alpha",
        (n / width).alias("fill"), ratio("n_text").alias("text_ratio"), ratio("n_long").alias("long_ratio"),
        ratio("n_date").alias("date_ratio"), ratio("n_num").alias("num_ratio"),
    )
    score = (
        3.5 * F.col("text_ratio") - 2.5 * F.col("long_ratio") - 2.0 * F.col("date_ratio")
        - 1.5 * F.col("num_ratio") + 0.2 * F.col("fill")
    )
    like = (
        (F.col("text_ratio") >= 0.35) & (F.col("long_ratio") <= 0.02)
        & (F.col("date_ratio") <= 0.02) & (F.col("num_ratio") <= 0.15)
    )
    d, g, alpha = F.col("n_date"), F.col("n_digits"), F.col("n_alpha") / F.col("n")
    quick = ~(
        (d >= 2)
        | ((F.col("fill") >= 0.85) & ((d > 0) | (g > 0)) & (F.col("n") >= 6))
        | (d / F.col("n") >= 0.3)
        | (g / F.col("n") >= 0.3)
        | ((F.col("n_pure") / F.col("n") >= 0.6) & (alpha < 0.4))
        | ((alpha < 0.25) & ((d > 0) | (g > 0)))
    )
    return out.withColumn("score", score).withColumn("header_like", like).withColumn("quick_header", quick)


# ------------------------------------------------------------------- layout
def sheet_layout(cells: DataFrame, opts: SheetOptions = SheetOptions(), kinds: DataFrame | None = None) -> DataFrame:
    """One row per sheet: header row, number of header lines, first data row. `kinds`:
    the cells' `row_kinds`, where a caller has them.

    The header is looked for in all rows, or in the first `header_scan_rows`. Rows
    become counts, counts one row per sheet; only the verdict on the row after the
    best one is joined back, so nothing is gathered per sheet."""
    cells = with_text(cells)
    shapes = sheet_shapes(cells)
    rows = (row_kinds(cells) if kinds is None else kinds).join(shapes.select(*SHEET, "n_cols"), SHEET)
    text, long, date, num = (F.col(c) / F.col("n") for c in ("n_text", "n_long", "n_date", "n_num"))
    score = 3.5 * text - 2.5 * long - 2.0 * date - 1.5 * num + 0.2 * (F.col("n") / F.col("n_cols"))
    rows = rows.select(
        *ROW, (-score).alias("s"), ((text >= 0.35) & (long <= 0.02) & (date <= 0.02) & (num <= 0.15)).alias("like"),
        (((long > 0.03) | (date > 0.03)) & (text >= 0.6)).alias("data"),
    )
    scanned = F.lit(True) if opts.header_scan_rows is None else F.col("row_idx") < opts.header_scan_rows
    per = rows.groupBy(*SHEET).agg(
        F.min(F.when(F.col("like") & scanned, F.struct("s", F.col("row_idx").alias("r"), "like", "data"))).alias("best"),
        F.min(F.when(scanned, F.col("row_idx"))).alias("filled"),
        F.collect_set(F.when(F.col("like") & (F.col("row_idx") <= 3), F.col("row_idx"))).alias("first_likes"),
    )
    after = rows.filter("like").select(*SHEET, (F.col("row_idx") - 1).alias("_r"), F.lit(True).alias("_next"))
    per = per.withColumn("_r", F.col("best")["r"]).join(after, [*SHEET, "_r"], "left")
    likes = F.concat("first_likes", F.when(F.col("_next"), F.array(F.col("_r") + 1)).otherwise(F.array().cast("array<int>")))
    per = per.select(*SHEET, F.struct("best", "filled", likes.alias("likes")).alias("f"))
    base = shapes.join(per, SHEET, "left")
    base = base.select(
        *SHEET, "sheet_name", "n_rows", "n_cols", F.coalesce(F.col("f")["best"]["r"], F.lit(-1)).alias("picked"),
        F.coalesce(F.col("f")["filled"], F.lit(0)).alias("first_filled"), F.coalesce(F.col("f")["likes"], F.array().cast("array<int>")).alias("like_rows"),
        F.coalesce(F.col("f")["best"]["data"], F.lit(False)).alias("vetoed"),
    ).withColumn("h", F.when(F.col("vetoed"), F.lit(-1)).otherwise(F.col("picked")))
    like = lambda i: F.array_contains("like_rows", i)
    two = (F.col("h") >= 0) & (F.col("h") + 1 < F.col("n_rows")) & like(F.col("h") + 1)
    start = F.when(F.col("h") < 0, F.col("first_filled")).otherwise(F.col("h") + F.when(two, 2).otherwise(1))
    base = base.withColumn("two", two).withColumn("start", start)

    # No data below the header: of the places {picked,0,1,2} with one or two
    # header lines, take the one leaving most data rows.
    n = F.col("n_rows")

    def option(i, second: bool):
        has_next = i + 1 < n
        as_two = has_next & like(i + 1) if second else F.lit(False)
        ds = i + F.when(as_two, 2).otherwise(1)
        ok = (i >= 0) & (i < n) & (F.lit(not second) | ~has_next | like(i + 1))
        return F.when(ok, F.struct((-F.greatest(n - ds, F.lit(0))).alias("left"), i.alias("h"), F.lit(not second).alias("single"), ds.alias("ds"), as_two.alias("two")))

    places = [F.col("h"), F.lit(0), F.lit(1), F.lit(2)]
    retry = F.array_min(F.filter(F.array(*[option(i, s) for i in places for s in (True, False)]), lambda x: x.isNotNull()))
    stuck = (F.col("start") >= n) & (n >= 2)
    base = base.withColumn("retry", F.when(stuck, retry))
    base = base.select(
        *SHEET, "sheet_name", "n_rows", "n_cols", "first_filled", "vetoed", "picked",
        F.coalesce(F.col("retry")["h"], F.col("h")).alias("h"),
        F.coalesce(F.col("retry")["two"], F.col("two")).alias("two"),
        F.coalesce(F.col("retry")["ds"], F.col("start")).alias("start"),
        (F.col("h") < 0).alias("was_headless"),
    )
    empty = F.col("start") >= n
    warn = F.filter(
        F.array(
            F.when(F.col("vetoed"), F.lit("header_row_looks_like_data_forced_no_header")),
            F.when(F.col("was_headless"), F.lit("no_header_row_detected")),
            F.when((F.col("h") >= 0) & ~F.col("two") & (F.col("h") + 1 < n), F.lit("second_header_row_rejected_as_data")),
        ),
        lambda w: w.isNotNull(),
    )
    headless = empty | (F.col("h") < 0)
    ds = F.when(empty, F.col("first_filled")).otherwise(F.col("start"))
    return base.select(
        *SHEET, "sheet_name", "n_rows", "n_cols",
        F.when(headless, F.lit(-1)).otherwise(F.col("h")).alias("header_row_idx"),
        F.when(headless, F.lit(0)).when(F.col("two"), F.lit(2)).otherwise(F.lit(1)).alias("header_rows"),
        ds.alias("data_start_idx"), F.greatest(n - ds, F.lit(0)).alias("data_rows"),
        F.when(headless, F.lit("no_header")).otherwise(F.lit("header")).alias("header_mode"),
        warn.alias("warnings"),
    )


def header_loss(cells: DataFrame) -> DataFrame:
    """Data-quality flag per sheet: row 0 blank although later rows hold data."""
    return with_text(cells).groupBy(*SHEET).agg(
        (F.min("row_idx") > 0).alias("first_row_blank"), F.count(F.lit(1)).alias("n_cells")
    )


# ------------------------------------------------------------------ columns
def column_headers(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """Every column of every sheet with its one- or two-line header text."""
    top = with_text(cells).join(
        layout.filter("header_row_idx >= 0").select(*SHEET, "header_row_idx", "header_rows"), SHEET
    )
    offset = F.col("row_idx") - F.col("header_row_idx")
    lines = top.filter((offset >= 0) & (offset < F.col("header_rows"))).groupBy(*COLUMN).agg(
        F.max(F.when(offset == 0, F.col("text"))).alias("h1"),
        F.max(F.when(offset == 1, F.col("text"))).alias("h2"),
    )
    grid = layout.filter("n_cols > 0").select(
        *SHEET, "sheet_name", "header_mode", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col_idx")
    )
    out = grid.join(lines, COLUMN, "left")
    headless = F.col("header_mode") == "no_header"
    fallback = F.concat(F.lit("col_"), (F.col("col_idx") + F.when(headless, 0).otherwise(1)).cast("string"))
    raw = F.when(headless, fallback).otherwise(T.header_path("h1", "h2", fallback))
    out = out.withColumn("header_raw", raw)
    folded = T.header_semantic("header_raw")
    return out.select(
        *COLUMN, "sheet_name", "h1", "h2", "header_raw",
        F.when(folded == "", F.col("header_raw")).otherwise(folded).alias("header"),
        (headless | (F.col("h1").isNull() & F.col("h2").isNull())).alias("placeholder"),
    )


def spread_rows(start, end, count: int) -> Column:
    """`count` row numbers spread evenly over [start, end), ends included."""
    start, end = T.col(start), T.col(end)
    span = end - start - 1
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: start + F.bround(i * (span / F.lit(max(count - 1, 1)))).cast("int"),
    )
    return (
        F.when(end <= start, F.array().cast("array<int>"))
        .when((span <= 0) | F.lit(count == 1), F.array(start))
        .otherwise(F.array_sort(F.array_distinct(steps)))
    )


def sample_rows(start, end, head: int, spread: int) -> Column:
    """The first `head` rows and `spread` rows over the whole range."""
    start, end = T.col(start), T.col(end)
    last = F.least(end, start + head) - 1
    first = F.when(last >= start, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_union(first, spread_rows(start, end, spread)))


def data_end(layout_cap: int | None) -> Column:
    if layout_cap is None:
        return F.col("n_rows")
    return F.least(F.col("n_rows"), F.col("data_start_idx") + layout_cap)


def column_profiles(cells: DataFrame, layout: DataFrame, opts: SheetOptions = SheetOptions()) -> DataFrame:
    """Fill ratio, distinct count, samples and text profile of each column.

    Two aggregations: per distinct value first, then per column, so one huge
    column is combined before it is shuffled and only sampled values are kept."""
    cap = opts.limits.rows_per_sheet
    plan = layout.select(
        *SHEET, "data_start_idx", data_end(cap).alias("end_idx"), F.col("n_rows").alias("_total"),
        sample_rows("data_start_idx", "n_rows", opts.head_rows, opts.spread_rows).alias("picks"),
    )
    body = with_text(cells).select(*COLUMN, "row_idx", "text").join(plan, SHEET).filter(
        F.col("row_idx") >= F.col("data_start_idx")
    )
    inside = F.col("row_idx") < F.col("end_idx")
    sampled = F.array_contains("picks", F.col("row_idx"))
    values = body.groupBy(*COLUMN, "text").agg(
        F.sum(F.when(inside, 1).otherwise(0)).alias("cnt"),
        F.min(F.when(sampled, F.col("row_idx"))).alias("pick"),
    )
    one = lambda c: F.sum(F.when(c, F.col("cnt")).otherwise(0))
    t = F.col("text")
    long, number = t.rlike(LONG_CELL), t.rlike(NUMBER_CELL)
    stats = values.groupBy(*COLUMN).agg(
        F.sum("cnt").alias("n_values"),
        F.sum(F.when(F.col("cnt") > 0, 1).otherwise(0)).alias("n_distinct"),
        one(t.rlike(ALPHA_CELL) & ~number & ~long).alias("n_text"), one(long).alias("n_long"), one(number).alias("n_number"),
        one(is_boolean_check(t)).alias("n_bool"),
        F.array_sort(F.collect_list(F.when(F.col("pick").isNotNull(), F.struct("pick", "text")))).alias("picked"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = F.greatest(F.col("end_idx") - F.col("data_start_idx"), F.lit(1))
    share = lambda c: zero(c) / F.greatest(zero("n_values"), F.lit(1))
    heads = column_headers(cells, layout)
    return heads.join(stats, COLUMN, "left").join(plan.select(*SHEET, "data_start_idx", "end_idx"), SHEET).select(
        *heads.columns,
        F.round(zero("n_values") / rows, 4).alias("fill_ratio"),
        F.when(zero("n_distinct") > 0, F.col("n_distinct")).alias("unique_count"),
        F.coalesce(F.slice(F.transform("picked", lambda p: p["text"]), 1, opts.samples), F.array().cast("array<string>")).alias("samples"),
        zero("n_values").alias("n_values"), share("n_text").alias("text_share"), share("n_long").alias("long_share"),
        share("n_number").alias("number_share"), share("n_bool").alias("bool_share"),
    )


# ------------------------------------------------------------- sheet choice
def rank_sheets(cells: DataFrame, opts: SheetOptions = SheetOptions(), kinds: DataFrame | None = None) -> DataFrame:
    """Per sheet: best header score and filled cells, its rank in the workbook, and
    whether it is worth extracting. All rows count, or the first `rank_rows`. `kinds` as in
    `sheet_layout`."""
    cells = with_text(cells)
    rows = row_kinds(cells) if kinds is None else kinds
    rows = rows if opts.rank_rows is None else rows.filter(F.col("row_idx") < opts.rank_rows)
    # Scores of sheets of any width are compared, so the fill ratio has one scale.
    feats = add_scores(rows, F.lit(opts.rank_width))
    stats = feats.groupBy(*SHEET).agg(
        F.max(F.when(F.col("header_like"), F.col("score"))).alias("best_score"), F.sum("n").alias("filled")
    )
    out = sheet_names(cells).join(stats, SHEET, "left").fillna({"filled": 0})
    best = Window.partitionBy("source_id").orderBy(
        F.col("best_score").desc_nulls_last(), F.when(F.col("best_score").isNull(), -F.col("filled")), "sheet_idx"
    )
    order = Window.partitionBy("source_id").orderBy(
        F.col("best_score").desc_nulls_last(), F.col("filled").desc(), F.col("sheet_idx")
    )
    out = out.withColumn("best_rank", F.row_number().over(best)).withColumn("use_rank", F.row_number().over(order))
    useful = F.col("best_score").isNotNull() | (F.col("filled") >= opts.min_useful_cells)
    book = Window.partitionBy("source_id")  # the sheets of one workbook
    out = out.withColumn("useful", useful).withColumn("_any", F.max("useful").over(book))
    return out.withColumn("useful", F.col("useful") | (~F.col("_any") & (F.col("best_rank") == 1))).drop("_any")


def choose_sheets(ranked: DataFrame, mode: str = "auto", preferred: str | None = None) -> DataFrame:
    """Sheets to extract: `single` the best or preferred one, `all` every one,
    `auto` the useful ones (the single path when only one is)."""
    if mode == "all":
        return ranked.select(*SHEET)
    hit = F.lit(False) if preferred is None else F.col("sheet_name") == preferred
    book = Window.partitionBy("source_id")
    facts = ranked.withColumn("_hit", hit).withColumn("_has", F.max("_hit").over(book)).withColumn(
        "_n", F.sum(F.when(F.col("useful"), 1).otherwise(0)).over(book)
    )
    one = F.when(F.col("_has"), F.col("_hit")).otherwise(F.col("best_rank") == 1)
    if mode == "single":
        return facts.filter(one).select(*SHEET)
    auto = F.when(F.col("_n") <= 1, F.when(F.col("_has"), F.col("_hit")).otherwise(F.col("useful"))).otherwise(F.col("useful"))
    return facts.filter(auto).select(*SHEET)


# --------------------------------------------------------------- records
def sheet_rows(cells: DataFrame, layout: DataFrame, cap: int | None = None) -> DataFrame:
    """Data rows as one map column index → text. Rows are gathered before the
    join with the layout, so cells are shuffled once."""
    # A damaged sheet may hold a cell twice: one of them, by its text, is taken.
    given = with_text(cells).groupBy(*ROW).agg(F.collect_list(F.struct("col_idx", F.struct("text", "raw_type").alias("_c"))).alias("_cs"))
    twice = F.size(F.array_distinct(F.col("_cs")["col_idx"])) < F.size("_cs")
    one_each = T.let(F.array_sort("_cs"), lambda cs: F.filter(cs, lambda c, i: (i == 0) | (c["col_idx"] != F.get(cs, i - 1)["col_idx"])))
    rows = given.select(*ROW, F.map_from_entries(F.when(twice, one_each).otherwise(F.col("_cs"))).alias("vals"))
    plan = layout.select(*SHEET, "data_start_idx", data_end(cap).alias("end_idx"))
    return rows.join(plan, SHEET).filter(
        (F.col("row_idx") >= F.col("data_start_idx")) & (F.col("row_idx") < F.col("end_idx"))
    )


def records_from_cells(cells: DataFrame, layout: DataFrame, named: DataFrame, sources: DataFrame | None = None, opts: SheetOptions = SheetOptions(), row_filter: dict | None = None, flag_demo: bool = False) -> DataFrame:
    """cells → records by the key of each column; sheets whose columns could
    not be named give none. Every key of the sheet is in every record. Placeholder
    records are left out, or stay with `is_demo` (`flag_demo`)."""
    from ..rules import DATE_KEYS

    serial = F.lit(True) if opts.serial_dates == "all" else F.regexp_replace("key", r"__[0-9]+$", "").isin(*DATE_KEYS)
    keys = named.filter(F.col("key") != "").groupBy(*SHEET).agg(
        F.array_sort(F.collect_list(F.struct("col_idx", "key", serial.alias("serial")))).alias("keys"),
        F.max("coverage").alias("coverage"), F.max("sheet_name").alias("sheet_name"),
        F.max("n_cols").alias("n_cols"),
    ).filter(F.col("coverage") >= opts.coverage)
    rows = sheet_rows(cells, layout, opts.limits.rows_per_sheet).join(keys, SHEET)

    def entry(k):
        # Inside a lambda nothing is shared: the cell is looked up and trimmed once.
        value = T.let(F.try_element_at("vals", k["col_idx"]), lambda v: T.let(T.utrim(v["text"]), lambda t: trimmed_value(t, v["raw_type"], k["serial"])))
        return F.struct(k["key"].alias("key"), F.coalesce(value, F.lit("")).alias("value"))

    out = rows.withColumn("rec", F.map_from_entries(F.transform("keys", entry)))
    if row_filter:
        out = out.filter(row_kept("rec", "vals", "n_cols", row_filter) | early_strong("rec", F.col("row_idx") - F.col("data_start_idx")))
    out = out.select(*SHEET, "sheet_name", "row_idx", "rec")
    if sources is not None:
        out = out.join(sources.select("source_id", "source_file", "source_type", "parent_source_id"), "source_id")
        out = out.withColumn("rec", F.map_concat("rec", F.create_map(F.lit("__source_file__"), F.col("source_file"))))
    demo = demo_record("sheet_name", "rec")
    return out.withColumn("is_demo", demo) if flag_demo else out.filter(~demo)


def row_kept(rec, vals, n_cols, row_filter: dict) -> Column:
    """Row filter: minimum fill, one of the required fields, excluded terms."""
    texts = F.transform(F.map_values(T.col(vals)), lambda v: F.lower(v["text"]))
    keep = F.size(texts) > 0
    if row_filter.get("min_nonempty_ratio") is not None:
        keep = keep & (F.size(texts) / T.col(n_cols) >= float(row_filter["min_nonempty_ratio"]))
    required = row_filter.get("required_fields_any") or []
    if required:
        keep = keep & F.coalesce(*[F.nullif(F.try_element_at(T.col(rec), F.lit(f)), F.lit("")) for f in required]).isNotNull()
    holds = lambda term: lambda v: F.contains(v, F.lit(term))
    for term in row_filter.get("exclude_if_contains_any") or []:
        if term:
            keep = keep & ~F.exists(texts, holds(str(term).lower()))
    return keep


def early_strong(rec, rows_in) -> Column:
    """One of the first three data rows holding a name and a long id."""
    rec = T.col(rec)
    get = lambda k: F.coalesce(T.utrim(F.try_element_at(rec, F.lit(k))), F.lit(""))
    strong = lambda k: F.replace(get(k), F.lit(" "), F.lit("")).rlike(r"^[0-9Xx]{15,}$")
    return (rows_in < 3) & (F.length(get("name")) >= 2) & (strong("id_number") | strong("employee_id"))


def demo_record(sheet_name, rec) -> Column:
    """Placeholder people on example sheets."""
    rec = T.col(rec)
    sheet = T.contains_any(F.lower(T.utrim(sheet_name)), ["示例", "样例", "example", "demo"])
    starred = F.coalesce(F.contains(F.try_element_at(rec, F.lit("id_number")), F.lit("*")), F.lit(False))
    words = F.exists(F.map_values(rec), lambda v: T.contains_any(F.lower(v), ["****", "xxx", "测试", "sample", "demo"]))
    return F.coalesce(sheet, F.lit(False)) & (starred | words)


def no_record_reason(per_sheet: DataFrame) -> DataFrame:
    """Why a sheet gave no record; null when it gave some. Needs records_count,
    coverage, header_mode, header_row_idx, data_rows and dropped_by_cap."""
    reason = (
        F.when(F.col("records_count") > 0, F.lit(None).cast("string"))
        .when(F.col("dropped_by_cap") > 0, F.lit("workbook_records_limit_reached"))
        .when(F.col("coverage") < 0.5, F.lit("schema_infer_failed_and_no_fallback"))
        .when((F.col("header_mode") == "no_header") & ((F.col("data_rows") == 0) | (F.col("header_row_idx") < 0)), F.lit("no_header_detected"))
        .when(F.col("data_rows") == 0, F.lit("no_data_rows"))
        .when(F.col("data_rows") > 0, F.lit("filtered_all_rows"))
        .otherwise(F.lit("read_failed"))
    )
    return per_sheet.withColumn("no_records_reason", reason)


def csv_sample(cells: DataFrame, layout: DataFrame, opts: SheetOptions = SheetOptions()) -> DataFrame:
    """Header lines and evenly spaced rows of each sheet as one CSV text."""
    end = data_end(opts.limits.rows_per_sheet)
    plan = layout.select(
        *SHEET, "n_cols", (F.col("header_row_idx") < 0).alias("headless"),
        F.array_union(
            F.when(F.col("header_row_idx") < 0, F.array().cast("array<int>")).otherwise(
                F.sequence("header_row_idx", F.col("header_row_idx") + F.col("header_rows") - 1)
            ),
            spread_rows(F.col("data_start_idx"), end, opts.head_rows),
        ).alias("picks"),
    )
    lines = with_text(cells).join(plan, SHEET).filter(F.array_contains("picks", F.col("row_idx"))).groupBy(*ROW, "col_idx").agg(F.min("text").alias("text")).groupBy(*ROW).agg(
        F.map_from_entries(F.collect_list(F.struct("col_idx", "text"))).alias("m")
    )
    per_sheet = lines.groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct("row_idx", "m"))).alias("rows"))
    line = lambda r: F.array_join(
        F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: F.coalesce(F.try_element_at(F.try_element_at("rows", r), c), F.lit(""))), ","
    )
    # Headless sheets list the stand-in names first.
    stand_in = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: F.concat(F.lit("col_"), c.cast("string"))), ",")
    body = F.transform("picks", line)
    text = F.array_join(F.when(F.col("headless"), F.array_prepend(body, stand_in)).otherwise(body), "\n")
    return plan.join(per_sheet, SHEET).select(*SHEET, text.alias("csv"))


def keep_first_records(records: DataFrame, cap: int) -> DataFrame:
    """The first `cap` records of a workbook in sheet and row order, flagged
    `truncated` when more were there; exact for any workbook size."""
    from ..common import positions

    placed = positions(records, ["source_id"], ["sheet_idx", "row_idx"], ["row_idx"])
    totals = records.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    return placed.filter(F.col("pos") <= cap).join(totals, "source_id").withColumn("truncated", F.col("_n") > cap).drop("_n")
