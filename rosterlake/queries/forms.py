"""Queries for forms, matching and filling."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed, scratch_path
from ..functions import dates as D
from ..operators import resolve as S
from ..options import FillOptions, IntentWords
from ..plans import fill as P
from ..plans import forms as FO
from ..plans import intake as N
from ..plans import matching as X
from ..plans import roster as RO
from ..sources import sinks as K
from ..sources.ledger import WrongSize, publish, published
from . import recipes as R
from .derive import RECORD_COLS, records
from .people import GOOD_DATE, KEYS, RECS, VALUES, _SCORE, _TYPES
from .registry import query

# Cells of four form layouts: (variant, row, column, text, type, format, formula).
LAYOUTS = """
SELECT * FROM (VALUES
  (0, 1, 1, '参保人', 'General', false), (0, 1, 3, '社保', 'General', false), (0, 1, 5, '公积金', 'General', false),
  (0, 2, 1, '姓名', 'General', false), (0, 2, 2, '证件号码', 'General', false), (0, 2, 3, '申报类型', 'General', false), (0, 2, 4, '费用年月', 'General', false), (0, 2, 5, '申报类型', 'General', false), (0, 2, 6, '费用年月', 'General', false),
  (0, 3, 3, '增', 'General', false), (0, 3, 4, '202512', '@', false), (0, 9, 2, '=A9', 'General', true), (0, 4, 6, '=D4', 'General', true),
  (1, 1, 1, '通讯录', 'General', false), (1, 2, 1, '姓名', 'General', false), (1, 2, 2, '证件号', 'General', false), (1, 2, 3, '入职时间', 'General', false), (1, 3, 1, '样例', 'General', false), (1, 3, 3, NULL, 'yyyy-mm-dd', false),
  (2, 3, 2, '姓名', 'General', false), (2, 3, 3, '工号', 'General', false), (2, 3, 4, '备注', 'General', false), (2, 9, 4, 'end', 'General', false),
  (3, 1, 1, 'Name', 'General', false), (3, 1, 2, 'Age', 'General', false), (3, 1, 3, 'City', 'General', false)
) AS l(variant, row, col, raw, number_format, is_formula)"""


def form_recipe(key: str, table: str) -> str:
    return f"""
SELECT concat('t', cast({key} AS string)) AS template_id, concat('f', cast({key} AS string), CASE {key} % 3 WHEN 0 THEN '社保增员表' WHEN 1 THEN '社保减员表' ELSE '表' END, '.xlsx') AS filename, cast({key} % 4 AS int) AS variant FROM {{{table}}}"""


PART_FORMS, NATION_FORMS, REGION_FORMS = form_recipe("p_partkey", "part"), form_recipe("n_nationkey", "nation"), form_recipe("r_regionkey", "region")


def _forms(t, recipe: str = PART_FORMS) -> DataFrame:
    cells = t.sql(recipe).join(F.broadcast(t.sql(LAYOUTS)), "variant")
    return cells.withColumn("sheet_idx", F.lit(0)).withColumn("sheet", F.lit("表1")).withColumn("raw_type", F.lit("string"))


def _tables(t, recipe: str = PART_FORMS) -> DataFrame:
    return t.sql(recipe).filter("variant = 2").select("template_id", F.lit(0).alias("sheet_idx"), F.lit("T1").alias("table_name"), F.lit("$B$3:$D$9").alias("ref"))


def _columns(t, recipe: str = PART_FORMS) -> DataFrame:
    # Described once, used by every later step.
    return checkpointed(FO.parse_forms(_forms(t, recipe), _tables(t, recipe)))


COLUMNS = """
SELECT * FROM (VALUES
  (0, 'region_1', 1, 'A', '参保人/姓名', '', 'General', 1, 9, 3), (0, 'region_1', 2, 'B', '证件号码', '', 'General', 1, 9, 3), (0, 'region_1', 3, 'C', '社保/申报类型', '增', 'General', 1, 9, 3), (0, 'region_1', 4, 'D', '费用年月', '202512', '@', 1, 9, 3), (0, 'region_1', 5, 'E', '公积金/申报类型', '', 'General', 1, 9, 3), (0, 'region_1', 6, 'F', '费用年月', '=D4', 'General', 1, 9, 3),
  (1, 'region_2', 1, 'A', '姓名', '样例', 'General', 2, 3, 3), (1, 'region_2', 2, 'B', '证件号', '', 'General', 2, 3, 3), (1, 'region_2', 3, 'C', '入职时间', '', 'yyyy-mm-dd', 2, 3, 3),
  (2, 'table_T1', 2, 'B', '姓名', '', 'General', 3, 9, 4), (2, 'table_T1', 3, 'C', '工号', '', 'General', 3, 9, 4), (2, 'table_T1', 4, 'D', '备注', '', 'General', 3, 9, 4),
  (3, 'region_1', 1, 'A', 'Name', '', 'General', 1, 1, 2), (3, 'region_1', 2, 'B', 'Age', '', 'General', 1, 1, 2), (3, 'region_1', 3, 'C', 'City', '', 'General', 1, 1, 2)
) AS c(variant, region_id, col_index, col_letter, header_path, samples, number_format, first_row, last_row, data_row)"""


@query("form_columns", f"SELECT template_id, region_id, col_index, col_letter, header_path, samples, number_format, first_row, last_row, data_row FROM ({PART_FORMS}) f JOIN ({COLUMNS}) c USING (variant)")
def form_columns(t):
    c = _columns(t)
    return c.select("template_id", "region_id", "col_index", "col_letter", "header_path", F.array_join("sample_values", "|").alias("samples"), "number_format", "first_row", "last_row", "data_row")


@query("form_two_lines", "SELECT concat('u', s_suppkey) AS template_id, v.col_letter, v.header_path FROM {supplier}, (VALUES ('A', '参保人/姓名'), ('B', '证件号码'), ('C', '社保/费用年月'), ('D', '公积金/公积金')) v(col_letter, header_path)")
def form_two_lines(t):
    grid = [("参保人", "姓名"), (None, "证件号码"), ("社保", "费用年月"), ("公积金", None)]
    cells = F.array(*[F.struct(F.lit(r + 1).alias("row"), F.lit(c + 1).alias("col"), F.lit(v).alias("raw")) for c, pair in enumerate(grid) for r, v in enumerate(pair) if v])
    x = t.supplier.select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("template_id"), F.explode(cells).alias("x")).select("template_id", "x.*")
    x = x.withColumns({"filename": F.lit("f"), "sheet_idx": F.lit(0), "sheet": F.lit("s"), "raw_type": F.lit("string"), "is_formula": F.lit(False), "number_format": F.lit("General")})
    return FO.parse_forms(x).select("template_id", "col_letter", "header_path")


@query("form_samples", f"SELECT template_id, v.row, v.sample FROM ({PART_FORMS}) f JOIN (VALUES (0, 3, '社保/申报类型=增,费用年月=202512'), (1, 3, '姓名=样例')) v(variant, row, sample) USING (variant)")
def form_samples(t):
    s = FO.sample_rows(_forms(t), _columns(t))
    return s.select("template_id", "row", F.array_join(F.transform(F.map_entries("sample"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("sample"))


@query("form_formulas", f"SELECT template_id, sheet, row, col FROM (SELECT template_id, variant, '表1' AS sheet FROM ({PART_FORMS}) f) f JOIN (SELECT * FROM ({LAYOUTS}) l WHERE is_formula) l USING (variant)")
def form_formulas(t):
    return FO.formula_cells(_forms(t))


@query("profile_detect", f"SELECT template_id, variant = 0 AS detected, 'YYYYMM' AS fee_month_format, variant = 0 AS is_insurance FROM ({PART_FORMS}) f WHERE variant < 3")
def profile_detect(t):
    cells, cols = _forms(t), _columns(t)
    d = FO.detect_profiles(cols, FO.sample_rows(cells, cols))
    return d.join(FO.is_insurance_form(cols), "template_id").select("template_id", "detected", "fee_month_format", "is_insurance")


@query("form_intents", f"SELECT template_id, CASE WHEN contains(filename, '增员') THEN 'add' WHEN contains(filename, '减员') THEN 'remove' WHEN variant = 1 THEN 'add' END AS intent FROM ({PART_FORMS}) f")
def form_intents(t):
    from ..operators.intent import form_intent

    return form_intent(_columns(t))


@query("profile_columns", f"SELECT template_id, v.role, v.col_letter, v.role_idx FROM ({PART_FORMS}) f JOIN (VALUES (0, 'name', 'A', 0), (0, 'id', 'B', 0), (0, 'declare', 'C', 0), (0, 'declare', 'E', 1), (0, 'fee_month', 'D', 0), (0, 'fee_month', 'F', 1), (1, 'name', 'A', 0), (1, 'id', 'B', 0), (2, 'name', 'B', 0)) v(variant, role, col_letter, role_idx) USING (variant)")
def profile_columns(t):
    return FO.profile_columns(_columns(t)).select("template_id", "role", "col_letter", "role_idx")


@query("header_lookup", f"SELECT template_id, v.header, v.col_letter FROM ({PART_FORMS}) f JOIN (VALUES (0, '费用年月', 'D'), (0, 'n a_m-e', NULL), (1, '费用年月', NULL), (1, 'n a_m-e', NULL), (2, '费用年月', NULL), (2, 'n a_m-e', NULL), (3, '费用年月', NULL), (3, 'n a_m-e', 'A')) v(variant, header, col_letter) USING (variant)")
def header_lookup(t):
    cols = _columns(t)
    wanted = cols.select("template_id").distinct().withColumn("header", F.explode(F.array(F.lit("费用年月"), F.lit("n a_m-e"))))
    return FO.lookup_headers(wanted, FO.header_lookup(cols)).select("template_id", "header", "col_letter")


@query("suffix_columns", f"SELECT template_id, v.suffix, v.col_letter FROM ({PART_FORMS}) f JOIN (VALUES (0, '年月', 'D'), (0, '年月', 'F'), (0, '姓名', 'A'), (1, '姓名', 'A'), (2, '姓名', 'B')) v(variant, suffix, col_letter) USING (variant) UNION ALL SELECT template_id, 'fee', v.c FROM ({PART_FORMS}) f, (VALUES ('D'), ('F')) v(c) WHERE variant = 0")
def suffix_columns(t):
    cols = _columns(t)
    parts = [FO.suffix_columns(cols, s).select("template_id", F.lit(s).alias("suffix"), "col_letter") for s in ("年月", "姓名")]
    fee = FO.fee_month_columns(cols, IntentWords()).select("template_id", F.lit("fee").alias("suffix"), "col_letter")
    return reduce(DataFrame.unionByName, [*parts, fee])


@query("clear_cells", f"SELECT template_id, r AS row, c AS col FROM ({PART_FORMS}) f, (SELECT unnest(range(3, 7)) AS r), (SELECT unnest(range(1, 7)) AS c) WHERE variant = 0 AND NOT (r = 4 AND c = 6)")
def clear_cells(t):
    cols = _columns(t).join(t.sql(PART_FORMS).filter("variant = 0"), "template_id", "left_semi")
    ranges = P.clear_ranges(cols, cols.select("template_id").distinct().withColumn("n_rows", F.lit(1)), extra=2)
    return P.clear_cells(ranges, FO.formula_cells(_forms(t))).select("template_id", "row", "col")


# ----------------------------------------------------------------- matching
_HEADS = "SELECT p_brand AS template_id, concat(p_name, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 's' WHEN 2 THEN ' no' WHEN 3 THEN '_x1' ELSE 'zzzzzz' END) AS header_path, min(p_partkey) AS col_index FROM {part} GROUP BY 1, 2"
_FKEYS = "SELECT DISTINCT p_brand AS template_id, concat(CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'a') ELSE concat(p_name, '_', p_type) END) AS key FROM {part}"
_FOLD = lambda c: f"regexp_replace(lower({c}), '[ _/-]+', '', 'g')"
_SIM = lambda a, b: f"CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN greatest(90, floor(100 * (1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))))) ELSE floor(100 * (1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})))) END"


@query("fuzzy_headers", f"""
WITH h AS (SELECT *, {_FOLD('header_path')} AS v FROM ({_HEADS}) x), k AS (SELECT template_id, {_FOLD('key')} AS nk, min(key) AS key FROM ({_FKEYS}) x GROUP BY 1, 2),
s AS (SELECT template_id, header_path, key, cast({_SIM('v', 'nk')} AS int) AS score FROM h JOIN k USING (template_id))
SELECT template_id, header_path, key, score FROM s WHERE score >= 80 QUALIFY row_number() OVER (PARTITION BY template_id, header_path ORDER BY score DESC, key) = 1""")
def fuzzy_headers(t):
    return X.match_headers(t.sql(_HEADS), t.sql(_FKEYS))


@query("enrich_mapping", f"""
WITH h AS (SELECT * FROM ({_HEADS}) x WHERE col_index % 7 <> 0), taken AS (SELECT template_id, upper(header_path) AS key FROM ({_HEADS}) x WHERE col_index % 7 = 0),
s AS (SELECT template_id, header_path, col_index, key, cast({_SIM('header_path', 'key')} AS int) AS score FROM h JOIN ({_FKEYS}) k USING (template_id)),
b AS (SELECT * FROM s WHERE score > 80 QUALIFY row_number() OVER (PARTITION BY template_id, header_path ORDER BY score DESC, key) = 1)
SELECT template_id, header_path, key, score FROM b WHERE NOT EXISTS (SELECT 1 FROM taken WHERE taken.template_id = b.template_id AND taken.key = b.key) QUALIFY row_number() OVER (PARTITION BY template_id, key ORDER BY col_index) = 1""")
def enrich_mapping(t):
    cols = t.sql(_HEADS)
    existing = cols.filter("col_index % 7 = 0").select("template_id", "header_path", F.upper("header_path").alias("key"))
    return X.enrich_mapping(cols, t.sql(_FKEYS), existing)


@query("synonym_match", f"SELECT template_id, v.header_path, v.key FROM ({PART_FORMS}) f JOIN (VALUES (0, '参保人/姓名', '名字'), (0, '证件号码', '身份证号'), (1, '姓名', '名字'), (1, '证件号', '身份证号'), (1, '入职时间', '入职'), (2, '姓名', '名字')) v(variant, header_path, key) USING (variant)")
def synonym_match(t):
    cols = _columns(t)
    keys = cols.select("template_id").distinct().select("template_id", F.posexplode(F.array(*[F.lit(k) for k in ("身份证号", "名字", "入职", "其他")])).alias("key_idx", "key"))
    return X.synonym_match(cols, keys).select("template_id", "header_path", "key")


# ------------------------------------------------------------------- months
@query("month_field", RECS + f" SELECT o_orderkey, CASE WHEN variant IN (0, 2) THEN coalesce(strftime({GOOD_DATE}, '%Y%m'), '') WHEN variant = 3 THEN coalesce(strftime({GOOD_DATE}, '%Y%m'), '') ELSE '' END AS m1, CASE WHEN variant IN (0, 2, 3) AND {GOOD_DATE} IS NOT NULL THEN CASE WHEN o_orderkey % 2 = 0 THEN strftime({GOOD_DATE}, '%Y/%m') ELSE strftime({GOOD_DATE}, '%Y-%m') END ELSE '' END AS m2 FROM r")
def month_field(t):
    r = records(t).select("o_orderkey", "rec")
    style = F.when(F.col("o_orderkey") % 2 == 0, F.lit("YYYY/MM")).otherwise(F.lit("YYYY-MM"))
    x = P.add_month_field(P.add_month_field(r, "m1", ["start_date", "leave_date"], "YYYYMM"), "m2", ["start_date", "leave_date"], style)
    return x.select("o_orderkey", F.try_element_at("rec", F.lit("m1")).alias("m1"), F.try_element_at("rec", F.lit("m2")).alias("m2"))


@query("fee_month", RECS + f""" SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '2024-05' ELSE strftime(CASE WHEN variant = 1 THEN {GOOD_DATE} WHEN variant = 4 THEN {GOOD_DATE} END, '%Y-%m') END AS by_remove,
  CASE WHEN o_orderkey % 10 = 0 THEN '2024-05' ELSE strftime(CASE WHEN variant = 1 THEN {GOOD_DATE} WHEN variant = 4 THEN {GOOD_DATE} END, '%Y-%m') END AS by_add FROM r""")
def fee_month(t):
    r = records(t).withColumn("rec", F.when(F.col("o_orderkey") % 10 == 0, F.map_concat("rec", F.create_map(F.lit("缴费 年月"), F.lit("2024/5")))).otherwise(F.col("rec")))
    m = lambda i: F.date_format(P.fee_month("rec", F.lit(i)), "yyyy-MM")
    return r.select("o_orderkey", m("remove").alias("by_remove"), m("add").alias("by_add"))


@query("auto_fields", RECS + f""", m AS (SELECT strftime({GOOD_DATE}, '%Y%m') AS m FROM r WHERE variant IN (1, 4) AND {GOOD_DATE} IS NOT NULL AND regexp_matches(dt, '20[0-9]{{2}}[年./-]?[0-9]{{1,2}}') ORDER BY source_type, source_file, source_id, sheet_idx, row_idx LIMIT 1)
SELECT template_id, v.header_path, v.col_index, v.key, CASE WHEN v.key IS NULL THEN m END AS constant FROM ({NATION_FORMS}) f JOIN (VALUES (0, '社保/申报类型', 3, '申报类型'), (0, '公积金/申报类型', 5, '申报类型'), (0, '费用年月', 4, NULL), (0, '费用年月', 6, NULL)) v(variant, header_path, col_index, key) USING (variant), m""")
def auto_fields(t):
    cells, cols = _forms(t, NATION_FORMS), _columns(t, NATION_FORMS)
    r = records(t).select(*RECORD_COLS)
    keys = r.select("source_id", F.posexplode(F.map_keys("rec")).alias("i", "key")).groupBy("key").agg(F.min(F.struct("source_id", "i")).alias("seen"))
    keys = cols.select("template_id").distinct().withColumn("on", F.lit(1)).join(keys.withColumn("on", F.lit(1)), "on").drop("on")
    styles = FO.sample_style(FO.sample_rows(cells, cols), cols.filter("header_path = '费用年月'").select("template_id", "header_path"), "YYYY-MM")
    intents = t.sql(NATION_FORMS).select("template_id", F.lit("add").alias("intent"))
    taken = cols.filter("header_path = '姓名'").select("template_id", "header_path")
    return P.auto_fields(cols, keys, r, styles, intents, taken)


# ---------------------------------------------------------------- placement
def _assigned(t) -> DataFrame:
    """Each record goes to one of the forms."""
    return records(t).select(*RECORD_COLS, F.concat(F.lit("t"), (F.col("o_custkey") % 25).cast("string")).alias("template_id"))


_MAP = "(VALUES (0, '姓名', 'name', 'A', 1), (0, '证件号码', 'id_number', 'B', 2), (1, '姓名', 'name', 'A', 1), (1, '证件号', 'id_number', 'B', 2), (2, '姓名', 'name', 'B', 2), (3, 'Name', 'name', 'A', 1)) v(fv, header, key, col_letter, col)"
_PLACED = RECS + f""", f AS (SELECT template_id, variant AS fv, CASE variant WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 2 END AS data_row FROM ({NATION_FORMS}) z),
p AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY source_type, source_file, source_id, sheet_idx, row_idx) AS pos FROM (SELECT *, concat('t', o_custkey % 25) AS template_id FROM r) q JOIN f USING (template_id)),
w AS (SELECT template_id, cast(data_row + pos - 1 AS int) AS row, v.col_letter, CASE v.key WHEN 'name' THEN CASE WHEN variant IN (0, 2, 3) THEN nm WHEN variant = 5 THEN concat('9', o_custkey) ELSE '' END ELSE CASE WHEN variant IN (0, 2) THEN idn WHEN variant = 5 THEN iso_date ELSE '' END END AS value, v.key, p.fv FROM p JOIN {_MAP} USING (fv))
"""


def _mapping(t) -> DataFrame:
    rows = t.sql("SELECT * FROM (VALUES (0, '姓名', 'name', 0), (0, '证件号码', 'id_number', 1), (0, '证件号码', 'name', 2), (0, '没有', 'x', 3), (1, '姓名', 'name', 0), (1, '证件号', 'id_number', 1), (2, '姓名', 'name', 0), (3, 'NAME', 'name', 0)) AS m(variant, header, key, ord)")
    return t.sql(NATION_FORMS).join(rows, "variant").select("template_id", "header", "key", "ord")


def _constants(t) -> DataFrame:
    return t.sql(NATION_FORMS).filter("variant = 0").select("template_id", F.lit("申报类型").alias("header"), F.lit("增").alias("value"), F.lit(0).alias("ord"))


@query("records_to_cells", _PLACED + "SELECT template_id, row, col_letter, key, value FROM w UNION ALL SELECT template_id, cast(data_row + pos - 1 AS int), 'C', '__const__申报类型', '增' FROM p WHERE fv = 0")
def records_to_cells(t):
    cols = _columns(t, NATION_FORMS)
    plan = P.column_plan(_mapping(t), cols, _constants(t))
    w = P.plan_cells(P.place_records(_assigned(t), ["template_id"]), plan, cols)
    return w.select("template_id", "row", "col_letter", "key", "value")


@query("cells_written", _PLACED + "SELECT template_id, row, col_letter, key, value FROM w")
def cells_written(t):
    """Planned cells written a folder per form and read back."""
    cols, path = _columns(t, NATION_FORMS), scratch_path(t.spark, "cells")
    K.write_cells(P.plan_cells(P.place_records(_assigned(t), ["template_id"]), P.column_plan(_mapping(t), cols), cols), path)
    back = t.spark.read.schema("template_id string, row int, col_letter string, key string, value string").parquet(path)
    return back.select("template_id", "row", "col_letter", "key", "value")


@query("published_cells", _PLACED + """SELECT 'cells' AS part, template_id, row, col_letter, key, value, NULL AS n FROM w
UNION ALL SELECT 'summary', template_id, NULL, NULL, NULL, NULL, count(*) FROM w GROUP BY 2""")
def published_cells(t):
    """Planned cells and their counts per form, published together. A former run of the job is
    replaced; one that lost rows on the way is refused."""
    cols, root = _columns(t, NATION_FORMS), scratch_path(t.spark, "published")
    cells = checkpointed(P.plan_cells(P.place_records(_assigned(t), ["template_id"]), P.column_plan(_mapping(t), cols), cols).select("template_id", "row", "col_letter", "key", "value"))
    planned = {"cells": cells.count()}
    tables = lambda some: {"cells": some, "summary": some.groupBy("template_id").agg(F.count(F.lit(1)).alias("n"))}
    publish(root, tables(cells.withColumn("value", F.lit("former"))), planned=planned)
    publish(root, tables(cells), planned=planned)
    try:
        publish(root, tables(cells.filter("col_letter <> 'A'")), planned=planned)
    except WrongSize:
        pass
    back = lambda name: published(t.spark, root, name).select(F.lit(name).alias("part"), "*")
    return back("cells").unionByName(back("summary"), allowMissingColumns=True)


@query("unknown_headers", f"SELECT template_id AS scope, 'template_header_not_found' AS code, '没有' AS detail FROM ({NATION_FORMS}) f WHERE variant = 0")
def unknown_headers(t):
    return P.unknown_headers(_mapping(t), _columns(t, NATION_FORMS))


@query("column_overrides", f"SELECT template_id, v.col_letter, v.key FROM ({NATION_FORMS}) f JOIN (VALUES (0, 'C', 'id_number'), (0, 'F', 'phone'), (1, 'C', 'id_number'), (1, 'F', 'phone'), (2, 'B', 'name'), (2, 'C', 'id_number'), (2, 'F', 'phone'), (3, 'C', 'id_number'), (3, 'F', 'phone')) v(variant, col_letter, key) USING (variant)")
def column_overrides(t):
    opts = FillOptions(allowed_columns=("b", "C", "F"), forced_columns={"id_number": "C", "phone": "f"})
    return P.column_plan(_mapping(t), _columns(t, NATION_FORMS), None, opts).select("template_id", "col_letter", "key")


@query("constant_columns", f"SELECT template_id, '姓名' AS header, 'x' AS value, false AS kept FROM ({NATION_FORMS}) f WHERE variant < 3 UNION ALL SELECT template_id, 'NAME', 'x', false FROM ({NATION_FORMS}) f WHERE variant = 3 UNION ALL SELECT template_id, '证件号码', 'x', false FROM ({NATION_FORMS}) f WHERE variant = 0 UNION ALL SELECT template_id, v.h, NULL, true FROM ({NATION_FORMS}) f, (VALUES (0, '证件号码'), (0, '没有'), (1, '证件号')) v(variant, h) WHERE f.variant = v.variant")
def constant_columns(t):
    kept, const = P.promote_constants(_mapping(t), t.spark.createDataFrame([("name", "x")], "key string, value string"))
    return const.withColumn("kept", F.lit(False)).unionByName(kept.select("template_id", "header", F.lit(None).cast("string").alias("value"), F.lit(True).alias("kept")))


@query("typed_writes", _PLACED + """ SELECT template_id, row, col_letter, CASE WHEN value = '' THEN 'empty' WHEN regexp_matches(value, '^[0-9]{17}X$') THEN 'text' WHEN regexp_matches(value, '^[0-9]{4}-') THEN 'date' WHEN regexp_matches(value, '^[0-9]+$') THEN 'long' ELSE 'text' END AS kind FROM w WHERE NOT (fv = 0 AND col_letter = 'B' AND row = 9)""")
def typed_writes(t):
    cols, cells = _columns(t, NATION_FORMS), _forms(t, NATION_FORMS)
    w = P.plan_cells(P.place_records(_assigned(t), ["template_id"]), P.column_plan(_mapping(t), cols), cols)
    typed = P.typed_writes(w, FO.formula_cells(cells), cells.select("template_id", "sheet", "row", "col", "number_format"))
    return typed.select("template_id", "row", "col_letter", F.col("typed")["kind"].alias("kind"))


# Every record goes to every form left open, in one order: the first keys of its kind of
# source, as many as the form's headers are told by name (else all three, by place).
_FALLBACK = f"""fp AS (SELECT *, {KEYS} AS ks, {VALUES} AS vs, row_number() OVER (ORDER BY source_type, source_file, source_id, sheet_idx, row_idx) AS pos FROM r),
fb AS (SELECT template_id, fv, variant, pos, ks, vs, unnest(range(1, 1 + CASE WHEN fv = 1 AND variant = 1 OR fv = 2 AND variant = 4 THEN 1 WHEN fv = 1 AND variant = 4 OR fv = 2 AND variant = 1 THEN 2 ELSE 3 END)) AS i
  FROM (SELECT template_id, variant AS fv FROM ({REGION_FORMS}) z WHERE variant > 0) g, fp),
fc AS (SELECT template_id, cast(CASE fv WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 3 END + pos - 1 AS int) AS row, CASE fv WHEN 2 THEN ['B', 'C', 'D'] ELSE ['A', 'B', 'C'] END[i] AS col_letter, ks[i] AS key, vs[i] AS value FROM fb)"""


@query("fallback_cells", RECS + ", " + _FALLBACK + " SELECT template_id, row, col_letter, key, value FROM fc")
def fallback_cells(t):
    cols = _columns(t, REGION_FORMS)
    planned = t.sql(REGION_FORMS).filter("variant = 0").select("template_id")
    return P.fallback_cells(records(t).select(*RECORD_COLS), cols, planned).select("template_id", "row", "col_letter", "key", "value")


# ------------------------------------------------------------------- roster
@query("extract_people", _TYPES + f""", bid AS (SELECT source_id, key FROM kt WHERE key <> '备用' AND id > 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id DESC, seen) = 1), x AS (SELECT *, CASE WHEN sheet_name IN ('增员', '人员') THEN 'sheet_blocked' WHEN variant IN (0, 2, 4) THEN 'required_field_missing:end_date' WHEN {GOOD_DATE} IS NULL THEN 'no_date' END AS skipped FROM r)
SELECT o_orderkey, skipped, CASE WHEN skipped IS NULL THEN nm END AS name, CASE WHEN skipped IS NULL THEN CASE WHEN variant < 5 THEN idn WHEN bid.key = 'name' AND length(concat('9', o_custkey)) >= 4 THEN concat('9', o_custkey) ELSE '' END END AS id_number, CASE WHEN skipped IS NULL THEN strftime({GOOD_DATE}, '%Y-%m-%d') END AS event_date, CASE WHEN skipped IS NULL THEN CASE WHEN variant = 1 THEN reason ELSE '' END END AS reason FROM x LEFT JOIN bid USING (source_id)""")
def extract_people(t):
    r = records(t)
    e = RO.extract_people(r.select(*RECORD_COLS), "remove")
    ok = F.col("skipped").isNull()
    keys = r.select("o_orderkey", "source_id", "sheet_idx", "row_idx", "variant")
    return e.join(keys, ["source_id", "sheet_idx", "row_idx"]).select(
        "o_orderkey", "skipped", F.when(ok, F.col("name")).alias("name"), F.when(ok, F.col("id_number")).alias("id_number"),
        F.when(ok, D.iso("event_date")).alias("event_date"), F.when(ok, F.col("reason")).alias("reason"),
    )


@query("skip_counts", RECS + f", x AS (SELECT CASE WHEN sheet_name IN ('减员', '离职_1') THEN 'sheet_blocked' WHEN variant NOT IN (0, 2) THEN 'required_field_missing:start_date' WHEN {GOOD_DATE} IS NULL THEN 'no_date' END AS skipped FROM r WHERE variant <> 3) SELECT skipped, count(*) AS n FROM x WHERE skipped IS NOT NULL GROUP BY 1")
def skip_counts(t):
    return RO.skip_counts(RO.extract_people(records(t).select(*RECORD_COLS), "add"))


# Every source that is not excluded; the date key decides which of them count.
_ROSTER = _SCORE + _TYPES[len(RECS):] + f""", bid AS (SELECT source_id, key FROM kt WHERE key <> '备用' AND id > 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id DESC, seen) = 1),
top AS (SELECT DISTINCT intent, source_id FROM z WHERE NOT excluded),
e AS (SELECT t.intent, r.source_type, r.source_file, r.source_id, r.sheet_idx, r.row_idx, nm AS name,
  CASE WHEN r.variant < 5 THEN idn WHEN bid.key = 'name' AND length(concat('9', o_custkey)) >= 4 THEN concat('9', o_custkey) ELSE '' END AS id_number, {GOOD_DATE} AS event_date, CASE WHEN t.intent = 'remove' AND r.variant = 1 THEN reason ELSE '' END AS reason FROM top t JOIN r USING (source_id) LEFT JOIN bid USING (source_id)
  WHERE {GOOD_DATE} IS NOT NULL AND (t.intent = 'add' AND r.variant = 0 OR t.intent = 'remove' AND r.variant IN (1, 3, 5)) AND CASE t.intent WHEN 'remove' THEN sheet_name IN ('', '减员', '离职_1') ELSE sheet_name NOT IN ('减员', '离职_1') END),
k AS (SELECT *, length(concat_ws('|', name, id_number, cast(event_date AS string), reason)) AS size FROM e),
a AS (SELECT * FROM k WHERE length(id_number) >= 4 QUALIFY row_number() OVER (PARTITION BY intent, id_number ORDER BY size DESC, source_type, source_file, source_id, sheet_idx, row_idx) = 1),
b AS (SELECT * FROM k WHERE length(id_number) < 4 QUALIFY row_number() OVER (PARTITION BY intent, name, event_date ORDER BY size DESC, source_type, source_file, source_id, sheet_idx, row_idx) = 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.intent = b.intent AND a.name = b.name)),
q AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY source_type, source_file, source_id, sheet_idx, row_idx) AS pos FROM u)
"""


@query("roster_people", _ROSTER + "SELECT intent, name, id_number, strftime(event_date, '%Y-%m-%d') AS event_date, source_id, row_idx FROM u")
def roster_people(t):
    r = records(t).select(*RECORD_COLS)
    people = RO.roster_people_of(r, ["add", "remove"])
    one = lambda i: people[i].select(F.lit(i).alias("intent"), "name", "id_number", D.iso("event_date").alias("event_date"), "source_id", "row_idx")
    return one("add").unionByName(one("remove"))


@query("roster_plan", _ROSTER + f""", f AS (SELECT template_id, CASE WHEN contains(filename, '增员') THEN 'add' ELSE 'remove' END AS intent FROM ({NATION_FORMS}) z WHERE variant = 0 AND NOT contains(filename, '表.') OR (variant = 0 AND contains(filename, '员表'))),
g AS (SELECT DISTINCT template_id, intent FROM f)
SELECT template_id, cast(3 + pos - 1 AS int) AS row, v.c AS col_letter, CASE v.k WHEN 'n' THEN name WHEN 'i' THEN id_number WHEN 'd' THEN CASE intent WHEN 'add' THEN '增' ELSE '减' END ELSE strftime(date_trunc('month', event_date) + INTERVAL 1 MONTH, '%Y%m') END AS value
FROM g JOIN q USING (intent), (VALUES ('A', 'n'), ('B', 'i'), ('C', 'd'), ('D', 'f'), ('E', 'd'), ('F', 'f')) v(c, k)""")
def roster_plan(t):
    cells, cols = _forms(t, NATION_FORMS), _columns(t, NATION_FORMS)
    from ..operators.intent import form_file_intent

    forms = t.sql(NATION_FORMS).select("template_id", form_file_intent("filename").alias("intent")).filter("intent IS NOT NULL")
    w = RO.roster_plan(records(t).select(*RECORD_COLS), cols, forms, FO.sample_rows(cells, cols))
    return w.select("template_id", "row", "col_letter", "value")


@query("row_checks", _ROSTER + "SELECT intent, pos, CASE intent WHEN 'add' THEN '增' ELSE '减' END AS declare_type, strftime(date_trunc('month', event_date) + INTERVAL 1 MONTH, '%Y%m') AS fee_month, 0 AS n_errors FROM q")
def row_checks(t):
    from ..common import positions

    people = RO.roster_people_of(records(t).select(*RECORD_COLS), ["add", "remove"])

    def one(i):
        x = positions(RO.check_rows(people[i], i).withColumn("intent", F.lit(i)), ["intent"], RO.ORDER, ["row_idx"])
        return x.select("intent", "pos", "declare_type", "fee_month", F.size("errors").alias("n_errors"))

    return one("add").unionByName(one("remove"))


_INS = RECS + f""", bk AS (SELECT DISTINCT source_id FROM r WHERE source_type = 'excel' AND contains(source_file, '离职')), ak AS (SELECT DISTINCT source_id FROM r WHERE source_type = 'excel' AND contains(source_file, '入职')),
m AS (SELECT source_type, source_file, source_id, sheet_idx, row_idx, nm AS name, idn AS employee_id, dt AS leave_date, '' AS leave_date_text FROM r WHERE variant = 3
  UNION ALL SELECT source_type, source_file, source_id, sheet_idx, row_idx, nm, idn, coalesce(strftime({GOOD_DATE}, '%Y-%m-%d'), ''), dt FROM r SEMI JOIN bk USING (source_id) WHERE sheet_name IN ('减员', '离职_1')),
x AS (SELECT *, 1 + CASE WHEN employee_id <> '' THEN 1 ELSE 0 END + CASE WHEN leave_date <> '' THEN 1 ELSE 0 END + CASE WHEN leave_date_text <> '' THEN 1 ELSE 0 END AS filled FROM m),
a AS (SELECT * FROM x WHERE employee_id <> '' QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY filled DESC, source_type, source_file, source_id, sheet_idx, row_idx) = 1),
b AS (SELECT * FROM x WHERE employee_id = '' QUALIFY row_number() OVER (PARTITION BY name, leave_date ORDER BY filled DESC, source_type, source_file, source_id, sheet_idx, row_idx) = 1),
u AS (SELECT 'remove' AS intent, source_type, source_file, source_id, sheet_idx, row_idx, name, try_cast(replace(leave_date, '/', '-') AS date) AS d FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.name = b.name AND a.leave_date = b.leave_date)) y
  UNION ALL SELECT 'add', source_type, source_file, source_id, sheet_idx, row_idx, nm, {GOOD_DATE} FROM r SEMI JOIN ak USING (source_id) WHERE sheet_name = '增员'),
q AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY source_type, source_file, source_id, sheet_idx, row_idx) AS pos FROM u WHERE d IS NOT NULL)
"""


@query("insurance_rows", _INS + "SELECT intent, name, CASE WHEN d IS NULL THEN 'date_parse_failed' END AS skipped, strftime(date_trunc('month', d) + INTERVAL 1 MONTH, '%Y%m') AS fee_month, source_id, row_idx FROM u")
def insurance_rows(t):
    r = records(t).select(*RECORD_COLS)
    one = lambda i: RO.insurance_rows(r, i).select(F.lit(i).alias("intent"), "name", "skipped", "fee_month", "source_id", "row_idx")
    return one("remove").unionByName(one("add"))


@query("insurance_plan", _INS + f""", g AS (SELECT template_id, CASE WHEN contains(filename, '增员') THEN 'add' ELSE 'remove' END AS intent FROM ({NATION_FORMS}) z WHERE variant = 0 AND contains(filename, '员'))
SELECT template_id, cast(3 + pos - 1 AS int) AS row, v.c AS col_letter, CASE v.c WHEN 'A' THEN name WHEN 'C' THEN CASE intent WHEN 'add' THEN '增' ELSE '减' END ELSE strftime(date_trunc('month', d) + INTERVAL 1 MONTH, '%Y%m') END AS value FROM g JOIN q USING (intent), (VALUES ('A'), ('C'), ('D')) v(c)""")
def insurance_plan(t):
    from ..operators.intent import form_file_intent

    forms = t.sql(NATION_FORMS).select("template_id", form_file_intent("filename").alias("intent")).filter("intent IS NOT NULL")
    return RO.insurance_plan(records(t).select(*RECORD_COLS), _columns(t, NATION_FORMS), forms).select("template_id", "row", "col_letter", "value")


def _form_list(t, recipe: str) -> DataFrame:
    k = F.substring("template_id", 2, 20).cast("int")
    return t.sql(recipe).select(
        "template_id", "filename", F.when(k % 7 == 1, F.lit("own")).otherwise(F.lit("none_such")).alias("template_key"), F.when(k % 11 == 1, F.lit(" custom ")).alias("strategy_key")
    )


def _registry(t) -> DataFrame:
    builtin = t.spark.createDataFrame([("social_security_default", "roster"), ("own", "roster")], "template_key string, strategy_key string")
    return RO.merge_registry(builtin, t.spark.createDataFrame([(" own ", "mine"), ("bad", " ")], "template_key string, strategy_key string"))


_ROUTE = f"""SELECT template_id, CASE WHEN k % 11 = 1 THEN 'custom' WHEN k % 7 = 1 THEN 'mine' WHEN variant = 0 THEN 'roster' WHEN k % 3 < 2 THEN 'insurance' ELSE 'none' END AS strategy, CASE k % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' ELSE CASE WHEN variant = 0 AND k % 7 <> 1 AND k % 11 <> 1 THEN 'add' END END AS intent,
  CASE WHEN k % 11 <> 1 AND k % 7 <> 1 AND variant <> 0 AND k % 3 = 2 THEN 'insurance_intent_unknown' END AS warning FROM (SELECT *, cast(substr(template_id, 2) AS bigint) AS k FROM (@FORMS@) f) z"""


@query("route_forms", _ROUTE.replace("@FORMS@", PART_FORMS))
def route_forms(t):
    return RO.route_forms(_form_list(t, PART_FORMS), _columns(t), _registry(t)).select("template_id", "strategy", "intent", "warning")


@query("plan_fill", _ROSTER + f""", f AS (SELECT template_id, CASE k % 3 WHEN 1 THEN 'remove' ELSE 'add' END AS intent FROM (SELECT *, cast(substr(template_id, 2) AS bigint) AS k FROM ({NATION_FORMS}) n) z WHERE variant = 0 AND k % 11 <> 1 AND k % 7 <> 1)
SELECT template_id, 'roster' AS strategy, count(*) * 6 AS cells_written, count(*) AS rows_written, 'x' AS mark FROM f JOIN q USING (intent) GROUP BY 1 UNION ALL SELECT concat('t', n_nationkey), 'custom', 1, 1, 'x' FROM {{nation}} WHERE n_nationkey % 11 = 1""")
def plan_fill(t):
    cols = _columns(t, NATION_FORMS)
    one_cell = lambda recs, c, forms: forms.select("template_id", F.lit("表1").alias("sheet"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("A").alias("col_letter"), F.lit("k").alias("key"), F.lit("v").alias("value"))
    w = RO.plan_fill(
        records(t).select(*RECORD_COLS), cols, RO.route_forms(_form_list(t, NATION_FORMS), cols, _registry(t)), {"custom": one_cell}, lambda d: d.withColumn("mark", F.lit("x")),
    )
    w = checkpointed(w.filter("strategy <> 'insurance'"))
    return P.written_counts(w).join(w.select("template_id", "strategy", "mark").distinct(), "template_id")


@query("run_fill", _ROSTER + ", " + _FALLBACK + f""", g AS (SELECT template_id, CASE cast(substr(template_id, 2) AS int) % 3 WHEN 1 THEN 'remove' ELSE 'add' END AS intent FROM ({REGION_FORMS}) z WHERE variant = 0),
rw AS (SELECT template_id, 'roster' AS strategy, cast(2 + pos AS int) AS row, v.c AS col_letter, CASE v.k WHEN 'n' THEN name WHEN 'i' THEN id_number WHEN 'd' THEN CASE intent WHEN 'add' THEN '增' ELSE '减' END ELSE strftime(date_trunc('month', event_date) + INTERVAL 1 MONTH, '%Y%m') END AS value
  FROM g JOIN q USING (intent), (VALUES ('A', 'n'), ('B', 'i'), ('C', 'd'), ('D', 'f'), ('E', 'd'), ('F', 'f')) v(c, k))
SELECT * FROM rw WHERE NOT (row = 9 AND col_letter = 'B' OR row = 4 AND col_letter = 'F') UNION ALL SELECT template_id, 'fallback', row, col_letter, value FROM fc""")
def run_fill(t):
    """All cells of all forms; formula cells of the forms are left as they are."""
    cells = _forms(t, REGION_FORMS)
    forms = t.sql(REGION_FORMS).select("template_id", "filename", F.lit(None).cast("string").alias("template_key"), F.lit(None).cast("string").alias("strategy_key"))
    w = N.run_fill(records(t).select(*RECORD_COLS), cells, forms, _registry(t), _tables(t, REGION_FORMS))
    return w.select("template_id", "strategy", "row", "col_letter", "value")
