"""Queries for forms filled from an outside reader's mapping."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import mapped as M
from ..plans import roster as RO
from .derive import RECORD_COLS, records
from .forms import NATION_FORMS, _columns
from .people import GOOD_DATE, _INT
from .registry import query

# A reply per form: layout 0 reads additions (even forms) or rosters (odd ones), layout 1
# notices, layout 2 mails, layout 3 names. Some say things that do not hold.
_REPLIES = {
    (0, 0): '{"column_mapping": {"参保人/姓名": "name", "证件号码": "id_number", "费用年月": "__m__"}, "constant_values": {"申报类型": "增"}, "record_filter": {"field": "部门", "values": ["1-urgent", " 2-HIGH "]}, "derived_fields": [{"new_key": "__m__", "op": "MONTH_FROM_DATE", "args": {"source_keys": ["none", "start_date"], "strategy": "first_non_empty", "output_format": "from_template_sample"}}, {"new_key": "", "op": "MONTH_FROM_DATE"}]}',
    (0, 1): '```json\\n{"column_mapping": {"参保人/姓名": "员工姓名", "证件号码": "身份证号", "没有": "x"}, "constant_values": {"申报类型": "增"}}\\n```',
    (1, 0): '{"姓名": "姓名", "证件号": "工号", "入职时间": "离职日期", "record_filter": {"field": "离职原因", "values": ["个人原因"], "exclude": true}}',
    (2, 0): '{"column_mapping": {"姓名": "name", "工号": "employee_id", "备注": "intent"}, "record_filter": {"field": "申报类型", "values": ["减员"]}}',
    (3, 0): '{"column_mapping": {"NAME": "name", "Age": "__y__"}, "derived_fields": [{"new_key": "__y__", "op": "MONTH_FROM_DATE", "args": {"source_keys": ["start_date", "leave_date", "termination_date"], "strategy": "first_non_empty", "output_format": "YYYY/MM"}}]}',
}


def _replies(t) -> DataFrame:
    key = F.substring("template_id", 2, 20).cast("int")
    said = F.lit(None).cast("string")
    for (variant, odd), text in _REPLIES.items():
        hit = (F.col("variant") == variant) & ((key % 8 >= 4) == bool(odd) if variant == 0 else F.lit(True))
        said = F.when(hit, F.lit(text.replace("\\n", "\n"))).otherwise(said)
    return t.sql(NATION_FORMS).select("template_id", said.alias("reply"))


def _forms(t) -> DataFrame:
    return t.sql(NATION_FORMS).select("template_id", "filename", F.lit(None).cast("string").alias("intent"))


_FITS = lambda i: f"""p_{i} AS (SELECT *, CASE WHEN record_type IS NOT NULL THEN record_type = '{i}' ELSE coalesce(file_intent = '{i}', true) AND coalesce(explicit_intent = '{i}', true) AND CASE WHEN scanned_intent IS NULL THEN coalesce(file_intent = '{i}', false) OR coalesce(explicit_intent = '{i}', false) ELSE scanned_intent = '{i}' END END AS strict,
  CASE WHEN record_type IS NOT NULL THEN record_type = '{i}' ELSE coalesce(file_intent = '{i}', true) AND coalesce(explicit_intent = '{i}', true) END AS relaxed FROM t),
fit_{i} AS (SELECT o_orderkey FROM (SELECT *, bool_or(strict) OVER (PARTITION BY source_id) AS any_strict FROM p_{i}) z WHERE CASE WHEN any_strict THEN strict ELSE relaxed END)"""  # noqa: E731
_KIND = "CASE o_orderkey % 3 WHEN 0 THEN '增' WHEN 1 THEN '减员' ELSE '新增' END"
_MONTH = lambda f: f"coalesce(strftime({GOOD_DATE}, '{f}'), '')"
# Records of each form: its intent, its filter; then the gate; then places.
_MAPPED = _INT + "," + _FITS("add") + "," + _FITS("remove") + f""",
f AS (SELECT template_id, variant AS fv, k % 8 >= 4 AS odd, CASE WHEN variant = 0 THEN 'add' WHEN contains(filename, '增员') THEN 'add' WHEN contains(filename, '减员') THEN 'remove' WHEN variant = 1 THEN 'add' END AS intent FROM (SELECT *, cast(substr(template_id, 2) AS bigint) AS k FROM ({NATION_FORMS}) n) y),
m AS (SELECT f.*, r.* FROM f, r WHERE CASE intent WHEN 'add' THEN r.o_orderkey IN (SELECT o_orderkey FROM fit_add) WHEN 'remove' THEN r.o_orderkey IN (SELECT o_orderkey FROM fit_remove) ELSE true END
  AND CASE WHEN fv = 0 AND NOT odd THEN r.variant = 0 AND prio IN ('1-URGENT', '2-HIGH') WHEN fv = 1 THEN r.variant <> 1 OR reason <> '个人原因' WHEN fv = 2 AND coalesce(intent <> 'add', true) THEN r.variant = 4 AND {_KIND} = '减员' ELSE true END),
g AS (SELECT *, CASE fv WHEN 0 THEN CASE WHEN odd AND variant = 4 THEN (1 + (idn <> '')::int) / 3 WHEN NOT odd AND variant IN (0, 2) THEN (1 + (idn <> '')::int) / 2 WHEN NOT odd AND variant = 3 THEN 0.5 WHEN NOT odd AND variant = 5 THEN 1 ELSE 0 END
  WHEN 1 THEN CASE WHEN variant = 1 THEN (1 + (idn <> '')::int + (dt <> '')::int) / 3 ELSE 0 END WHEN 2 THEN CASE WHEN variant = 3 THEN (2 + (idn <> '')::int) / 3 WHEN variant IN (0, 2, 5) THEN 1 / 3 ELSE 0 END ELSE CASE WHEN variant IN (0, 2, 3, 5) THEN 1 ELSE 0 END END AS ratio FROM m),
w AS (SELECT * FROM (SELECT *, max(ratio) OVER (PARTITION BY template_id) AS best FROM g) z WHERE ratio >= 0.4 OR best < 0.4),
q AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY source_type, source_file, source_id, sheet_idx, row_idx) AS pos, CASE WHEN variant = 5 THEN concat('9', o_custkey) WHEN variant IN (0, 2, 3) THEN nm END AS name_value FROM w),
c AS (SELECT template_id, CASE fv WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 3 END + pos - 1 AS row, unnest(CASE fv WHEN 0 THEN ['A', 'B', 'C', 'D', 'E'] WHEN 1 THEN ['A', 'B', 'C'] WHEN 2 THEN ['B', 'C', 'D'] ELSE ['A', 'B'] END) AS col_letter,
  unnest(CASE fv WHEN 0 THEN CASE WHEN odd THEN ['员工姓名', '身份证号', '__const__申报类型', '__fee_month__', '申报类型'] ELSE ['name', 'id_number', '__const__申报类型', '__m__', '__const__公积金/申报类型'] END WHEN 1 THEN ['姓名', '工号', '离职日期'] WHEN 2 THEN ['name', 'employee_id', 'intent'] ELSE ['name', '__y__'] END) AS key,
  unnest(CASE fv WHEN 0 THEN CASE WHEN odd THEN [CASE variant WHEN 4 THEN nm END, CASE variant WHEN 4 THEN idn END, '增', CASE variant WHEN 4 THEN {_MONTH('%Y%m')} END, CASE variant WHEN 4 THEN {_KIND} END] ELSE [name_value, idn, '增', {_MONTH('%Y%m')}, '增员'] END
    WHEN 1 THEN CASE variant WHEN 1 THEN [nm, idn, dt] ELSE ['', '', ''] END WHEN 2 THEN [name_value, CASE variant WHEN 3 THEN idn END, CASE variant WHEN 3 THEN 'remove' END]
    ELSE [name_value, CASE WHEN variant IN (0, 2, 3, 5) THEN {_MONTH('%Y/%m')} ELSE '' END] END) AS value FROM q)
"""


@query("mapped_fill", _MAPPED + "SELECT template_id, row::int AS row, col_letter, key, coalesce(value, '') AS value FROM c")
def mapped_fill(t):
    w = M.mapped_plan(records(t).select(*RECORD_COLS), _columns(t, NATION_FORMS), _forms(t), M.read_mappings(_replies(t)))
    return w.select("template_id", "row", "col_letter", "key", "value")


@query("mapped_strategy", _MAPPED + "SELECT template_id, 'mapped' AS strategy, count(*) AS n_cells, count(DISTINCT row) AS n_rows, count(*) FILTER (value <> '') AS n_filled FROM c GROUP BY 1")
def mapped_strategy(t):
    """The same through the registry of strategies: every form is routed to its mapping."""
    forms = _forms(t).withColumn("strategy", F.lit("mapped"))
    w = RO.plan_fill(records(t).select(*RECORD_COLS), _columns(t, NATION_FORMS), forms, {"mapped": M.mapped_strategy(M.read_mappings(_replies(t)))})
    return w.groupBy("template_id", "strategy").agg(F.count(F.lit(1)).alias("n_cells"), F.countDistinct("row").alias("n_rows"), F.count(F.when(F.col("value") != "", 1)).alias("n_filled"))


@query("mapping_warnings", f"""SELECT template_id AS scope, v.code, CASE WHEN v.code = 'record_filter_conflicts_with_intent' THEN 'add' ELSE v.detail END AS detail FROM (SELECT *, cast(substr(template_id, 2) AS bigint) AS k FROM ({NATION_FORMS}) n) f
  JOIN (VALUES (0, false, 'derived_field_rejected', '1: missing new_key'), (0, true, 'template_header_not_found', '没有'), (2, NULL, 'record_filter_conflicts_with_intent', '')) v(fv, odd, code, detail) ON v.fv = variant AND coalesce(v.odd = (k % 8 >= 4), true) WHERE v.fv <> 2 OR contains(filename, '增员')""")
def mapping_warnings(t):
    return M.mapping_warnings(_replies(t), _columns(t, NATION_FORMS), _forms(t))
