"""Queries for cells, header detection, column naming and sheet records."""
from pyspark.sql import functions as F

from ..common import SHEET, checkpointed
from ..operators import naming as N
from ..operators import sheets as C
from ..plans.intake import in_mode, read_sheets, sheet_records
from ..sources import sinks as K
from . import recipes as R
from .derive import sheet_cells
from .registry import query

_ROUND = lambda c, n=6: F.round(c, n)


@query("cells_unpivot", """
SELECT concat('n', c_nationkey) AS source_id, cast(floor(c_custkey / 50) AS int) AS sheet_idx, cast(c_custkey % 50 + 1 AS int) AS row_idx, i AS col_idx, CASE i WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE cast(c_nationkey AS string) END AS raw
FROM {customer}, (VALUES (0), (1), (2)) v(i)
UNION ALL SELECT DISTINCT concat('n', c_nationkey), cast(floor(c_custkey / 50) AS int), 0, i, CASE i WHEN 0 THEN '客户' WHEN 1 THEN '行业' ELSE '国家' END FROM {customer}, (VALUES (0), (1), (2)) v(i)""")
def cells_unpivot(t):
    sheet = F.floor(F.col("c_custkey") / 50).cast("int")
    cells = C.cells_from_table(
        t.customer, F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), sheet, F.lit("客户"), F.col("c_custkey") % 50 + 1,
        {"客户": "c_name", "行业": "c_mktsegment", "国家": "c_nationkey"}, header_row=0,
    )
    return cells.select("source_id", "sheet_idx", "row_idx", "col_idx", "raw")


# The same features in SQL, from one classified cell table.
_KIND = f"""
WITH cells AS ({R.SHEET_CELLS}),
k AS (SELECT *, regexp_matches(raw, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}$') AS d, regexp_matches(raw, '^[0-9]{{6,}}$') AS g, regexp_matches(raw, '^-?[0-9]+([.][0-9]+)?$') AS p, regexp_matches(raw, '[A-Za-z一-鿿]') AS a, regexp_matches(raw, '[0-9]') AS n9 FROM cells),
shape AS (SELECT source_id, sheet_idx, max(sheet_name) AS sheet_name, max(row_idx) + 1 AS n_rows, max(col_idx) + 1 AS n_cols FROM cells GROUP BY 1, 2),
feat AS (SELECT source_id, sheet_idx, row_idx, count(*) AS n, count(*) FILTER (d) AS nd, count(*) FILTER (NOT d AND g) AS ng, count(*) FILTER (d OR p) AS nn, count(*) FILTER (NOT d AND NOT p AND a AND NOT n9) AS nt,
  count(*) FILTER (p) AS np, count(*) FILTER (g) AS gg, count(*) FILTER (a) AS na FROM k GROUP BY 1, 2, 3),
sc AS (SELECT f.*, n_rows, n_cols, sheet_name, n / n_cols AS fill, 3.5 * (nt / n) - 2.5 * (ng / n) - 2.0 * (nd / n) - 1.5 * (nn / n) + 0.2 * (n / n_cols) AS score,
  nt / n >= 0.35 AND ng / n <= 0.02 AND nd / n <= 0.02 AND nn / n <= 0.15 AS header_like,
  NOT (nd >= 2 OR (n / n_cols >= 0.85 AND (nd > 0 OR gg > 0) AND n >= 6) OR nd / n >= 0.3 OR gg / n >= 0.3 OR (np / n >= 0.6 AND na / n < 0.4) OR (na / n < 0.25 AND (nd > 0 OR gg > 0))) AS quick_header
  FROM feat f JOIN shape USING (source_id, sheet_idx)),
best AS (SELECT source_id, sheet_idx, row_idx AS h FROM sc WHERE header_like QUALIFY row_number() OVER (PARTITION BY source_id, sheet_idx ORDER BY score DESC, row_idx) = 1),
lay AS (SELECT s.*, coalesce(b.h, -1) AS h, CASE WHEN b.h IS NULL THEN 0 WHEN coalesce(x.header_like, false) THEN 2 ELSE 1 END AS lines,
  CASE WHEN b.h IS NULL THEN (SELECT min(row_idx) FROM feat f WHERE f.source_id = s.source_id AND f.sheet_idx = s.sheet_idx) WHEN coalesce(x.header_like, false) THEN b.h + 2 ELSE b.h + 1 END AS ds
  FROM shape s LEFT JOIN best b USING (source_id, sheet_idx) LEFT JOIN sc x ON x.source_id = s.source_id AND x.sheet_idx = s.sheet_idx AND x.row_idx = b.h + 1)
"""


@query("row_features", _KIND + """SELECT source_id, sheet_idx, row_idx, round(fill, 6) AS fill, round(nt / n, 6) AS text_ratio, round(ng / n, 6) AS long_ratio, round(nd / n, 6) AS date_ratio, round(nn / n, 6) AS num_ratio,
  round(score, 6) AS score, header_like, quick_header FROM sc""")
def row_features(t):
    f = C.row_features(sheet_cells(t))
    return f.select(*SHEET, "row_idx", *[_ROUND(c).alias(c) for c in ("fill", "text_ratio", "long_ratio", "date_ratio", "num_ratio", "score")], "header_like", "quick_header")


@query("sheet_layout", _KIND + """SELECT source_id, sheet_idx, sheet_name, n_rows, n_cols, h AS header_row_idx, lines AS header_rows, ds AS data_start_idx, n_rows - ds AS data_rows, CASE WHEN h < 0 THEN 'no_header' ELSE 'header' END AS header_mode FROM lay""")
def sheet_layout(t):
    return C.sheet_layout(sheet_cells(t)).drop("warnings")


@query("header_loss", f"SELECT source_id, sheet_idx, min(row_idx) > 0 AS first_row_blank, count(*) AS n_cells FROM ({R.SHEET_CELLS}) c GROUP BY 1, 2")
def header_loss(t):
    return C.header_loss(sheet_cells(t))


@query("sheet_list", f"SELECT DISTINCT source_id, sheet_idx, sheet_name FROM ({R.SHEET_CELLS}) c")
def sheet_list(t):
    return C.sheet_names(sheet_cells(t))


@query("requested_sheets", f"""
WITH s AS (SELECT DISTINCT source_id, sheet_name FROM ({R.SHEET_CELLS}) c), w(sheet_name) AS (VALUES ('在职人员0'), ('社保减员1'), ('没有这张'))
SELECT source_id, sheet_name, CASE WHEN s2.sheet_name IS NULL THEN 'missing' ELSE 'kept' END AS state
FROM (SELECT DISTINCT source_id FROM s) a CROSS JOIN w LEFT JOIN s s2 USING (source_id, sheet_name)""")
def requested_sheets(t):
    kept, missing = C.requested_sheets(sheet_cells(t), ["在职人员0", "社保减员1", "没有这张"])
    return kept.select("source_id", "sheet_name").distinct().withColumn("state", F.lit("kept")).unionByName(missing.withColumn("state", F.lit("missing")))


@query("sampled_rows", _KIND + """SELECT source_id, sheet_idx, row_no FROM lay, LATERAL (SELECT DISTINCT unnest(list_concat(range(ds, least(n_rows, ds + 10)), list_transform(range(0, 10), lambda i: cast(ds + round_even(i * ((n_rows - ds - 1) / 9), 0) AS bigint)))) AS row_no) x""")
def sampled_rows(t):
    lay = C.sheet_layout(sheet_cells(t))
    return lay.select(*SHEET, F.explode(C.sample_rows("data_start_idx", "n_rows", 10, 10).cast("array<bigint>")).alias("row_no"))


@query("column_profile", _KIND + """, picks AS (SELECT source_id, sheet_idx, unnest(list_distinct(list_concat(range(ds, least(n_rows, ds + 10)), list_transform(range(0, 10), lambda i: cast(ds + round_even(i * ((n_rows - ds - 1) / 9), 0) AS bigint))))) AS row_idx FROM lay),
body AS (SELECT k.*, ds, n_rows, lay.h FROM k JOIN lay USING (source_id, sheet_idx) WHERE row_idx >= ds),
firsts AS (SELECT source_id, sheet_idx, col_idx, raw, min(row_idx) AS r FROM body JOIN picks USING (source_id, sheet_idx, row_idx) GROUP BY 1, 2, 3, 4),
samp AS (SELECT source_id, sheet_idx, col_idx, string_agg(raw, '|' ORDER BY r) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY source_id, sheet_idx, col_idx ORDER BY r) AS i FROM firsts) z WHERE i <= 8 GROUP BY 1, 2, 3),
agg AS (SELECT source_id, sheet_idx, col_idx, round(count(*) / max(n_rows - ds), 4) AS fill_ratio, count(DISTINCT raw) AS unique_count, round(avg(CASE WHEN a AND NOT p AND NOT g THEN 1.0 ELSE 0 END), 6) AS text_share,
  round(avg(CASE WHEN g THEN 1.0 ELSE 0 END), 6) AS long_share, round(avg(CASE WHEN p THEN 1.0 ELSE 0 END), 6) AS number_share FROM body GROUP BY 1, 2, 3)
SELECT * FROM agg JOIN samp USING (source_id, sheet_idx, col_idx)""")
def column_profile(t):
    cells = sheet_cells(t)
    p = C.column_profiles(cells, C.sheet_layout(cells)).filter("n_values > 0")
    return p.select(*SHEET, "col_idx", "fill_ratio", "unique_count", F.array_join("samples", "|").alias("samples"), *[_ROUND(c).alias(c) for c in ("text_share", "long_share", "number_share")])


_RANK = _KIND + """, w AS (SELECT source_id, sheet_idx, max(score80) FILTER (header_like) AS best_score, sum(n) AS filled FROM (SELECT *, 3.5 * (nt / n) - 2.5 * (ng / n) - 2.0 * (nd / n) - 1.5 * (nn / n) + 0.2 * (n / 80) AS score80 FROM sc) q GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY best_score DESC NULLS LAST, CASE WHEN best_score IS NULL THEN -filled END, sheet_idx) AS best_rank,
  row_number() OVER (PARTITION BY source_id ORDER BY best_score DESC NULLS LAST, filled DESC, sheet_idx) AS use_rank, best_score IS NOT NULL OR filled >= 3 AS useful FROM w)"""


@query("sheet_rank", _RANK + " SELECT source_id, sheet_idx, round(best_score, 6) AS best_score, filled, best_rank, use_rank, useful FROM rk")
def sheet_rank(t):
    r = C.rank_sheets(sheet_cells(t))
    return r.select(*SHEET, _ROUND("best_score").alias("best_score"), "filled", "best_rank", "use_rank", "useful")


@query("sheet_choice", _RANK + """ SELECT source_id, sheet_idx, 'single' AS mode FROM rk WHERE best_rank = 1
UNION ALL SELECT source_id, sheet_idx, 'auto' FROM rk WHERE useful UNION ALL SELECT source_id, sheet_idx, 'all' FROM rk
UNION ALL SELECT source_id, sheet_idx, 'preferred' FROM rk JOIN shape USING (source_id, sheet_idx) WHERE sheet_name = '离职名单3' OR (best_rank = 1 AND source_id NOT IN (SELECT source_id FROM shape WHERE sheet_name = '离职名单3'))""")
def sheet_choice(t):
    r = C.rank_sheets(sheet_cells(t))
    parts = [C.choose_sheets(r, m).withColumn("mode", F.lit(m)) for m in ("single", "auto", "all")]
    parts.append(C.choose_sheets(r, "single", "离职名单3").withColumn("mode", F.lit("preferred")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------- naming
_NAMES = """
SELECT * FROM (VALUES ('员工工号', 'employee_id', 'employee_id'), ('银行账号', 'bank_account', 'bank_account'), ('甲方公司（劳动合同）', 'contract_company', 'contract_company'), ('姓名', 'name', 'name'), ('所属组织单位', 'org_unit', 'company'),
  ('身份证号码', 'id_number', 'id_number'), ('手机号', '', 'phone'), ('岗位属性', 'position_attribute', 'position_attribute'), ('入职时间', '', 'start_date'), ('离职退场', '', 'end_date'), ('供应商发薪编码名称', 'vendor_pay_code_name', ''),
  ('Name', '', 'name'), ('Department', '', 'department'), ('费用合计', '', 'amount'), ('说明', '', 'remark'), ('工作地点', 'work_location', 'address'), ('随便', '', '')) AS v(h, k1, k2)"""


@query("header_keys", f"SELECT p_partkey, h, k1 AS rule_key, k2 AS fallback_key FROM (SELECT p_partkey, cast(p_partkey % 17 AS int) AS i FROM {{part}}) p JOIN (SELECT *, row_number() OVER () - 1 AS i FROM ({_NAMES}) z) v USING (i)")
def header_keys(t):
    names = ["员工工号", "银行账号", "甲方公司（劳动合同）", "姓名", "所属组织单位", "身份证号码", "手机号", "岗位属性", "入职时间", "离职退场", "供应商发薪编码名称", "Name", "Department", "费用合计", "说明", "工作地点", "随便"]
    h = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 17 + 1).cast("int"))
    x = t.part.select("p_partkey", h.alias("h"))
    return x.select("p_partkey", "h", N.header_key("h").alias("rule_key"), N.fallback_key("h").alias("fallback_key"))


@query("sample_keys", """
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'gender' WHEN 1 THEN 'name' WHEN 2 THEN 'employee_id' WHEN 3 THEN 'date' WHEN 4 THEN 'position_attribute' WHEN 5 THEN 'company' WHEN 6 THEN 'amount' ELSE '' END AS key FROM {customer}""")
def sample_keys(t):
    k, arr = F.col("c_custkey") % 8, lambda *v: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v])
    num = lambda base: (F.col("c_custkey") + base).cast("string")
    s = (
        F.when(k == 0, arr("男", "女", " 男 ")).when(k == 1, arr("张三", "李四", "x1")).when(k == 2, arr(num(600000), num(700000), "", "a"))
        .when(k == 3, arr("2025-01-02", "none")).when(k == 4, arr("一线员工岗", "二线", "9")).when(k == 5, arr("甲有限公司", "乙")).when(k == 6, arr("¥12", "30")).otherwise(arr("abc", "12"))
    )
    return t.customer.select("c_custkey", N.key_of_samples(s).alias("key"))


# Expected keys of the four sheet layouts, worked out from the header rules.
_EXPECTED = """
expected AS (SELECT * FROM (VALUES (0, 1, 'name'), (0, 2, 'employee_id'), (0, 3, 'start_date'), (0, 5, 'monthly_contribution'),
  (1, 0, 'name'), (1, 1, 'id_number'), (1, 2, 'ss_base'), (1, 3, 'ss_end_month'), (1, 4, 'hf_base'), (1, 5, 'hf_end_month'),
  (2, 1, 'employee_id'), (2, 2, 'date'), (2, 5, 'company'), (3, 0, 'name'), (3, 1, 'name__2'), (3, 3, 'employee_id'), (3, 5, 'termination_reason')) AS e(variant, col_idx, key)),
cov AS (SELECT * FROM (VALUES (0, 0.6667, false), (1, 1.0, true), (2, 0.8333, true), (3, 0.6667, false)) AS c(variant, coverage, fallback_used))"""


@query("name_columns", f"WITH s AS (SELECT DISTINCT source_id, sheet_idx, variant FROM ({R.SHEET_ROWS}) x), {_EXPECTED} SELECT source_id, sheet_idx, cast(col_idx AS int) AS col_idx, key, cast(coverage AS double) AS coverage, fallback_used FROM s JOIN expected USING (variant) JOIN cov USING (variant)")
def name_columns(t):
    cells = sheet_cells(t)
    named = N.name_columns(C.column_profiles(cells, C.sheet_layout(cells)))
    return named.filter("key != ''").select(*SHEET, "col_idx", "key", F.round("coverage", 4).alias("coverage"), "fallback_used")


def _columns(t):
    """Columns table of one synthetic sheet per supplier, for the single steps."""
    heads = ["员工姓名", "姓名", "工号", "岗位", "岗类", "身份证校验", "缴费金额", "缴费金额", "离职原因", "col_10"]
    keys = ["name", "name", "employee_id", "position", "position", "id_number", "amount", "amount", "", ""]
    rows = F.arrays_zip(F.array(*[F.lit(h) for h in heads]).alias("h"), F.array(*[F.lit(k) for k in keys]).alias("k"))
    x = t.supplier.select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("source_id"), F.lit(0).alias("sheet_idx"), (F.col("s_suppkey") % 2).alias("odd"), F.posexplode(rows).alias("col_idx", "x"))
    return x.select(
        "source_id", "sheet_idx", "col_idx", F.when(F.col("odd") == 1, F.lit("减员")).otherwise(F.lit("在册")).alias("sheet_name"), F.col("x")["h"].alias("header_raw"), F.col("x")["h"].alias("header"),
        F.lit(None).cast("string").alias("h1"), F.when((F.col("col_idx") == 6) & (F.col("odd") == 0), F.lit("社保")).alias("h2"), (F.col("col_idx") == 9).alias("placeholder"), F.col("x")["k"].alias("key"),
        F.lit(10).alias("n_values"), F.lit(0.9).alias("text_share"), F.lit(0.0).alias("long_share"), F.lit(0.0).alias("number_share"), F.when(F.col("col_idx") == 5, 0.8).otherwise(0.0).alias("bool_share"),
    )


_STEP = lambda values: f"SELECT concat('u', s_suppkey) AS source_id, col_idx, CASE WHEN s_suppkey % 2 = 1 THEN k_odd ELSE k_even END AS key FROM {{supplier}}, (VALUES {values}) v(col_idx, k_even, k_odd)"


@query("key_overrides", "SELECT concat('u', s_suppkey) AS source_id, 10 AS n_columns, 4 AS overridden, 0.8889 AS coverage FROM {supplier}")
def key_overrides(t):
    base = _columns(t)
    proposed = base.filter("key != ''").select("source_id", "sheet_idx", "header", F.when(F.col("col_idx") == 5, F.lit("wrong")).when(F.col("col_idx").isin(6, 7), F.lit("fee")).when(F.col("col_idx").isin(3, 4), F.lit("job")).otherwise(F.lit("x")).alias("key"))
    done = N.with_coverage(N.apply_overrides(base.drop("key"), proposed))
    return done.groupBy("source_id").agg(F.count(F.lit(1)).cast("int").alias("n_columns"), (F.sum(F.col("overridden").cast("int")) + 1).cast("int").alias("overridden"), F.round(F.max("coverage"), 4).alias("coverage"))


@query("key_conflicts", _STEP("(0, 'name', 'name'), (1, '', ''), (2, 'employee_id', 'employee_id'), (3, '', ''), (4, 'job_family', 'job_family'), (5, 'id_number', 'id_number'), (6, 'amount', 'amount'), (7, 'amount', 'amount'), (8, '', ''), (9, '', '')"))
def key_conflicts(t):
    return N.resolve_conflicts(_columns(t)).select("source_id", "col_idx", "key")


@query("forced_headers", _STEP("(0, 'name', 'name'), (1, 'name', 'name'), (2, 'badge', 'badge'), (3, 'position', 'position'), (4, 'position', 'position'), (5, 'id_number', 'id_number'), (6, 'amount', 'amount'), (7, 'amount', 'amount'), (8, '', ''), (9, '', '')"))
def forced_headers(t):
    return N.apply_forced(_columns(t), {"工 号": "badge", "": "x"}).select("source_id", "col_idx", "key")


@query("reason_and_check_columns", _STEP("(0, 'name', 'name'), (1, 'name', 'name'), (2, 'employee_id', 'employee_id'), (3, 'position', 'position'), (4, 'position', 'position'), (5, 'id_check_passed', 'id_check_passed'), (6, 'amount', 'amount'), (7, 'amount', 'amount'), (8, 'termination_reason', 'termination_reason'), (9, '', '')"))
def reason_and_check_columns(t):
    return N.mark_id_checks(N.mark_reasons(_columns(t))).select("source_id", "col_idx", "key")


@query("unique_keys", _STEP("(0, 'name', 'name'), (1, 'name__2', 'name__2'), (2, 'employee_id', 'employee_id'), (3, 'position', 'position'), (4, 'position__5', 'position__5'), (5, 'id_number', 'id_number'), (6, 'ss_base', 'ss_base'), (7, 'amount__8', 'hf_base'), (8, '', ''), (9, '', '')"))
def unique_keys(t):
    return N.split_groups(N.unique_keys(_columns(t))).select("source_id", "col_idx", "key")


# ------------------------------------------------------------------ records
_REC_SQL = f"""
SELECT source_id, sheet_idx, row_idx, CASE variant WHEN 0 THEN v1 WHEN 1 THEN v0 WHEN 3 THEN v0 END AS name, CASE variant WHEN 0 THEN v2 WHEN 2 THEN v1 WHEN 3 THEN v3 END AS employee_id,
  CASE variant WHEN 1 THEN v1 END AS id_number, CASE variant WHEN 0 THEN v3 END AS start_date, CASE variant WHEN 1 THEN concat(v3, '-01') END AS ss_end_month,
  CASE variant WHEN 1 THEN strftime(try_cast(concat(replace(v5, '/', '-'), '-1') AS date), '%Y-%m-%d') END AS hf_end_month, CASE variant WHEN 1 THEN v2 END AS ss_base, CASE variant WHEN 3 THEN v5 END AS termination_reason
FROM ({R.SHEET_ROWS}) r"""
_REC_KEYS = ("name", "employee_id", "id_number", "start_date", "ss_end_month", "hf_end_month", "ss_base", "termination_reason")


def _wide(recs):
    return recs.select(*SHEET, "row_idx", *[F.try_element_at("rec", F.lit(k)).alias(k) for k in _REC_KEYS])


@query("cells_to_records", _REC_SQL)
def cells_to_records(t):
    return _wide(sheet_records(sheet_cells(t), mode="all"))


@query("sheet_modes", _RANK + f", r AS ({_REC_SQL}) SELECT 'single' AS mode, count(*) AS n FROM r JOIN rk USING (source_id, sheet_idx) WHERE best_rank = 1 UNION ALL SELECT 'auto', count(*) FROM r JOIN rk USING (source_id, sheet_idx) WHERE useful")
def sheet_modes(t):
    cells = checkpointed(sheet_cells(t))
    whole = read_sheets(cells, mode="all", keep=True)
    ranks = checkpointed(C.rank_sheets(cells))
    count = lambda m: in_mode(whole, ranks, m).records.agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("mode"), "n")
    return count("single").unionByName(count("auto"))


_VALS = ", ".join(f"v{i}" for i in range(6))


@query("row_filter", f"""
SELECT source_id, sheet_idx, row_idx FROM (SELECT *, list_filter([{_VALS}], lambda x: x <> '') AS vs, row_idx - CASE variant WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS k FROM ({R.SHEET_ROWS}) r) z
WHERE (len(vs) / 6 >= 0.9 AND len(list_filter(vs, lambda x: contains(lower(x), '销售部') OR contains(lower(x), 'household') OR contains(lower(x), '合同'))) = 0) OR (k < 3 AND variant = 1)""")
def row_filter(t):
    cells = sheet_cells(t)
    lay = C.sheet_layout(cells)
    named = N.name_columns(C.column_profiles(cells, lay)).join(lay.select(*SHEET, "n_cols"), SHEET)
    rule = {"min_nonempty_ratio": 0.9, "required_fields_any": ["name", "employee_id"], "exclude_if_contains_any": ["销售部", "HOUSEHOLD", "合同", ""]}
    return C.records_from_cells(cells, lay, named, row_filter=rule).select(*SHEET, "row_idx")


@query("demo_filter", """SELECT o_orderkey, o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AS demo FROM {orders}""")
def demo_filter(t):
    k = F.col("o_orderkey")
    rec = F.create_map(F.lit("id_number"), F.when(k % 3 == 0, F.lit("4201****")).otherwise(F.lit("4201")), F.lit("note"), F.when(k % 5 == 0, F.lit("A Sample row")))
    return t.orders.select("o_orderkey", C.demo_record(F.when(k % 2 == 0, F.lit("示例1")).otherwise(F.lit("名单")), rec).alias("demo"))


@query("workbook_cap", f"SELECT source_id, sheet_idx, row_idx, pos, n > 120 AS truncated FROM (SELECT source_id, sheet_idx, row_idx, row_number() OVER (PARTITION BY source_id ORDER BY sheet_idx, row_idx) AS pos, count(*) OVER (PARTITION BY source_id) AS n FROM ({R.SHEET_ROWS}) r) z WHERE pos <= 120")
def workbook_cap(t):
    return C.keep_first_records(t.sql(R.SHEET_ROWS).select(*SHEET, "row_idx"), 120).select(*SHEET, "row_idx", "pos", "truncated")


@query("sheet_cap", f"SELECT source_id, sheet_idx, count(*) AS n FROM ({R.SHEET_ROWS}) r WHERE row_idx < 60 + CASE variant WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END GROUP BY 1, 2")
def sheet_cap(t):
    from ..options import Limits

    cells = sheet_cells(t)
    return C.sheet_rows(cells, C.sheet_layout(cells), Limits(rows_per_sheet=60).rows_per_sheet).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n"))


@query("no_record_reason", f"""
SELECT source_id, sheet_idx, CASE variant WHEN 0 THEN NULL WHEN 1 THEN 'workbook_records_limit_reached' WHEN 2 THEN CASE WHEN sheet_idx % 2 = 0 THEN 'schema_infer_failed_and_no_fallback' ELSE 'no_header_detected' END ELSE 'filtered_all_rows' END AS no_records_reason
FROM (SELECT DISTINCT source_id, sheet_idx, variant FROM ({R.SHEET_ROWS}) r) z""")
def no_record_reason(t):
    per = t.sql(R.SHEET_ROWS).groupBy(*SHEET, "variant").agg(F.count(F.lit(1)).alias("data_rows"))
    v = F.col("variant")
    per = per.select(
        *SHEET, "data_rows", F.when(v == 0, F.col("data_rows")).otherwise(0).alias("records_count"), F.when(v == 1, 3).otherwise(0).alias("dropped_by_cap"),
        F.when((v == 2) & (F.col("sheet_idx") % 2 == 0), 0.2).otherwise(0.9).alias("coverage"), F.when(v == 2, F.lit("no_header")).otherwise(F.lit("header")).alias("header_mode"),
        F.when(v == 2, -1).otherwise(0).alias("header_row_idx"),
    )
    return C.no_record_reason(per).select(*SHEET, "no_records_reason")


@query("csv_sample", _KIND + """, p AS (SELECT source_id, sheet_idx, n_cols, h, list_concat(CASE WHEN h < 0 THEN [] ELSE range(h, h + lines) END, list_sort(list_distinct(list_transform(range(0, 10), lambda i: cast(ds + round_even(i * ((n_rows - ds - 1) / 9), 0) AS bigint))))) AS rows FROM lay),
g AS (SELECT source_id, sheet_idx, h, unnest(rows) AS r, generate_subscripts(rows, 1) AS ord FROM p),
c AS (SELECT g.*, j.col, coalesce(cells.raw, '') AS raw FROM g CROSS JOIN (SELECT unnest(range(0, 6)) AS col) j LEFT JOIN cells ON cells.source_id = g.source_id AND cells.sheet_idx = g.sheet_idx AND cells.row_idx = r AND cells.col_idx = j.col),
l AS (SELECT source_id, sheet_idx, h, ord, string_agg(raw, ',' ORDER BY col) AS line FROM c GROUP BY 1, 2, 3, 4)
SELECT source_id, sheet_idx, concat(CASE WHEN h < 0 THEN concat('col_0,col_1,col_2,col_3,col_4,col_5', chr(10)) ELSE '' END, string_agg(line, chr(10) ORDER BY ord)) AS csv FROM l GROUP BY source_id, sheet_idx, h""")
def csv_sample(t):
    cells = sheet_cells(t)
    return C.csv_sample(cells, C.sheet_layout(cells))


@query("sheet_envelopes", f"""
SELECT source_id, sheet_idx, concat('{{"metadata":{{"mode":"schema_infer","coverage":0.5,"total_rows":', n_rows, ',"processed_rows":', n, ',"data_rows":', n, ',"header_row_idx":', CASE variant WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END, ',"data_start_idx":', n_rows - n,
  ',"header_mode":"', CASE variant WHEN 2 THEN 'no_header' ELSE 'header' END, '"}},"warnings":', CASE variant WHEN 2 THEN '["no_header_row_detected"]' WHEN 1 THEN '[]' ELSE '["second_header_row_rejected_as_data"]' END, '}}') AS envelope
FROM (SELECT source_id, sheet_idx, variant, count(*) AS n, max(row_idx) + 1 AS n_rows FROM ({R.SHEET_ROWS}) r GROUP BY 1, 2, 3) z""")
def sheet_envelopes(t):
    cells = sheet_cells(t)
    counts = t.sql(R.SHEET_ROWS).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("records_count"))
    return K.sheet_envelopes(C.sheet_layout(cells), counts.withColumn("coverage", F.lit(0.5)), counts)
