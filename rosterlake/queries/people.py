"""Queries for intents, record filters, source choice and people."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import intent as I
from ..operators import resolve as S
from . import recipes as R
from .derive import RECORD_COLS, records
from .registry import query

# Records as (key, value) lists per shape, for the SQL side.
KEYS = """CASE variant WHEN 0 THEN ['name', 'id_number', 'start_date', '部门'] WHEN 1 THEN ['姓名', '工号', '离职日期', '离职原因'] WHEN 2 THEN ['name', 'id_number', 'start_date']
  WHEN 3 THEN ['name', 'employee_id', 'leave_date', 'intent'] WHEN 4 THEN ['员工姓名', '身份证号', '申报类型', '变动日期'] ELSE ['name', '备用', 'id_number', '编号', 'termination_date'] END"""
VALUES = """CASE variant WHEN 0 THEN [nm, idn, dt, prio] WHEN 1 THEN [nm, idn, dt, reason] WHEN 2 THEN [nm, idn, dt] WHEN 3 THEN [nm, idn, dt, 'remove'] WHEN 4 THEN [nm, idn, kind, dt]
  ELSE [concat('9', o_custkey), nm, iso_date, concat('77', lpad(cast(o_custkey AS string), 6, '0')), dt] END"""
RECS = f"WITH r AS ({R.RECORD_ROWS})"
KV = RECS + f", kv AS (SELECT source_id, variant, sheet_idx, row_idx, unnest({KEYS}) AS key, unnest({VALUES}) AS value, generate_subscripts({KEYS}, 1) - 1 AS k FROM r)"
GOOD_DATE = "try_cast(replace(dt, '/', '-') AS date)"
_INT = RECS + """, i AS (SELECT *, CASE WHEN variant = 4 THEN CASE o_orderkey % 3 WHEN 1 THEN 'remove' WHEN 2 THEN 'add' END END AS explicit_intent, CASE variant WHEN 0 THEN 'add' WHEN 2 THEN 'add' WHEN 5 THEN 'remove' END AS key_intent,
  CASE WHEN variant = 1 THEN 'remove' WHEN variant = 4 THEN CASE o_orderkey % 3 WHEN 1 THEN 'remove' WHEN 2 THEN 'add' END END AS scanned_intent,
  CASE variant WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 2 THEN 'in_service' WHEN 3 THEN 'remove' END AS file_intent, CASE WHEN sheet_name IN ('减员', '离职_1') THEN 'remove' WHEN sheet_name = '增员' THEN 'add' END AS sheet_intent FROM r),
t AS (SELECT *, coalesce(explicit_intent, key_intent, sheet_intent) AS record_type FROM i)
"""


def _recs(t) -> DataFrame:
    return records(t).select(*RECORD_COLS, "o_orderkey", "variant")


@query("record_intent", _INT + "SELECT o_orderkey, explicit_intent, key_intent, scanned_intent, file_intent, sheet_intent, record_type FROM t")
def record_intent(t):
    return I.with_intents(_recs(t)).select("o_orderkey", "explicit_intent", "key_intent", "scanned_intent", "file_intent", "sheet_intent", "record_type")


@query("text_intents", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 3 THEN 'in_service' END AS words, CASE o_orderkey % 6 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' END AS form_file, CASE o_orderkey % 6 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 5 THEN 'remove' END AS profile_file FROM {orders}""")
def text_intents(t):
    names = ["10月 增_员.xlsx", "减员-表", "增员减员汇总", "在岗人员", "other", "Remove list"]
    n = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return t.orders.select("o_orderkey", I.text_intent(n).alias("words"), I.form_file_intent(n).alias("form_file"), I.profile_file_intent(F.translate(n, "_-", "")).alias("profile_file"))


@query("sheet_actions", RECS + """ SELECT 'remove' AS intent, sheet_name, CASE WHEN sheet_name = '' THEN 'neutral' WHEN sheet_name IN ('减员', '离职_1') THEN 'kept' ELSE 'blocked' END AS action, count(*) AS count FROM r GROUP BY 1, 2, 3
UNION ALL SELECT 'add', sheet_name, CASE WHEN sheet_name = '增员' THEN 'kept' WHEN sheet_name IN ('减员', '离职_1') THEN 'blocked' ELSE 'neutral' END, count(*) FROM r GROUP BY 1, 2, 3""")
def sheet_actions(t):
    r = _recs(t)
    return reduce(DataFrame.unionByName, [I.sheet_action_counts(r, i).withColumn("intent", F.lit(i)) for i in ("remove", "add")])


@query("sheet_filter", RECS + """ SELECT 'remove' AS intent, source_id, count(*) AS n FROM r WHERE sheet_name IN ('', '减员', '离职_1') GROUP BY 1, 2 UNION ALL SELECT 'add', source_id, count(*) FROM r WHERE sheet_name IN ('', '增员') GROUP BY 1, 2
UNION ALL SELECT concat('ignored:', sheet_name), source_id, count(*) FROM r WHERE sheet_name IN ('增员', '人员') GROUP BY 1, 2""")
def sheet_filter(t):
    r = _recs(t)
    parts = [I.filter_by_sheet(r, i).groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("intent", F.lit(i)) for i in ("remove", "add")]
    w = I.ignored_sheet_warning(r).select(F.col("scope").alias("source_id"), F.split("detail", ":")[1].cast("bigint").alias("n"), F.concat(F.lit("ignored:"), F.split("detail", ":")[0]).alias("intent"))
    return reduce(DataFrame.unionByName, [*parts, w])


@query("type_filter", _INT + "SELECT o_orderkey FROM t WHERE record_type = 'remove' UNION ALL SELECT -o_orderkey FROM t WHERE variant = 3")
def type_filter(t):
    r = _recs(t)
    none_typed = I.filter_by_type(r.filter("variant = 3"), "add")
    return I.filter_by_type(r, "remove").select("o_orderkey").unionByName(none_typed.select((-F.col("o_orderkey")).alias("o_orderkey")))


@query("intent_filter", _INT + """, p AS (SELECT *, CASE WHEN record_type IS NOT NULL THEN record_type = 'add' ELSE coalesce(file_intent = 'add', true) AND coalesce(explicit_intent = 'add', true) AND CASE WHEN scanned_intent IS NULL THEN coalesce(file_intent = 'add', false) OR coalesce(explicit_intent = 'add', false) ELSE scanned_intent = 'add' END END AS strict,
  CASE WHEN record_type IS NOT NULL THEN record_type = 'add' ELSE coalesce(file_intent = 'add', true) AND coalesce(explicit_intent = 'add', true) END AS relaxed FROM t),
g AS (SELECT *, bool_or(strict) OVER (PARTITION BY source_id) AS any_strict FROM p) SELECT o_orderkey FROM g WHERE CASE WHEN any_strict THEN strict ELSE relaxed END""")
def intent_filter(t):
    r = records(t).select(*RECORD_COLS, "o_orderkey")
    return I.filter_by_intent(r, "add").select("o_orderkey")


@query("intent_filter_whole", _INT + "SELECT o_orderkey FROM t WHERE CASE WHEN record_type IS NOT NULL THEN record_type = 'remove' ELSE coalesce(file_intent = 'remove', true) AND coalesce(explicit_intent = 'remove', true) AND CASE WHEN scanned_intent IS NULL THEN coalesce(file_intent = 'remove', false) OR coalesce(explicit_intent = 'remove', false) ELSE scanned_intent = 'remove' END END")
def intent_filter_whole(t):
    r = records(t).select(*RECORD_COLS, "o_orderkey")
    return I.filter_by_intent(r, "remove", scope=[]).select("o_orderkey")


@query("own_intent", RECS + " SELECT variant, count(*) AS n FROM r WHERE variant <> 3 GROUP BY 1")
def own_intent(t):
    return _recs(t).filter(I.own_intent_allows("rec", F.lit("add"))).groupBy("variant").agg(F.count(F.lit(1)).alias("n"))


@query("field_filter", RECS + " SELECT o_orderkey, 'in' AS mode FROM r WHERE variant = 4 AND kind IN ('减员', '增') UNION ALL SELECT o_orderkey, 'out' FROM r WHERE variant <> 4 OR kind NOT IN ('减员', '增')")
def field_filter(t):
    r, vals = _recs(t), [" 减员", "增"]
    pick = lambda ex, m: I.filter_by_field(r, "申报类型", vals, ex).select("o_orderkey", F.lit(m).alias("mode"))
    return pick(False, "in").unionByName(pick(True, "out"))


@query("record_gate", RECS + """, f AS (SELECT *, CASE WHEN variant IN (0, 2) THEN (1 + CASE WHEN idn <> '' THEN 1 ELSE 0 END + CASE WHEN dt <> '' THEN 1 ELSE 0 END) / 3 WHEN variant = 3 THEN 1 / 3 WHEN variant = 5 THEN 2 / 3 ELSE 0 END AS ratio FROM r),
g AS (SELECT *, max(ratio) OVER (PARTITION BY source_id) AS best FROM f)
SELECT o_orderkey, round(ratio, 4) AS ratio FROM g WHERE ratio >= 0.4 OR best < 0.4""")
def record_gate(t):
    return I.gate_records(_recs(t), ["name", "id_number", "start_date"]).select("o_orderkey", F.round("filled_ratio", 4).alias("ratio"))


@query("filter_conflict", RECS + """ SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN false WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 5 < 2 THEN kind = '新增' ELSE kind = '减员' END
  ELSE CASE WHEN o_orderkey % 5 < 2 THEN kind = '减员' ELSE kind = '新增' END END AS conflict FROM r""")
def filter_conflict(t):
    k = F.col("o_orderkey")
    intent = F.when(k % 5 < 2, F.lit("add")).when(k % 5 < 4, F.lit("remove")).otherwise(F.lit(""))
    return t.sql(R.RECORD_ROWS).select("o_orderkey", I.filter_conflicts(F.array("kind"), k % 2 == 0, intent).alias("conflict"))


@query("mapping_intent", RECS + """ SELECT o_orderkey, CASE WHEN variant = 4 THEN CASE kind WHEN '减员' THEN 'remove' ELSE 'add' END WHEN variant = 5 THEN 'remove' WHEN variant = 2 THEN 'add' WHEN variant IN (1, 3) THEN 'remove' WHEN variant = 0 THEN 'add' END AS intent FROM r""")
def mapping_intent(t):
    v = F.col("variant")
    constants = F.create_map(F.when(v == 4, F.lit("社保/申报类型")).otherwise(F.lit("其他")), F.col("kind"))
    mapping = F.create_map(F.when(v == 5, F.lit("Termination_Date")).when(v == 2, F.lit("start-date")).otherwise(F.lit("姓名")), F.lit("k"))
    return t.sql(R.RECORD_ROWS).select("o_orderkey", I.mapping_intent(constants, mapping, "source_file", F.lit("")).alias("intent"))


# ------------------------------------------------------------------- dedupe
_RANKED = lambda part, order, cond: f"SELECT * FROM x WHERE {cond} QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY {order}) = 1"


@query("dedupe_leave", RECS + f""", x AS (SELECT source_id, sheet_idx, row_idx, CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE nm END AS name, idn AS employee_id, dt AS leave_date, reason, CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE 1 END + CASE WHEN idn <> '' THEN 1 ELSE 0 END + CASE WHEN dt <> '' THEN 1 ELSE 0 END + CASE WHEN reason <> '' THEN 1 ELSE 0 END AS filled FROM r),
a AS ({_RANKED('employee_id', 'filled DESC, source_id, sheet_idx, row_idx', "employee_id <> ''")}), b AS ({_RANKED('name, leave_date', 'filled DESC, source_id, sheet_idx, row_idx', "employee_id = '' AND name <> ''")}),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.name = b.name AND a.leave_date = b.leave_date AND a.name <> '') UNION ALL SELECT * FROM x WHERE employee_id = '' AND name = '')
SELECT source_id, sheet_idx, row_idx, name, employee_id, leave_date, reason FROM u""")
def dedupe_leave(t):
    x = t.sql(R.RECORD_ROWS).select("source_id", "sheet_idx", "row_idx", F.when(F.col("o_orderkey") % 31 == 0, F.lit("")).otherwise(F.col("nm")).alias("name"), F.col("idn").alias("employee_id"), F.col("dt").alias("leave_date"), "reason")
    return S.dedupe_leave(x, ["source_id", "sheet_idx", "row_idx"])


def _people_sql(tail: str) -> str:
    return RECS + f""", x AS (SELECT source_id, sheet_idx, row_idx, nm AS name, idn AS id_number, {GOOD_DATE} AS event_date, reason, length(concat_ws('|', nm, idn, cast({GOOD_DATE} AS string), reason)) AS size FROM r),
a AS ({_RANKED('id_number', 'size DESC, source_id, sheet_idx, row_idx', 'length(id_number) >= 4')}), b0 AS ({_RANKED("name, coalesce(cast(event_date AS string), '')", 'size DESC, source_id, sheet_idx, row_idx', 'length(id_number) < 4')}),
b AS (SELECT * FROM b0 WHERE name NOT IN (SELECT name FROM a)) {tail}"""


@query("dedupe_people", _people_sql("SELECT source_id, sheet_idx, row_idx, name, id_number, strftime(event_date, '%Y-%m-%d') AS event_date FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u"))
def dedupe_people(t):
    return S.dedupe_people(_people(t), ["source_id", "sheet_idx", "row_idx"]).select("source_id", "sheet_idx", "row_idx", "name", "id_number", D.iso("event_date").alias("event_date"))


def _people(t):
    return t.sql(R.RECORD_ROWS).select("source_id", "sheet_idx", "row_idx", F.col("nm").alias("name"), F.col("idn").alias("id_number"), D.record_date("dt").alias("event_date"), "reason")


@query("dedupe_people_by_name", RECS + f""", x AS (SELECT source_id, sheet_idx, row_idx, nm AS name, {GOOD_DATE} AS event_date, length(concat_ws('|', nm, '', cast({GOOD_DATE} AS string), reason)) AS size FROM r WHERE length(idn) < 4),
b AS ({_RANKED("name, coalesce(cast(event_date AS string), '')", 'size DESC, source_id, sheet_idx, row_idx', 'true')})
SELECT name, source_id, sheet_idx, row_idx FROM b QUALIFY row_number() OVER (PARTITION BY name ORDER BY source_id, sheet_idx, row_idx) = 1""")
def dedupe_people_by_name(t):
    loose = _people(t).filter("length(id_number) < 4")
    return S.dedupe_people(loose, ["source_id", "sheet_idx", "row_idx"], name_only=True).select("name", "source_id", "sheet_idx", "row_idx")


@query("dedupe_simple", RECS + """ SELECT k, source_id, sheet_idx, row_idx FROM (SELECT *, coalesce(nullif(idn, ''), nm) AS k FROM r) z QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN idn = '' THEN 1 ELSE 0 END, source_id, sheet_idx, row_idx) = 1""")
def dedupe_simple(t):
    return S.dedupe_simple(_people(t), ["source_id", "sheet_idx", "row_idx"]).select(F.coalesce(F.nullif("id_number", F.lit("")), "name").alias("k"), "source_id", "sheet_idx", "row_idx")


# ------------------------------------------------------------------ sources
_COV = RECS + f""", c AS (SELECT source_id, max(variant) AS variant, max(source_file) AS source_file, max(source_type) AS source_type, count(*) AS record_count, avg(CASE WHEN variant = 5 THEN 0.0 ELSE 1 END) AS name_coverage, avg(CASE WHEN variant = 5 OR idn <> '' THEN 1.0 ELSE 0 END) AS id_coverage,
  sum(CASE WHEN variant <> 5 AND idn LIKE '%X' THEN 1 ELSE 0 END) AS national_ids, avg(CASE WHEN variant IN (0, 2) AND {GOOD_DATE} IS NOT NULL THEN 1.0 ELSE 0 END) AS start_coverage, avg(CASE WHEN variant IN (1, 3) AND {GOOD_DATE} IS NOT NULL THEN 1.0 ELSE 0 END) AS leave_coverage FROM r GROUP BY 1)
"""
_COVS = ("name_coverage", "id_coverage", "start_coverage", "leave_coverage")


@query("field_coverage", _COV + "SELECT source_id, record_count, round(name_coverage, 6) AS name_coverage, round(id_coverage, 6) AS id_coverage, national_ids, round(start_coverage, 6) AS start_coverage, round(leave_coverage, 6) AS leave_coverage FROM c")
def field_coverage(t):
    c = S.field_coverage(_recs(t))
    return c.select("source_id", "record_count", "national_ids", *[F.round(x, 6).alias(x) for x in _COVS])


_SCORE = _COV + """, w AS (SELECT * FROM (VALUES (0, 'add', 30, 40), (0, 'remove', -20, 20), (1, 'add', -20, 15), (1, 'remove', 30, 40), (2, 'add', -15, 40), (2, 'remove', -15, 20), (3, 'add', -20, 15), (3, 'remove', 30, 40), (4, 'add', 10, 20), (4, 'remove', 0, 20), (5, 'add', 0, 20), (5, 'remove', 0, 20)) v(variant, intent, fs, ks)),
s AS (SELECT c.*, intent, fs AS file_score, ks AS key_score, variant = 2 AS excluded, name_coverage * 25 + id_coverage * 15 + CASE intent WHEN 'add' THEN start_coverage ELSE leave_coverage END * 30 + CASE WHEN intent = 'remove' AND variant = 3 THEN least(record_count * 5, 20) ELSE 0 END AS coverage_score FROM c JOIN w USING (variant)),
z AS (SELECT *, (file_score + key_score + coverage_score) * CASE WHEN excluded THEN 0.5 ELSE 1 END AS total_score FROM s)
"""


@query("source_score", _SCORE + "SELECT source_id, intent, cast(file_score AS double) AS file_score, cast(key_score AS double) AS key_score, round(coverage_score, 6) AS coverage_score, round(total_score, 6) AS total_score, excluded FROM z")
def source_score(t):
    s = S.score_sources(_recs(t))
    return s.select("source_id", "intent", "file_score", "key_score", F.round("coverage_score", 6).alias("coverage_score"), F.round("total_score", 6).alias("total_score"), "excluded")


@query("top_sources", _SCORE + "SELECT intent, source_id, row_number() OVER (PARTITION BY intent ORDER BY round(total_score, 9) DESC, source_type, source_file, source_id) AS rank FROM z WHERE NOT excluded QUALIFY rank <= 3")
def top_sources(t):
    s = S.score_sources(_recs(t)).withColumn("total_score", F.round("total_score", 9))
    return S.top_sources(s, 3).select("intent", "source_id", "rank")


@query("top_sources_excluded", _SCORE + "SELECT intent, source_id FROM z WHERE excluded QUALIFY row_number() OVER (PARTITION BY intent ORDER BY round(total_score, 9) DESC, source_file, source_id) <= 2")
def top_sources_excluded(t):
    s = S.score_sources(_recs(t).filter("variant = 2")).withColumn("total_score", F.round("total_score", 9))
    return S.top_sources(s, 2).select("intent", "source_id")


_TYPES = KV + """, n AS (SELECT *, dense_rank() OVER (PARTITION BY source_id ORDER BY sheet_idx, row_idx) AS rk FROM kv),
kt AS (SELECT source_id, key, min(rk * 100 + k) AS seen, avg(CASE WHEN value = '' THEN NULL WHEN regexp_matches(value, '^[一-鿿]{1,6}$') AND value NOT IN ('男', '女') THEN 1.0 WHEN regexp_matches(value, '^[A-Za-z ]{2,}$') THEN 1.0 ELSE 0 END) AS name,
  avg(CASE WHEN value = '' THEN NULL WHEN regexp_matches(value, '^([0-9]{4,}|[0-9]{17}[Xx])$') THEN 1.0 ELSE 0 END) AS id,
  avg(CASE WHEN value = '' THEN NULL WHEN try_cast(replace(value, '/', '-') AS date) IS NOT NULL AND regexp_matches(value, '^[0-9]{4}[-/]') THEN 1.0 WHEN regexp_matches(value, '^[0-9]{8}$') THEN 1.0 ELSE 0 END) AS date FROM n GROUP BY 1, 2)
"""


@query("field_types", _TYPES + "SELECT source_id, key, round(coalesce(name, 0), 6) AS name, round(coalesce(id, 0), 6) AS id, round(coalesce(date, 0), 6) AS date FROM kt")
def field_types(t):
    s = S.field_type_scores(_recs(t))
    return s.select("source_id", "key", *[F.round(k, 6).alias(k) for k in ("name", "id", "date")])


@query("fixed_keys", _TYPES + """, v AS (SELECT DISTINCT source_id, variant FROM r), b AS (SELECT source_id, key FROM kt WHERE key <> '备用' AND id > 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id DESC, seen) = 1)
SELECT v.source_id, CASE variant WHEN 1 THEN '姓名' WHEN 4 THEN '员工姓名' WHEN 5 THEN '备用' ELSE 'name' END AS name_key, CASE variant WHEN 1 THEN '工号' WHEN 3 THEN 'employee_id' WHEN 4 THEN '身份证号' WHEN 5 THEN b.key ELSE 'id_number' END AS id_key,
  CASE variant WHEN 1 THEN '离职日期' WHEN 3 THEN 'leave_date' WHEN 5 THEN 'termination_date' END AS date_key, variant = 5 AS name_repaired, variant IN (1, 3, 5) AS date_valid FROM v LEFT JOIN b USING (source_id)""")
def fixed_keys(t):
    r = _recs(t)
    k = S.fix_keys(r, S.proposed_keys(r, "remove"), "remove")
    return k.select("source_id", "name_key", "id_key", "date_key", "name_repaired", "date_valid")


@query("date_keys", RECS + """ SELECT DISTINCT source_id, 'remove' AS intent, CASE variant WHEN 1 THEN '离职日期' WHEN 3 THEN 'leave_date' WHEN 5 THEN 'termination_date' END AS date_key, CASE variant WHEN 5 THEN 'forced_termination' WHEN 1 THEN 'found' WHEN 3 THEN 'found' ELSE 'required_field_missing:end_date' END AS date_key_reason FROM r
UNION ALL SELECT DISTINCT source_id, 'add', CASE WHEN variant IN (0, 2) THEN 'start_date' END, CASE WHEN variant IN (0, 2) THEN 'found' ELSE 'required_field_missing:start_date' END FROM r""")
def date_keys(t):
    r = _recs(t)
    return reduce(DataFrame.unionByName, [S.choose_date_key(r, i).withColumn("intent", F.lit(i)) for i in ("remove", "add")])


@query("source_keys", RECS + f" SELECT DISTINCT source_id, array_to_string({KEYS}, ',') AS keys FROM r")
def source_keys(t):
    k = S.source_keys(_recs(t)).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("seen", "key"))).alias("ks"))
    return k.select("source_id", F.array_join(F.transform("ks", lambda x: x["key"]), ",").alias("keys"))


_ONE = lambda word: f"(SELECT DISTINCT source_id, source_file FROM r WHERE source_type = 'excel' AND contains(source_file, '{word}') )"


@query("source_pick", RECS + f" SELECT 'add' AS intent, * FROM {_ONE('入职')} a UNION ALL SELECT 'remove', * FROM {_ONE('离职')} b UNION ALL SELECT 'by_keys', * FROM (SELECT DISTINCT source_id, source_file FROM r WHERE variant = 2) c")
def source_pick(t):
    books = _recs(t).filter("source_type = 'excel'")
    pick = lambda df, i, label: S.source_pick(df, i).select(F.lit(label).alias("intent"), "source_id", "source_file")
    return pick(books, "add", "add").unionByName(pick(books, "remove", "remove")).unionByName(pick(books.filter("variant IN (2, 4)"), "add", "by_keys"))


@query("heuristic_keys", RECS + """ SELECT DISTINCT source_id, 'add' AS intent, CASE variant WHEN 1 THEN '姓名' WHEN 4 THEN '员工姓名' ELSE 'name' END AS name_key, CASE WHEN variant IN (0, 2) THEN 'start_date' END AS date_key FROM r
UNION ALL SELECT DISTINCT source_id, 'remove', CASE variant WHEN 1 THEN '姓名' WHEN 4 THEN '员工姓名' ELSE 'name' END, CASE variant WHEN 1 THEN '离职日期' WHEN 3 THEN 'leave_date' END FROM r""")
def heuristic_keys(t):
    r = _recs(t)
    return reduce(DataFrame.unionByName, [S.heuristic_keys(r, i).withColumn("intent", F.lit(i)) for i in ("add", "remove")])


@query("select_source", RECS + f""" SELECT 'heuristic' AS origin, source_id, 'name' AS name_key, 'start_date' AS date_key FROM {_ONE('入职')} a
UNION ALL SELECT 'proposal', max(source_id), '姓名', '离职原因' FROM r WHERE variant = 1""")
def select_source(t):
    books = _recs(t).filter("source_type = 'excel'")
    best = books.filter("variant = 1").agg(F.max("source_id").alias("source_id")).select("source_id", F.lit("no such key").alias("name_key"), F.lit("离职原因").alias("date_key"))
    return S.select_source(books, "add").select("origin", "source_id", "name_key", "date_key").unionByName(
        S.select_source(books, "add", best).select("origin", "source_id", "name_key", "date_key")
    )
