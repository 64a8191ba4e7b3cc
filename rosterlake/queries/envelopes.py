"""Queries for facts, summaries, signatures and replies."""
from pyspark.sql import functions as F

from ..operators import facts as A
from ..operators import replies as Q
from ..sources import route as Z
from .derive import RECORD_COLS, _map, records
from .people import KV, RECS
from .registry import query


def _recs(t):
    return records(t).select(*RECORD_COLS)


# One extracted payload per event: scalars, a container and a falsy value.
def _payloads(t):
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    k = F.col("event_id")
    rec = _map(
        ("type", q("event_type")), ("value", F.when(k % 4 == 0, F.lit("0")).when(k % 4 == 1, F.lit("null")).otherwise(F.col("user_id").cast("string"))),
        ("props", "props"), ("data", F.lit("[1]")), ("note", F.when(k % 50 == 7, q("event_type")).otherwise(F.lit('""'))), ("never", F.lit("false")),
    )
    return t.events.select(
        F.concat(F.lit("e"), F.lpad(k.cast("string"), 9, "0")).alias("source_id"), F.concat(F.lit("f"), (k % 37).cast("string")).alias("source_file"),
        F.when(k % 3 == 0, F.lit("image")).otherwise(F.lit("email")).alias("source_type"), F.lit("").alias("parent_source_id"), rec.alias("payload"),
    )


_PAY = """
WITH p AS (SELECT event_id, concat('e', lpad(cast(event_id AS string), 9, '0')) AS source_id, concat('f', event_id % 37) AS source_file, CASE event_id % 3 WHEN 0 THEN 'image' ELSE 'email' END AS source_type,
  ['type', 'value', 'props', 'data', 'note', 'never'] AS ks, [concat('"', event_type, '"'), CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN 'null' ELSE cast(user_id AS string) END, props, '[1]', CASE WHEN event_id % 50 = 7 THEN concat('"', event_type, '"') ELSE '""' END, 'false'] AS vs FROM {events}),
kv AS (SELECT source_id, source_file, source_type, unnest(ks) AS key, unnest(vs) AS value FROM p)
"""


@query("facts", _PAY + "SELECT key AS name, value, source_id, source_file AS filename FROM kv")
def facts(t):
    f = A.facts(_payloads(t))
    return f.select("name", "value", F.col("sources")[0]["source_id"].alias("source_id"), F.col("sources")[0]["filename"].alias("filename"))


@query("merged_scalars", _PAY + """, s AS (SELECT *, NOT (value IN ('null', 'false', '""', '0')) AS truthy FROM kv WHERE key NOT IN ('props', 'data'))
SELECT key, coalesce(arg_min(value, concat_ws('|', source_type, source_file, source_id)) FILTER (truthy), arg_max(value, concat_ws('|', source_type, source_file, source_id))) AS value FROM s GROUP BY 1""")
def merged_scalars(t):
    return A.merged_scalars(_payloads(t))


@query("image_facts", """
SELECT concat('i', event_id) AS source_id, v.name, CASE v.k WHEN 1 THEN event_type WHEN 2 THEN cast(user_id AS string) WHEN 3 THEN 'x' WHEN 4 THEN event_type WHEN 5 THEN cast(user_id AS string) ELSE 'sum' END AS value
FROM {events}, (VALUES ('kind', 1), ('table_1_row_1_a', 2), ('table_1_row_2_a', 3), ('number_1_id', 5), ('number_2_unknown', 4), ('summary', 6)) v(name, k)""")
def image_facts(t):
    one = lambda k, v: F.create_map(F.lit(k), v)
    uid, kind = F.col("user_id").cast("string"), F.col("event_type")
    x = t.events.select(
        F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("source_id"), F.lit("f.png").alias("source_file"), one("kind", kind).alias("fields"),
        F.array(F.array(one("a", uid), one("a", F.lit("x")))).alias("tables"),
        F.array(F.struct(F.lit("id").alias("type"), uid.alias("text")), F.struct(F.lit(None).cast("string").alias("type"), kind.alias("text"))).alias("numbers"), one("summary", F.lit("sum")).alias("other"),
    )
    return A.image_facts(x).select(F.col("sources")[0]["source_id"].alias("source_id"), "name", "value")


@query("lineage_fields", RECS + " SELECT source_id, row_idx, sheet_idx, source_file AS f, source_type AS ty, '' AS p, len(CASE variant WHEN 2 THEN [1, 2, 3] WHEN 5 THEN [1, 2, 3, 4, 5] ELSE [1, 2, 3, 4] END) + 3 AS n FROM r")
def lineage_fields(t):
    get = lambda k: F.try_element_at("rec", F.lit(k))
    return A.with_lineage(A.with_lineage(_recs(t))).select(
        "source_id", "row_idx", "sheet_idx", get("__source_file__").alias("f"), get("__source_type__").alias("ty"), get("__parent_source_id__").alias("p"), F.size("rec").cast("bigint").alias("n")
    )


_TREE = """, h AS (SELECT source_id, sha256(concat('{', string_agg(concat('"', key, '":"', value, '"'), ',' ORDER BY key), '}')) AS h, source_id || sheet_idx || row_idx AS rid FROM kv GROUP BY source_id, sheet_idx, row_idx),
g AS (SELECT source_id, h, count(*) AS n FROM h GROUP BY 1, 2),
deep AS (SELECT source_id, left(h, 6) AS p, sha256(string_agg(concat(h, ':', n), ',' ORDER BY concat(h, ':', n))) AS h FROM g GROUP BY 1, 2),
mid AS (SELECT source_id, left(p, 3) AS q, sha256(string_agg(concat(p, ':', h), ',' ORDER BY concat(p, ':', h))) AS h FROM deep GROUP BY 1, 2)
"""


@query("signature", KV + _TREE + "SELECT source_id, sha256(string_agg(concat(q, ':', h), ',' ORDER BY concat(q, ':', h))) AS signature FROM mid GROUP BY 1")
def signature(t):
    return A.signatures(_recs(t))


@query("signature_order", "SELECT true AS same, true AS differs")
def signature_order(t):
    r = _recs(t)
    src = r.select("source_id", "source_file", "source_type", "parent_source_id").distinct()
    one = A.total_signature(A.signatures(r), src)
    two = A.total_signature(A.signatures(r.repartition(5).sortWithinPartitions(F.desc("row_idx"))), src)
    other = A.total_signature(A.signatures(r.filter("row_idx <> 7")), src)
    flat = one.withColumn("k", F.lit(1)).unionByName(two.withColumn("k", F.lit(2))).unionByName(other.withColumn("k", F.lit(3)))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("signature")))
    return flat.agg((pick(1) == pick(2)).alias("same"), (pick(1) != pick(3)).alias("differs"))


_SUMS = KV + """, h AS (SELECT source_id, variant, row_idx, sha256(concat(source_id, '|{', string_agg(concat('"', key, '":"', value, '"'), ',' ORDER BY key), '}')) AS h FROM kv GROUP BY source_id, variant, sheet_idx, row_idx),
w AS (SELECT *, CASE WHEN variant = 1 AND row_idx = 7 THEN 0 WHEN variant = 1 AND row_idx = 8 THEN 2 ELSE 1 END AS times FROM h),
z AS (SELECT sum(times)::bigint AS n, """ + ", ".join(f"sum(times * ('0x' || substr(h, {8 * k + 1}, 8))::bigint)::bigint AS s{k}" for k in range(8)) + """ FROM w)
"""


@query("signature_update", _SUMS + "SELECT *, sha256(concat_ws(',', n, s0, s1, s2, s3, s4, s5, s6, s7)) AS signature FROM z")
def signature_update(t):
    """The sums of all records, then those of some sources replaced: a row of each gone, one doubled."""
    r = records(t).select(*RECORD_COLS, "variant")
    theirs = r.filter("variant = 1")
    new = theirs.filter("row_idx <> 7").withColumn("again", F.explode(F.array_repeat(F.lit(0), F.when(F.col("row_idx") == 8, 2).otherwise(1)))).drop("again")
    return A.sum_signature(A.changed_sums(A.record_sums(r), A.record_sums(theirs), A.record_sums(new)))


# ------------------------------------------------------------------ counts
def _sources(t):
    files = t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.element_at(F.array(*[F.lit(e) for e in (".xlsx", ".eml", ".png", ".txt", ".bin", ".docx", ".html", "")]), (F.col("page_id") % 8 + 1).cast("int"))).alias("source_file"), "page_id")
    return Z.route(files).withColumn("error", F.when(F.col("page_id") % 9 == 0, F.lit("bad file")))


_SRC_TYPE = "CASE page_id % 8 WHEN 0 THEN 'excel' WHEN 1 THEN 'email' WHEN 2 THEN 'image' WHEN 3 THEN 'email' WHEN 5 THEN 'email' WHEN 6 THEN 'text' ELSE 'other' END"


@query("summary_by_type", f"SELECT {_SRC_TYPE} AS source_type, count(*) AS n_sources, sum(CASE WHEN page_id % 9 = 0 THEN 1 ELSE 0 END) AS n_errors FROM {{pages}} GROUP BY 1")
def summary_by_type(t):
    return A.source_summary(_sources(t))


@query("source_errors", f"SELECT concat('p', page_id, CASE page_id % 8 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.eml' WHEN 2 THEN '.png' WHEN 3 THEN '.txt' WHEN 4 THEN '.bin' WHEN 5 THEN '.docx' WHEN 6 THEN '.html' ELSE '' END) AS source_file, {_SRC_TYPE} AS source_type, 'bad file' AS error FROM {{pages}} WHERE page_id % 9 = 0")
def source_errors(t):
    return A.source_errors(_sources(t))


@query("sorted_sources", RECS + " SELECT DISTINCT source_id, source_type, source_file FROM r")
def sorted_sources(t):
    s = _recs(t).select("source_id", "source_type", "source_file", "parent_source_id").distinct()
    return A.sorted_sources(s).select("source_id", "source_type", "source_file")


@query("record_counts", RECS + """ SELECT source_id, source_file, sheet_name, coalesce(CASE WHEN variant = 4 THEN CASE o_orderkey % 3 WHEN 1 THEN 'remove' WHEN 2 THEN 'add' END END, CASE variant WHEN 0 THEN 'add' WHEN 2 THEN 'add' WHEN 5 THEN 'remove' END,
  CASE WHEN sheet_name IN ('减员', '离职_1') THEN 'remove' WHEN sheet_name = '增员' THEN 'add' END, 'unknown') AS record_type, count(*) AS n_records FROM r GROUP BY 1, 2, 3, 4""")
def record_counts(t):
    return A.record_counts(_recs(t))


@query("contributing_files", RECS + " SELECT source_file, count(*) AS n_records FROM r GROUP BY 1")
def contributing_files(t):
    return A.contributing_files(_recs(t))


@query("constant_fields", RECS + " SELECT 'intent' AS key, 'remove' AS value FROM r WHERE variant = 3 LIMIT 1")
def constant_fields(t):
    only = records(t).filter("variant = 3").select(*RECORD_COLS)
    return A.constant_fields(only, ["intent", "name", "missing"])


@query("usage_totals", "SELECT event_type AS step, sum(user_id) AS input_tokens, sum(event_id % 7) AS output_tokens, sum(user_id + event_id % 7) AS total_tokens, count(*) AS requests FROM {events} GROUP BY 1")
def usage_totals(t):
    calls = t.events.select(F.col("event_type").alias("step"), F.col("user_id").alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"))
    return A.usage_totals(calls)


@query("source_profiles", RECS + """, k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sheet_idx, row_idx) AS rn FROM r)
SELECT source_id, CASE max(variant) WHEN 0 THEN 'name,id_number' WHEN 1 THEN '姓名,工号' WHEN 2 THEN 'name,id_number' WHEN 3 THEN 'name,employee_id' WHEN 4 THEN '员工姓名,身份证号' ELSE 'name,备用' END AS record_keys, least(count(*), 2) AS n_samples,
  max(CASE WHEN rn = 1 THEN CASE WHEN variant = 5 THEN concat('9', o_custkey) ELSE nm END END) AS first_name FROM k GROUP BY 1""")
def source_profiles(t):
    p = A.source_profiles(_recs(t), max_keys=2, samples=2, max_fields=1)
    first = F.map_values(F.from_json(F.col("sample_records")[0], "map<string,string>"))[0]
    return p.select("source_id", F.array_join("record_keys", ",").alias("record_keys"), F.size("sample_records").cast("bigint").alias("n_samples"), first.alias("first_name"))


@query("merge_readers", """
SELECT concat('d', doc_id) AS source_id, v.field, CASE WHEN v.field = 'lang' THEN lang WHEN doc_id % 2 = 0 AND v.field = 'source' THEN source WHEN v.field = 'source' THEN 'alt' ELSE 'gap' END AS value, CASE WHEN v.field = 'lang' OR (doc_id % 2 = 0 AND v.field = 'source') THEN 'first' ELSE 'second' END AS reader
FROM {documents}, (VALUES ('lang'), ('source'), ('extra')) v(field)""")
def merge_readers(t):
    sid = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id")
    spread = lambda d, **fields: d.select(sid, F.explode(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])).alias("field", "value"))
    first = spread(t.documents, lang=F.col("lang"), source=F.col("source")).filter((F.col("field") == "lang") | (F.substring("source_id", -1, 1).cast("int") % 2 == 0))
    second = spread(t.documents, lang=F.lit("other"), source=F.lit("alt"), extra=F.lit("gap"))
    return A.merge_fields(first, second)


@query("merge_reader_tables", """
SELECT concat('o', l_orderkey) AS source_id, CASE WHEN n2 > n1 THEN 'second' ELSE 'first' END AS reader, greatest(n1, n2) AS n FROM (SELECT l_orderkey, count(*) FILTER (l_linenumber <= 3) AS n1, count(*) FILTER (l_linenumber > 3) AS n2 FROM {lineitem} GROUP BY 1) z""")
def merge_reader_tables(t):
    x = t.lineitem.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source_id"), F.col("l_linenumber").alias("row_idx"), F.create_map(F.lit("q"), F.col("l_quantity").cast("string")).alias("rec"))
    m = A.merge_tables(x.filter("row_idx <= 3"), x.filter("row_idx > 3"))
    return m.groupBy("source_id", "reader").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_warnings", "SELECT event_type AS scope, concat('c', user_id % 5) AS code, 'x' AS detail, min(event_id) AS event_id FROM {events} GROUP BY 1, 2")
def distinct_warnings(t):
    w = t.events.select(F.col("event_type").alias("scope"), F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("code"), F.lit("x").alias("detail"), "event_id")
    return A.distinct_warnings(w, ["event_id"])


# ----------------------------------------------------------------- replies
def _replies(t):
    """Replies in seven writings around one JSON object per event."""
    good = F.concat(F.lit('{"data":[{"name":"张三","n":'), F.col("user_id").cast("string"), F.lit('},{"x":null}],"warnings":["w1","w1",""]}'))
    k = F.col("event_id") % 7
    text = (
        F.when(k == 0, good).when(k == 1, F.concat(F.lit("sure:\n```json\n"), good, F.lit("\n```\nbye"))).when(k == 2, F.concat(F.lit("Answer "), good, F.lit(" and more } text")))
        .when(k == 3, F.lit("  ")).when(k == 4, F.lit("no json { here")).when(k == 5, F.concat(F.lit('[{"name":"'), F.col("event_type"), F.lit('"}]')))
        .otherwise(F.lit('{"data":5,"metadata":[],"warnings":"no"}'))
    )
    return t.events.select("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source_id"), text.alias("reply"), "event_type", "user_id")


_GOOD = """concat('{"data":[{"name":"张三","n":', user_id, '},{"x":null}],"warnings":["w1","w1",""]}')"""


@query("reply_parse", f"""SELECT event_id, CASE event_id % 7 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN concat('[{{"name":"', event_type, '"}}]') WHEN 6 THEN '{{"data":5,"metadata":[],"warnings":"no"}}' ELSE {_GOOD} END AS json, CASE event_id % 7 WHEN 3 THEN 'empty_output' WHEN 4 THEN 'unable_to_parse_json' END AS parse_error FROM {{events}}""")
def reply_parse(t):
    return _replies(t).select("event_id", Q.parse_reply("reply").alias("p")).select("event_id", "p.json", "p.parse_error")


@query("reply_shape", """SELECT event_id, CASE WHEN event_id % 7 < 3 THEN 2 WHEN event_id % 7 = 5 THEN 1 ELSE 0 END AS n_data, '{}' AS metadata, CASE WHEN event_id % 7 < 3 THEN 'w1' WHEN event_id % 7 < 5 THEN 'reply is empty' WHEN event_id % 7 = 5 THEN 'reply is an array; wrapped into data'
  ELSE '''data'' is not a list; replaced with []|''metadata'' is not an object; replaced with {}|''warnings'' is not a list; replaced with []' END AS warnings FROM {events}""")
def reply_shape(t):
    s = _replies(t).select("event_id", Q.coerce_shape(Q.parse_reply("reply")["json"]).alias("s"))
    return s.select("event_id", F.size("s.data").alias("n_data"), "s.metadata", F.array_join("s.warnings", "|").alias("warnings"))


@query("body_records", """SELECT concat('e', event_id) AS source_id, cast(i AS int) AS row_idx, CASE WHEN i = 0 THEN CASE event_id % 7 WHEN 5 THEN event_type ELSE '张三' END END AS name, CASE WHEN i = 0 AND event_id % 7 < 3 THEN cast(user_id AS string) END AS n, 'm.eml' AS file
FROM {events}, (VALUES (0), (1)) v(i) WHERE event_id % 10 <> 0 AND (event_id % 7 < 3 OR (event_id % 7 = 5 AND i = 0))""")
def body_records(t):
    r = _replies(t)
    mails = r.select("source_id", F.lit("m.eml").alias("source_file"), F.when(F.col("event_id") % 10 == 0, F.lit(" ")).otherwise(F.lit("body")).alias("body"))
    out = Q.explode_records(Q.body_records(mails, r))
    get = lambda k: F.try_element_at("rec", F.lit(k))
    return out.select("source_id", "row_idx", get("name").alias("name"), get("n").alias("n"), get("__source_file__").alias("file"))


@query("body_warnings", "SELECT CASE WHEN event_id % 10 = 0 THEN 'body_extracted: empty normalized body text' WHEN event_id % 11 = 0 THEN 'body_extracted: no reply' WHEN event_id % 7 = 3 THEN 'body_extracted: empty_output' WHEN event_id % 7 = 4 THEN 'body_extracted: unable_to_parse_json' END AS warning, count(*) AS n FROM {events} GROUP BY 1")
def body_warnings(t):
    r = _replies(t)
    mails = r.select("source_id", F.lit("m.eml").alias("source_file"), F.when(F.col("event_id") % 10 == 0, F.lit(" ")).otherwise(F.lit("body")).alias("body"))
    return Q.body_records(mails, r.filter("event_id % 11 <> 0")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


@query("containers", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS n, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN 'own' END AS first_a FROM {events}")
def containers(t):
    k, e = F.col("event_id") % 5, F.col("event_type")
    j = (
        F.when(k == 0, F.concat(F.lit('{"other":[{"a":"z"}],"data":[],"rows":[{"a":"'), e, F.lit('"},{"b":1},3]}'))).when(k == 1, F.concat(F.lit('{"m":1,"zzz":[{"a":"'), e, F.lit('"}]}')))
        .when(k == 2, F.lit('[{"a":"own"},[1]]')).when(k == 3, F.lit('{"data":[1,2]}')).otherwise(F.lit('"text"'))
    )
    x = t.events.select("event_id", Q.container_items(j).alias("items"))
    return x.select("event_id", F.size("items").alias("n"), F.try_element_at(Q.item_record(F.try_element_at("items", F.lit(1))), F.lit("a")).alias("first_a"))


def _mappings(t):
    """Mapping replies with columns, constants, a filter and derived fields."""
    k, e = F.col("event_id") % 4, F.col("event_type")
    full = F.concat(
        F.lit('{"column_mapping":{" 姓名 ":"name","空":" ","数":5,"嵌套":{"a":1}},"constant_values":{"申报类型":"'), e, F.lit('","n":7,"x":null},"record_filter":{"field":" kind ","values":["'), e,
        F.lit('",null,2],"exclude":true},"derived_fields":[{"new_key":"m","op":"MONTH_FROM_DATE","args":{"source_keys":["d","e"],"strategy":"first_non_empty","output_format":"YYYYMM"}},{"new_key":"","op":"x"},{"new_key":"q","op":"SUM","args":{}},7,'
              '{"new_key":"r","op":"MONTH_FROM_DATE","args":[]},{"new_key":"r","op":"MONTH_FROM_DATE","args":{"source_keys":[" "],"strategy":"first_non_empty","output_format":"YYYYMM"}},{"new_key":"r","op":"MONTH_FROM_DATE","args":{"source_keys":["a"],"strategy":"last","output_format":"YYYYMM"}},'
              '{"new_key":"r","op":"MONTH_FROM_DATE","args":{"source_keys":["a"],"strategy":"first_non_empty","output_format":"MM"}}]}'),
    )
    plain = F.lit('{"证件号码":"id_number","constant_values":{},"record_filter":{"field":"","values":[]}}')
    return t.events.select("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source_id"), F.when(k < 2, full).when(k == 2, plain).otherwise(F.lit("[1]")).alias("json"), "event_type")


@query("reply_mapping", """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN '姓名=name,数=5' WHEN event_id % 4 = 2 THEN '证件号码=id_number' END AS columns, CASE WHEN event_id % 4 < 2 THEN concat('申报类型=', event_type, ',n=7') ELSE '' END AS constants,
  CASE WHEN event_id % 4 < 2 THEN concat('kind:', event_type, ',2:true') END AS record_filter FROM {events}""")
def reply_mapping(t):
    flat = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    rf = F.col("p.record_filter")
    return _mappings(t).select("event_id", Q.mapping_parts("json").alias("p")).select(
        "event_id", flat(F.col("p.columns")).alias("columns"), flat(F.col("p.constants")).alias("constants"),
        F.when(rf.isNotNull(), F.concat(rf["field"], F.lit(":"), F.array_join(rf["values"], ","), F.lit(":"), rf["exclude"].cast("string"))).alias("record_filter"),
    )


@query("derived_specs", "SELECT concat('e', event_id) AS source_id, cast(v.idx AS int) AS idx, v.new_key, v.reject FROM {events}, (VALUES (0, 'm', NULL), (1, '', 'missing new_key'), (2, 'q', 'unsupported op'), (3, NULL, 'not an object'), (4, 'r', 'args must be object'), (5, 'r', 'invalid source_keys'), (6, 'r', 'invalid strategy'), (7, 'r', 'invalid output_format')) v(idx, new_key, reject) WHERE event_id % 4 < 2")
def derived_specs(t):
    return Q.derived_fields(_mappings(t)).select("source_id", "idx", "new_key", "reject")


@query("target_mapping", """SELECT concat('e', event_id) AS source_id, v.target, v.key, v.known, v.warning FROM {events}, (VALUES ('name', 'nm', true, NULL), ('event_date', 'gone', false, 'mapping_invalid_key:event_date->gone')) v(target, key, known, warning)""")
def target_mapping(t):
    k = F.col("event_id")
    body = F.lit('{"name":"nm","event_date":"gone","unknown":"nm","id_number":" "}')
    j = F.when(k % 2 == 0, F.concat(F.lit('{"target_field_to_source_key":'), body, F.lit("}"))).otherwise(F.concat(F.lit('{"mapping":'), body, F.lit("}")))
    r = t.events.select(F.concat(F.lit("e"), k.cast("string")).alias("source_id"), j.alias("json"))
    return Q.target_mapping(r, r.select("source_id", F.lit("nm").alias("key"))).select("source_id", "target", "key", "known", "warning")


@query("record_strings", """SELECT event_id, 'name,n,o' AS keys, cast(user_id AS string) AS n, '{"p":1}' AS o, '' AS nul FROM {events}""")
def record_strings(t):
    item = F.concat(F.lit('{"name":null,"n":'), F.col("user_id").cast("string"), F.lit(',"o":{"p":1}," ":"drop"}'))
    x = t.events.select("event_id", Q.item_record(item).alias("rec"))
    get = lambda k: F.try_element_at("rec", F.lit(k))
    return x.select("event_id", F.array_join(F.map_keys("rec"), ",").alias("keys"), get("n").alias("n"), get("o").alias("o"), get("name").alias("nul"))
