"""Operators on tiny inline rows."""
import dataclasses
import html
import io
import random
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from rosterlake.common import positions
from rosterlake.functions import dates as D
from rosterlake.functions import text as T
from rosterlake.operators import intent as I
from rosterlake.operators import leave as L
from rosterlake.operators import naming as N
from rosterlake.operators import resolve as S
from rosterlake.operators import sheets as C
from rosterlake.plans import fill as P
from rosterlake.plans import intake as N2
from rosterlake.plans import journal as J
from rosterlake.plans import mapped as MP
from rosterlake.plans import matching as X
from rosterlake.plans.intake import run_extract


def _one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).collect()[0]
    return row["x"]


def test_unescape_like_the_standard_library(spark):
    texts = ["a &amp; b", "&copy 2020 &notit; &#65;&#x41; &#128; &#0; &#1114112; &bogus; &amp;lt; &nbsp;x", "", "&", "&;", "&Aacute", "tail &quot"]
    df = spark.createDataFrame([(s,) for s in texts], "s string").select("s", T.unescape("s").alias("u"))
    assert all(r.u == html.unescape(r.s) for r in df.collect())


@pytest.mark.parametrize("text,day", [
    ("2023-01-01", "2023-01-01"), ("2023-01-15T10:30:00Z", "2023-01-15"), ("2023/1/15", "2023-01-15"), ("20230115", "2023-01-15"), ("2023-02-30", None),
    ("202511", None), ("2025-11", None), ("not_a_date", None), ("", None), ("2024-W05-3", "2024-01-31"),
])
def test_record_date(spark, text, day):
    assert _one(spark, D.iso(D.record_date("t")), t=text) == day


@pytest.mark.parametrize("text,kind", [("123456789012345678", "text"), ("12345678901234567X", "text"), ("13800138000", "text"), ("1,234", "long"), ("12.5", "double"), ("2023.01.15", "date"), ("15/01/2023", "date"), ("nan", "text"), (" ", "empty")])
def test_typed_cell(spark, text, kind):
    assert _one(spark, D.typed_cell("t")["kind"], t=text) == kind


def test_years(spark):
    sent = spark.range(1).select(F.lit("2025-12-15").cast("date").alias("d"))
    wide = sent.select(*[D.year_wide(F.col("d"), F.lit(m)).alias(f"m{m}") for m in (1, 2, 3, 12)]).collect()[0]
    assert tuple(wide) == (2026, 2026, 2025, 2025)
    assert _one(spark, D.next_month(F.col("d").cast("date")), d="2025-12-01") == "202601"


def test_leave_notice(spark):
    body = "大家好\n" + "\n".join(f"张三（4264800{i}）申请离职，离职生效日期：11月1{i}日" for i in range(3)) + "\n李四（42648009）申请离职 2025/12/10"
    df = spark.createDataFrame([("m", body)], "source_id string, body string").withColumn("mail_date", F.lit("2025-11-04").cast("date"))
    rows = {r.employee_id: r.leave_date for r in L.leave_records(df).collect()}
    assert rows == {"42648000": "2025-11-10", "42648001": "2025-11-11", "42648002": "2025-11-12", "42648009": "2025-12-10"}


def _cells(spark, rows, sheet="入职合同"):
    data = [("w", 0, sheet, r, c, v, "string") for r, row in enumerate(rows) for c, v in enumerate(row) if v]
    return spark.createDataFrame(data, "source_id string, sheet_idx int, sheet_name string, row_idx int, col_idx int, raw string, raw_type string")


def test_wide_sparse_header(spark):
    head = ["员工工号", "姓名", "公司名称", "部门", "岗位名称"] + [""] * 70
    data = [["42721486", "张三", "甲公司", "2025-01-02", "1108.00"] + [f"文本{i}" for i in range(70)]] * 2
    lay = C.sheet_layout(_cells(spark, [head, *data])).collect()[0]
    assert (lay.header_row_idx, lay.data_start_idx, lay.n_cols) == (0, 1, 75)


def test_header_on_last_row_is_retried(spark):
    lay = C.sheet_layout(_cells(spark, [["1", "2025-01-02"], ["姓名", "日期"]])).collect()[0]
    assert (lay.header_row_idx, lay.data_start_idx, lay.data_rows) == (0, 2, 0) or lay.data_rows > 0


def test_title_row_and_names(spark):
    rows = [["花名册"], ["序号", "姓名", "员工工号", "身份证号码", "入职日期"]] + [[str(i), "张三", f"EMP00{i}", "11010119900101123" + str(i), "2025-01-0" + str(i)] for i in range(1, 6)]
    cells = _cells(spark, rows)
    lay = C.sheet_layout(cells)
    named = N.name_columns(C.column_profiles(cells, lay)).filter("key <> ''")
    assert {r.col_idx: r.key for r in named.collect()} == {1: "name", 2: "employee_id", 3: "id_number", 4: "start_date"}


def test_positions_are_exact_under_any_partitioning(spark):
    rows = [(g, s, r) for g in "ab" for s in range(3) for r in random.sample(range(500), 50)]
    df = spark.createDataFrame(rows, "g string, s int, r int").repartition(7)
    got = {(x.g, x.s, x.r): x.pos for x in positions(df, ["g"], ["s", "r"], ["r"]).collect()}
    for g in "ab":
        want = sorted((s, r) for gg, s, r in rows if gg == g)
        assert [got[(g, s, r)] for s, r in want] == list(range(1, len(want) + 1))


def test_positions_of_many_small_sources(spark):
    df = spark.range(10_000).selectExpr("'all' AS g", "'' AS parent", "lpad(id * 7919 % 10000, 5, '0') AS file", "0 AS r").repartition(9)
    got = {x.file: x.pos for x in positions(df, ["g"], ["parent", "file", "r"], ["r"]).collect()}
    assert got == {f"{k:05d}": k + 1 for k in range(10_000)}


def test_first_wins_does_not_depend_on_order(spark):
    rows = [("a", f"s{i}", 0, i, f"E{i % 5}", f"d{i % 3}") for i in range(60)]
    schema = "name string, source_id string, sheet_idx int, row_idx int, employee_id string, leave_date string"
    base = spark.createDataFrame(rows, schema)
    run = lambda d: sorted(map(tuple, S.dedupe_leave(d, ["source_id", "sheet_idx", "row_idx"]).collect()))
    assert run(base) == run(base.repartition(9).orderBy(F.desc("row_idx")))


def test_grams_miss_no_pair(spark):
    words = ["".join(random.choice("abc") for _ in range(random.randint(1, 9))) for _ in range(60)]
    left = spark.createDataFrame([("t", w) for w in sorted(set(words[:30]))], "t string, a string")
    right = spark.createDataFrame([("t", w) for w in sorted(set(words[30:]))], "t string, b string")
    got = {(r.a, r.b, r.score) for r in X.similar_pairs(left, right, "a", "b", ["t"]).collect()}
    brute = left.join(right, "t").withColumn("score", X.similarity("a", "b")).filter("score >= 80")
    assert got == {(r.a, r.b, r.score) for r in brute.collect()}


def test_record_types(spark):
    df = spark.createDataFrame([("A", {"name": "A", "termination_reason": "x"}, "减员"), ("B", {"name": "B", "start_date": "x"}, "增员"), ("C", {"name": "C"}, "减员名单")], "n string, rec map<string,string>, sheet_name string")
    got = {r.n: r.k for r in df.select("n", I.combined_type("rec", "sheet_name").alias("k")).collect()}
    assert got == {"A": "remove", "B": "add", "C": "remove"}


def _docx(lines, *tables):
    para = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    row = lambda r: "<w:tr>" + "".join(f"<w:tc>{para(x)}</w:tc>" for x in r) + "</w:tr>"
    body = "".join(map(para, lines)) + "".join("<w:tbl>" + "".join(map(row, t)) + "</w:tbl>" for t in tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _mail(body, **attached):
    m = EmailMessage()
    m["From"], m["To"], m["Date"], m["Subject"] = "a@x.cn", "b@x.cn", "Tue, 04 Nov 2025 10:00:00 +0000", "notice"
    m.set_content(body)
    for name, data in attached.items():
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name.replace("_", "."))
    return m.as_bytes()


def test_attachments_of_attachments_are_read(spark):
    line = lambda k: f"张三（4264800{k}）申请离职，离职生效日期：2025-11-1{k}"
    inner = _mail(line(2), deep_docx=_docx([line(3), "end"]), bad_docx=b"no archive")
    outer = _mail(line(1), inner_eml=inner, note_txt=line(4).encode(), other_bin=b"xx")
    files = spark.createDataFrame([("m1", "m1.eml", "/m1.eml", bytearray(outer)), ("t1", "t1.txt", "/t1.txt", bytearray(line(5).encode()))], "source_id string, source_file string, file_path string, content binary")
    out = run_extract(files)
    got = {(r.rec["employee_id"], r.rec["leave_date"], r.source_file.rsplit(".", 1)[1]) for r in out.records.collect()}
    assert got == {(f"4264800{k}", f"2025-11-1{k}", kind) for k, kind in ((1, "eml"), (2, "eml"), (3, "docx"), (4, "txt"), (5, "txt"))}
    assert {(r.stage, r.code) for r in out.warnings.collect()} == {("decode", "BadZipFile"), ("route", "no_reader")}
    assert out.sources.count() == 7


def test_a_cell_given_twice_does_not_stop_the_sheet(spark):
    cells = _cells(spark, [["姓名", "员工工号"], ["张三", "E1"], ["李四", "E2"], ["王五", "E3"]])
    twice = cells.unionByName(cells.filter("row_idx = 1 AND col_idx = 0").withColumn("raw", F.lit("赵六")))
    assert C.sheet_rows(twice, C.sheet_layout(twice)).count() >= 2


def test_forms_without_a_plan_take_all_sources(spark):
    rows = [("s1", 0, 1, {"name": "甲", "employee_id": "1"}), ("s1", 0, 2, {"name": "乙", "employee_id": "2"}), ("s2", 0, 1, {"工号": "3", "姓名": "丙"}), ("s3", 0, 1, {"name": "丁", "employee_id": "4"})]
    records = spark.createDataFrame([(*r, f"{r[0]}.xlsx", "excel") for r in rows], "source_id string, sheet_idx int, row_idx int, rec map<string,string>, source_file string, source_type string")
    heads = [(f, 0, "表1", "r1", k + 1, "AB"[k], h, 1, 9, 1, 2, 2) for f, names in (("f1", ("姓名", "工号")), ("f2", ("甲列", "乙列"))) for k, h in enumerate(names)]
    columns = spark.createDataFrame(heads, "template_id string, sheet_idx int, sheet string, region_id string, col_index int, col_letter string, header_path string, first_row int, last_row int, first_col int, last_col int, data_row int")
    got = lambda **o: {(r.template_id, r.row, r.col_letter, r.value) for r in P.fallback_cells(records, columns, spark.createDataFrame([], "template_id string"), **o).collect()}
    people = [("甲", "1"), ("乙", "2"), ("丙", "3"), ("丁", "4")]
    named = {("f1", 2 + k, c, v) for k, p in enumerate(people) for c, v in zip("AB", p)}
    found = got()
    assert {x for x in found if x[0] == "f1"} == named
    assert {x[1] for x in found if x[0] == "f2"} == {2, 3, 4, 5}
    assert {x for x in got(one_source=True) if x[0] == "f1"} == {x for x in named if x[1] < 4}


def test_tables_of_documents_are_read(spark):
    people = [["姓名", "员工工号", "离职日期"], ["张三", "42648001", "2025-11-01"], ["李四", "42648002", "2025-11-02"], ["王五", "42648003", "2025-11-03"]]
    odd = [["qq", "ww"], ["1", "2"]]
    box = [["赵六（42648009）申请离职，离职生效日期：2025-11-19"]]
    files = spark.createDataFrame([("d1", "d1.docx", "/d1.docx", bytearray(_docx(["see below"], people, odd, box)))], "source_id string, source_file string, file_path string, content binary")
    got = run_extract(files).records.collect()
    tables = [r for r in got if r.extraction_type == "table"]
    assert {(r.rec["name"], r.rec["employee_id"]) for r in tables if r.sheet_idx == 0} == {(p[0], p[1]) for p in people[1:]}
    assert [(r.rec["qq"], r.rec["ww"], r.source_file) for r in tables if r.sheet_idx == 1] == [("1", "2", "d1.docx")]
    assert [r.rec["employee_id"] for r in got if r.extraction_type == "leave_lines"] == ["42648009"]


def test_winners_by_id_stay_out_of_the_join_by_name(spark):
    """Nine of ten rows have ids; equal rows without id and name all stay."""
    rows = [(f"E{k}" if k % 10 else "", "" if k % 20 == 0 else f"n{k}", "", "2025-01-01", "s", 0, k) for k in range(400)]
    rows += [("", "", "x", "2025-01-02", "s", 0, 9000)] * 3 + [("", "n11", "", "2025-01-01", "s", 0, 9001)]
    table = spark.createDataFrame(rows, "employee_id string, name string, leave_date_text string, leave_date string, source_id string, sheet_idx int, row_idx int")
    out = S.dedupe_leave(table, ["source_id", "sheet_idx", "row_idx"])
    got = sorted(r.row_idx for r in out.collect())
    assert got == sorted([k for k in range(400)] + [9000] * 3)
    joins = out._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins == 1  # only rows matched by name meet the covered names


def test_mapped_form(spark):
    """Derived months take the form's own style; constants, filter, gate and open headers."""
    rows = [("s1", 0, k, {"姓名": n, "员工工号": no, "入职日期": d, "部门": dep}) for k, (n, no, d, dep) in enumerate([("甲", "1", "2025-09-18", "A"), ("乙", "2", "2025/10/02", "a "), ("丙", "3", "", "A"), ("丁", "4", "2025-09-01", "B")])]
    rows += [("s1", 0, 9, {"姓名": "", "员工工号": "", "入职日期": "", "部门": "A"})]
    records = spark.createDataFrame([(*r, "入职名单.xlsx", "excel", None) for r in rows], "source_id string, sheet_idx int, row_idx int, rec map<string,string>, source_file string, source_type string, sheet_name string")
    heads = ["参保人/姓名", "证件号码", "社保/申报类型", "费用年月"]
    columns = spark.createDataFrame([("f", 0, "表1", "r1", k + 1, "ABCD"[k], h, 1, 9, 1, 4, 3, ["202509"] if k == 3 else []) for k, h in enumerate(heads)],
        "template_id string, sheet_idx int, sheet string, region_id string, col_index int, col_letter string, header_path string, first_row int, last_row int, first_col int, last_col int, data_row int, sample_values array<string>")
    forms = spark.createDataFrame([("f", "表.xlsx", None)], "template_id string, filename string, intent string")
    said = '{"column_mapping": {"参保人/姓名": "姓名", "证件号码": "员工工号"%s}, "constant_values": {"申报类型": "增"}, "record_filter": {"field": "部门", "values": ["a"]}%s}'
    derived = ', "derived_fields": [{"new_key": "__m__", "op": "MONTH_FROM_DATE", "args": {"source_keys": ["签订日期", "入职日期"], "strategy": "first_non_empty", "output_format": "from_template_sample"}}]'
    for reply, months, key in ((said % (', "费用年月": "__m__"', derived), ["202509", "202510", ""], "__m__"), (said % ("", ""), ["202509", "202510", ""], "__fee_month__")):
        mappings = MP.read_mappings(spark.createDataFrame([("f", reply)], "template_id string, reply string"))
        cells = {(r.row, r.col_letter): (r.key, r.value) for r in MP.mapped_plan(records, columns, forms, mappings).collect()}
        assert [cells[3 + k, "A"][1] for k in range(3)] == ["甲", "乙", "丙"] and (6, "A") not in cells
        assert [cells[3 + k, "D"] for k in range(3)] == [(key, m) for m in months]
        assert {cells[3 + k, "C"] for k in range(3)} == {("__const__申报类型", "增")}


def test_log_tells_rows_that_were_lost(spark):
    some = spark.createDataFrame([("a", "rows", 5, 3, {"before_data": 2}), ("b", "rows", 5, 3, {"before_data": 1})], "source_id string, unit string, n_read long, n_kept long, dropped map<string,bigint>")
    assert [r.source_id for r in J.unbalanced(some).collect()] == ["b"]
    cells = _cells(spark, [["姓名", "员工工号"], ["张三", "42648001"], ["李四", "42648002"], ["王五", "42648003"]])
    read = N2.read_sheets(cells, None, keep=True)
    events, counters = J.sheet_log(J.sheet_facts(read))
    assert [(r.n_read, r.n_kept, r.dropped) for r in counters.collect()] == [(4, 3, {"before_data": 1})]
    lost = dataclasses.replace(read, records=read.records.filter("row_idx <> 2"))
    assert J.unbalanced(J.sheet_log(J.sheet_facts(lost))[1]).count() == 1
