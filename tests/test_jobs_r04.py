"""Small cases of the findings of round 4 on whole jobs."""
import pytest
from pyspark.sql import functions as F

from rosterlake.functions import dates as D
from rosterlake.functions import text as T
from rosterlake.operators import sheets as C
from rosterlake.plans import intake as N
from rosterlake.plans import journal as J
from rosterlake.queries.files import workbook_bytes
from rosterlake.sources import mail as M

_PEOPLE = [["姓名", "员工工号", "离职年月"], ["张三", "42648001", "2025-11-01"], ["李四", "42648002", "2025/11/2"], ["王五", "42648003", "45000"]]


def _cells(spark, extra=()):
    rows = [("b", 0, "表", r, c, v, "string") for r, row in enumerate(_PEOPLE) for c, v in enumerate(row)]
    return spark.createDataFrame([*rows, *extra], "source_id string, sheet_idx int, sheet_name string, row_idx int, col_idx int, raw string, raw_type string")


def test_log_and_records_are_worked_out_when_asked_for(spark, monkeypatch):
    """the log reads no tables of documents, records need no log."""
    files = spark.createDataFrame([("b", "b.xlsx", "/b.xlsx", bytearray(workbook_bytes({"表": _PEOPLE}))), ("d", "d.docx", "/d.docx", bytearray(b"no"))], "source_id string, source_file string, file_path string, content binary")

    def unasked(*_):
        raise AssertionError("not asked for")

    with monkeypatch.context() as m:
        m.setattr(N, "document_records", unasked)
        out = N.run_extract(files)
        assert {(r.source_id, r.unit, r.n_read, r.n_kept) for r in out.counters.collect()} == {("b", "files", 1, 1), ("d", "files", 1, 0), ("b", "rows", 4, 3)}
        assert {(r.scope, r.stage) for r in out.warnings.collect()} == {("b", "sheet"), ("d", "decode")}
        with pytest.raises(AssertionError):
            out.records
    with monkeypatch.context() as m:
        m.setattr(J, "sheet_log", unasked)
        assert N.run_extract(files).records.count() == 3


def test_shapes_and_rows_of_sheets_without_a_sort_of_cells(spark):
    """shapes are hashed, a row's cells are gathered in one aggregation; of a cell
    given twice the lesser text is taken."""
    cells = _cells(spark, [("b", 0, "表", 1, 0, "丁一", "string"), ("b", 0, "表", 1, 0, "张三", "number")])
    shapes = C.sheet_shapes(cells)
    texts = [a for a in shapes._jdf.queryExecution().executedPlan().toString().splitlines() if "SortAggregate" in a]
    assert all("row_idx" not in a for a in texts) and [tuple(r) for r in shapes.collect()] == [("b", 0, "表", 4, 3)]
    rows = C.sheet_rows(cells, C.sheet_layout(cells).withColumn("x", F.lit(1)))
    given = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct(text" not in given
    got = {r.row_idx: {k: (v.text, v.raw_type) for k, v in r.vals.items()} for r in rows.collect()}
    assert got[1] == {0: ("丁一", "string"), 1: ("42648001", "string"), 2: ("2025-11-01", "string")} and set(got) == {1, 2, 3}


def test_kinds_of_rows_are_counted_once(spark):
    """layout and ranks from written kinds are those from the cells."""
    cells = _cells(spark)
    read = N.read_sheets(cells, None, keep=True)
    assert read.kinds.count() == 4
    for one in (C.sheet_layout, C.rank_sheets):
        assert [str(r) for r in one(cells).collect()] == [str(r) for r in one(cells, kinds=read.kinds).collect()]


def test_values_of_records_are_trimmed_once(spark):
    """the looked-up value stands once in the plan and is what `normalize_value` gives."""
    texts = [" 2025-11-1", "2025.3", "2025年3月4日", "45000", "45000.5", "x ", "2025-02-30", "", None, "２０２５"]
    df = spark.createDataFrame([(i, t, k) for i, t in enumerate(texts) for k in ("string", "number", "timestamp", None)], "i int, t string, k string")
    for serial in (F.lit(True), F.lit(False)):
        one = F.coalesce(T.let(T.utrim("t"), lambda t: D.trimmed_value(t, F.col("k"), serial)), F.lit(""))
        assert all(r.a == r.b for r in df.select(one.alias("a"), D.normalize_value("t", "k", serial).alias("b")).collect())
    cells = _cells(spark)
    layout = C.sheet_layout(cells)
    named = layout.select("source_id", "sheet_idx", "sheet_name", "n_cols", F.lit(1.0).alias("coverage"), F.lit(0).alias("col_idx"), F.lit("name").alias("key"))
    out = C.records_from_cells(cells, layout, named)
    assert [r.rec["name"] for r in out.orderBy("row_idx").collect()] == ["张三", "李四", "王五"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("try_element_at(vals") <= 2


def test_dates_of_mails_are_parsed_once():
    """a Date header that was seen is not parsed again."""
    M._sent.cache_clear()
    sent = [M._read_mail(b"Date: %s\r\n\r\nx" % d)["sent"] for d in (b"04 Nov 2025 10:00:00 +0000", b"04 Nov 2025 10:00:00 +0000", b"no date", b"")]
    assert sent[0] == sent[1] and str(sent[0]) == "2025-11-04 10:00:00" and sent[2:] == [None, None]
    assert M._sent.cache_info().hits == 1 and M._sent.cache_info().misses == 2
