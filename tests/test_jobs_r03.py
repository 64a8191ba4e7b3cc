"""Small cases of the findings of round 3 on whole jobs."""
import datetime

from pyspark.sql import functions as F

from rosterlake.common import spread
from rosterlake.functions import dates as D
from rosterlake.operators import leave as L
from rosterlake.plans import journal as J
from rosterlake.sources import mail as M


def test_plain_mails_skip_the_parser(monkeypatch):
    """a mail of one plain part gives what the general parser gives, without it."""
    heads = [b"Subject: =?utf-8?b?5Lit?= \r\nsubject: two", b"From:\tx\nDate: 04 Nov 2025 10:00:00 +0000", b"Content-Type: text/html; charset=gbk\r\nContent-ID: <a>", b"Content-Transfer-Encoding: 8bit\r\nDate: x"]
    bodies = [(b"", b"a\x00\xe4\r\nb"), (b"", b""), (b"\r\nContent-Transfer-Encoding: base64", b"5Lit\r\n5paH\r\n")]
    plain = [h + more + b"\r\n\r\n" + body for h in heads[:3] for more, body in bodies] + [heads[3] + b"\n\nx"]
    odd = [b"Subject: a\r\n b\r\n\r\nx", b"no header\r\n\r\nx", b"Content-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\n\r\nx\r\n--q--", b"Content-Transfer-Encoding: base64\r\n\r\n5Li", b"Content-Disposition: attachment; filename=a.txt\r\n\r\nx", b"Subject: x"]
    assert all(M._read_plain(c) == M._read_any(c) for c in plain) and not any(M._read_plain(c) for c in odd)
    want = [M._read_any(c) for c in odd]
    assert [M._read_mail(c) for c in odd] == want
    monkeypatch.setattr(M, "_read_any", None)
    assert len([M._read_mail(c) for c in plain]) == 10


def test_files_are_dealt_out_evenly(spark):
    """thousands of small files beside a few large ones come in parts of like number."""
    small = spark.range(4000).select(F.col("id").cast("string").alias("source_id"), F.lit(b"x").alias("content"))
    large = spark.range(4).select(F.concat(F.lit("b"), F.col("id")).alias("source_id"), F.lit(b"x" * 100000).alias("content"))
    sizes = [r["count"] for r in spread(small.coalesce(1).unionByName(large.coalesce(1)), "source_id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * min(sizes)


def test_dates_of_notices_cost_no_failed_cast(spark):
    """dates are as before, texts without one are kept from the cast to a number, and
    the rules stand once in the plan."""
    day = datetime.date(2025, 12, 4)
    texts = ["离职 2025年02月30日 2025/1/5", "1月05日", "11月31日", "2025-1-2", "20250103", "", None, "13月1日"]
    df = spark.createDataFrame([(i, x, day) for i, x in enumerate(texts)], "i int, x string, d date")
    out = df.select("i", L.leave_date_of("x", "d").alias("f"), L.normalized_leave_date("x", "d").alias("n"), F.explode(F.array("i")).alias("e"))
    got = {r.i: (r.f.date_text, r.f.leave_date and str(r.f.leave_date), r.n) for r in out.collect()}
    assert got == {
        0: ("2025/1/5", "2025-01-05", "2025-01-05"), 1: ("1月5日", "2026-01-05", "2026-01-05"), 2: ("", None, ""), 3: ("2025-1-2", "2025-01-02", "2025-01-02"),
        4: ("", None, "2025-01-03"), 5: ("", None, ""), 6: ("", None, ""), 7: ("", None, ""),
    }
    plan = df.select(L.normalized_leave_date("x", "d").alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(D.ISO_ANY) <= 2 and df.select(D.whole(F.lit("")).alias("w")).first().w is None


def test_counters_of_one_row_a_source_are_not_grouped(spark):
    """files and bodies have a row a source, so their counters need no grouping."""
    sources = spark.createDataFrame([("a", ".eml", "a.eml"), ("b", ".bin", "b.bin"), ("c", ".xlsx", "c.xlsx")], "source_id string, ext string, source_file string")
    errors = spark.createDataFrame([("c", "Bad", "x"), ("c", "Awful", "y")], "source_id string, code string, detail string")
    _, counters = J.source_log(sources, [".eml", ".xlsx"], errors)
    assert {(r.source_id, r.unit, r.n_read, r.n_kept, tuple(r.dropped.items())) for r in counters.collect()} == {
        ("a", "files", 1, 1, ()), ("b", "files", 1, 0, (("no_reader", 1),)), ("c", "files", 1, 0, (("Awful", 1),)),
    }
    assert counters._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") <= 1
