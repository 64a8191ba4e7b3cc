"""Small cases of the findings of round 3."""
import datetime

from pyspark.sql import functions as F

from rosterlake.operators import leave as L


def _leave_inputs(spark):
    day = datetime.date(2025, 11, 4)
    body = "张三（10001）离职日期 2025-11-12\n李四（10002）解除合同 2025/11/13"
    mails = spark.createDataFrame([(s, day, body) for s in "abcd"], "source_id string, mail_date date, body string")
    rows = [("a", "钱七", " 10001 ", "", "2025-11-15"), ("a", "Bob", "10002", "", ""), ("b", "Bob", "5", "", ""), ("c", "钱七", "", "", ""), ("none", "钱七", "10009", "", "")]
    reply = spark.createDataFrame(rows, "source_id string, name string, employee_id string, leave_date_text string, leave_date string")
    return mails, reply


def test_leave_merge_reads_lines_once(spark):
    """what replies and records need of a mail is looked at once, and met in two joins."""
    mails, reply = _leave_inputs(spark)
    out = L.leave_records(mails, reply)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 4 and "离岗" not in plan
    got = {(r.source_id, r.name, r.employee_id, r.extraction_source) for r in out.collect()}
    rule = lambda s, label: {(s, "张三", "10001", label), (s, "李四", "10002", label)}
    assert got == (
        {("a", "钱七", " 10001 ", "llm_validated"), ("a", "李四", "10002", "llm_validated"), ("c", "钱七", "", "llm_validated")}
        | rule("b", "regex_fallback_llm_invalid") | rule("c", "llm_validated") | rule("d", "regex_fallback_llm_empty")
    )


def test_leave_merge_as_its_steps(spark):
    """the same records as checking the replies and merging them one after the other."""
    mails, reply = _leave_inputs(spark)
    noticed = L.leave_lines(mails)
    rule = L.rule_records(noticed).select("source_id", "mail_date", "name", "employee_id", "leave_date_text", "line_idx", "pair_idx")
    asked = reply.join(noticed.select("source_id", "mail_date"), "source_id")
    want = L.merge_leave(L.validated_reply(asked, rule).drop("origin"), rule)
    cols = ["source_id", "mail_date", "name", "employee_id", "leave_date_text", "leave_date", "line_idx", "pair_idx"]
    both = [sorted(map(str, d.select(*cols).collect())) for d in (want, L.labelled_merge(asked, rule))]
    assert both[0] == both[1]


def test_closed_references_only(spark):
    """with `open_ended` off a reference without its semicolon is text, as in the query's SQL."""
    from rosterlake.functions import text as T

    df = spark.createDataFrame([("<title>a&&amp</title><p>x &amp; &copy y &#65; &#66 &amp;lt;</p>",)], "h string")
    row = df.select(T.html_to_text("h", open_ended=False).alias("closed"), T.html_to_text("h").alias("all")).first()
    assert row.closed == "a&&amp x & &copy y A &#66 &lt;"
    assert row.all == "a&& x & © y A B &lt;"


def test_body_text_closed_references(spark):
    """a body made of html follows the same option."""
    df = spark.createDataFrame([("a", "", "<p>x&amp</p>"), ("b", "y&amp", "")], "source_id string, text string, html string")
    closed = {r.source_id: r.body for r in L.body_text(df, 200, open_ended=False).collect()}
    assert closed == {"a": "x&amp", "b": "y&amp"}


def test_mail_decoder_hands_on_in_pieces():
    """what the decoder holds does not grow with its batch."""
    import pandas as pd

    from rosterlake.sources import mail as M

    one = b"Subject: s\r\nContent-Type: text/plain\r\n\r\n" + b"x" * (M.HELD_BYTES // 2)
    batch = pd.DataFrame({"source_id": list("abcde"), "content": [one, one, b"", one, one]})
    frames = list(M._decode([batch]))
    assert [list(f["source_id"]) for f in frames] == [["a", "b"], ["c", "d", "e"]]
    assert list(M._decode([batch.head(0)])) == []


def test_candidates_are_one_lookup(spark):
    """Many candidate keys cost one lookup in the plan, and
    give what looking up each of them gives."""
    from rosterlake import rules as R
    from rosterlake.functions import text as T
    from rosterlake.operators import resolve as S

    recs = [{"Start_Date": "2025", "name": " "}, {"start date": "x", "START_DATE": "y"}, {"a": "1", "A": " ", "a ": "2"}, {}, {"入职/日期": "z", "A": None}]
    df = T.with_lookup(spark.createDataFrame([(i, r) for i, r in enumerate(recs)], "n int, rec map<string,string>"))
    keys = ["name", "start_date", "a", "A", "a_", "入职日期", "none"]
    for folded, get in ((True, T.get_folded), (False, T.get_ci)):
        each = F.array(*[F.struct(F.lit(i).alias("i"), get(k).alias("v")) for i, k in enumerate(keys)])
        both = df.select(F.filter(each, lambda x: x["v"].isNotNull()).alias("a"), T.found_values(keys, folded).alias("b"))
        assert all(r.a == (r.b or []) for r in both.collect())
        few, many = (T.found_values(k, folded) for k in (keys, keys * 5))
        size = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("element_at")
        assert size(df.select(few)) == size(df.select(many))
    recs = spark.createDataFrame([("s", 0, 0, {"start_date": "2025-01-01"})], "source_id string, sheet_idx int, row_idx int, rec map<string,string>")
    assert size(S.choose_date_key(recs, "remove")) < 2 * len(R.DATE_CANDIDATES["remove"])


def test_small_workbooks_share_a_frame():
    """A frame is made of many small workbooks, errors among them."""
    import pandas as pd

    from rosterlake.queries.files import workbook_bytes
    from rosterlake.sources import workbook as W

    book = workbook_bytes({"s": [["a", None, "b"]]})
    frames = list(W._decode([pd.DataFrame({"source_id": ["x", "bad", "y"], "content": [book, b"no", book]})]))
    assert len(frames) == 1
    out = frames[0]
    assert list(out["source_id"]) == ["x", "x", "bad", "y", "y"] and out["error"][2]["type"] == "BadZipFile"
    assert list(out["raw"].dropna()) == ["a", "b"] * 2 and list(out["col_idx"].dropna()) == [0, 2] * 2
    assert [W._column(r) for r in ("A1", "AB12", "Z")] == [0, 27, 25]
    assert W._stamp("45000") == W._stamp("45000.0000001") == "2023-03-15 00:00:00"
