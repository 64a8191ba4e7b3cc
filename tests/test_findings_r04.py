"""Small cases of the findings of round 4."""
import __spark_entry__ as entry
from tests.compare import compare, duck


def _against_sql(spark, folder, name, table, rows):
    """A query and its SQL over one small table."""
    duck("").execute(f"COPY (SELECT * FROM (VALUES {rows[1]}) v({rows[0]})) TO '{folder}/{table}.parquet'")
    return compare(spark, duck(str(folder)), str(folder), name, entry.queries()[name], entry.oracle_sql()[name])


def test_leave_merge_reply_with_a_rule_records_id(spark, tmp_path):
    """a reply's id may be one the mail itself names; the query's SQL keeps both."""
    orders = ", ".join(f"({k}::bigint, {c}::bigint, TIMESTAMP '1996-12-20')" for k, c in ((12, 10005), (42, 10000), (27, 10006), (30, 40002), (7, 10000)))
    state, n, _, note = _against_sql(spark, tmp_path, "leave_merge", "orders", ("o_orderkey, o_custkey, o_orderdate", orders))
    assert state == "ok" and n == 13, (n, note)


_TEXTS = "(1::bigint, '', 'en', 'src1'), (2::bigint, 'x', 'de', 'src2'), (3::bigint, ' ' || chr(10), 'en', 'src1'), (4::bigint, '', 'fr', 'src3')"


def test_mail_blocks_of_empty_texts(spark, tmp_path):
    """the query's SQL has a text block for every mail, also one of nothing or blanks."""
    state, n, _, note = _against_sql(spark, tmp_path, "mail_blocks", "documents", ("doc_id, text, lang, source", _TEXTS))
    assert state == "ok" and n == 20, (n, note)


def test_mail_decode_of_empty_texts(spark, tmp_path):
    """the text of an empty part is empty, not missing; the query's SQL hashes it."""
    for name, rows in (("mail_decode", 4), ("mail_parts", 12)):
        state, n, _, note = _against_sql(spark, tmp_path, name, "documents", ("doc_id, text, lang, source", _TEXTS))
        assert state == "ok" and n == rows, (n, note)


def test_mail_text_empty_or_missing():
    """only a mail without a text part has no text; the first part with bytes is the text."""
    from rosterlake.sources import mail as M

    part = lambda kind, body: f"--B\nContent-Type: text/{kind}\n\n{body}\n"
    many = lambda *ps: ("Content-Type: multipart/mixed; boundary=B\n\n" + "".join(ps) + "--B--\n").encode()
    cases = {
        b"Subject: s\n\n": ("", None), b"Subject: s\nContent-Type: text/html\n\n": (None, ""), b"Subject: s\n\nx": ("x", None),
        many(part("plain", ""), part("csv", "1")): ("", None), many(part("csv", "1")): (None, None), many(part("plain", ""), part("plain", "y"), part("html", "")): ("y", ""),
    }
    for content, want in cases.items():
        got = M._read_mail(content)
        assert (got["text"], got["html"]) == want, content
        assert (M._read_any(content)["text"], M._read_any(content)["html"]) == want, content
