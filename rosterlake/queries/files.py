"""Queries for routing, mail parts, decoders and derived files. Files are
composed from rows of the given tables, so their number grows with them."""
import pandas as pd
from pyspark.sql import functions as F

from ..common import checkpointed, scratch_path
from ..functions import text as T
from ..options import RouteOptions
from ..sources import derived as V
from ..sources import mail as M
from ..sources import route as Z
from ..sources import sinks as K
from ..sources import wordfile as D
from ..sources import workbook as W
from . import recipes as R
from .registry import query

_FILES = """
SELECT page_id, concat('/in/p', cast(page_id AS string), '/', CASE page_id % 10 WHEN 0 THEN 'a.XLSX' WHEN 1 THEN 'b.eml' WHEN 2 THEN 'c.tar.docx' WHEN 3 THEN 'd.png' WHEN 4 THEN 'e.html' WHEN 5 THEN 'f.bin' WHEN 6 THEN 'noext' WHEN 7 THEN '.hidden' WHEN 8 THEN 'g.xls' ELSE 'h.dat' END) AS file_path FROM {pages}"""
_TYPE = "CASE page_id % 10 WHEN 0 THEN 'excel' WHEN 1 THEN 'email' WHEN 2 THEN 'email' WHEN 3 THEN 'image' WHEN 4 THEN 'text' WHEN 8 THEN 'excel' ELSE 'other' END"
_EXT = "CASE page_id % 10 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.eml' WHEN 2 THEN '.docx' WHEN 3 THEN '.png' WHEN 4 THEN '.html' WHEN 5 THEN '.bin' WHEN 8 THEN '.xls' WHEN 9 THEN '.dat' ELSE '' END"


@query("route", f"SELECT page_id, sha256(file_path) AS source_id, regexp_extract(file_path, '[^/]*$') AS source_file, {_EXT} AS ext, {_TYPE} AS source_type FROM ({_FILES}) f")
def route(t):
    return Z.route(Z.with_source_ids(t.sql(_FILES))).select("page_id", "source_id", "source_file", "ext", "source_type")


@query("route_filters", f"SELECT page_id, CASE page_id % 10 WHEN 9 THEN 'text' ELSE {_TYPE} END AS source_type, page_id % 10 IN (0, 9) AS listed FROM {{pages}} WHERE page_id % 10 IN (0, 3, 4, 8, 9)")
def route_filters(t):
    files = Z.with_source_ids(t.sql(_FILES))
    broad = Z.route(files, RouteOptions(allowed_types=("excel", " Image", "text"), overrides={"DAT": "text"}, ignore_unknown=True))
    few = Z.route(files, RouteOptions(allowed_extensions=("xlsx", ".DAT"), overrides={".dat": "text"})).select("page_id", F.lit(True).alias("in_few"))
    return broad.join(few, "page_id", "left").select("page_id", "source_type", F.coalesce("in_few", F.lit(False)).alias("listed"))


@query("extensions", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.eml' WHEN 2 THEN '' WHEN 3 THEN '' ELSE '.tar.gz' END AS ext FROM {pages}")
def extensions(t):
    k = F.col("page_id") % 5
    raw = F.when(k == 0, F.lit(" XLSX ")).when(k == 1, F.lit(".Eml")).when(k == 2, F.lit(".")).when(k == 4, F.lit("tar.gz"))
    return t.pages.select("page_id", Z.normalize_extension(raw).alias("ext"))


@query("missing_paths", f"SELECT file_path, 'File not found' AS error FROM ({_FILES}) f WHERE page_id % 3 = 0")
def missing_paths(t):
    files = t.sql(_FILES)
    return Z.missing_paths(files.select("file_path"), files.filter("page_id % 3 <> 0"))


@query("text_and_other_sources", "SELECT page_id, 'text' AS kind, sha256(html) AS digest, length(html) AS n FROM {pages} WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'other', NULL, octet_length(encode(html)) FROM {pages} WHERE page_id % 2 = 1")
def text_and_other_sources(t):
    files = t.pages.select(
        F.col("page_id").alias("source_id"), F.lit("x").alias("source_file"), F.when(F.col("page_id") % 2 == 0, F.lit("text")).otherwise(F.lit("other")).alias("source_type"),
        F.octet_length("html").alias("length"), F.concat(F.lit(b"\xff").cast("binary"), F.encode("html", "UTF-8")).alias("content"),
    )
    texts = Z.text_sources(files).select(F.col("source_id").alias("page_id"), F.lit("text").alias("kind"), F.sha2("text", 256).alias("digest"), F.length("text").cast("bigint").alias("n"))
    others = Z.other_sources(files).select(F.col("source_id").alias("page_id"), F.lit("other").alias("kind"), F.lit(None).cast("string").alias("digest"), F.col("file_size").cast("bigint").alias("n"))
    return texts.unionByName(others)


@query("handlers", f"SELECT {_TYPE} AS source_type, CASE WHEN {_TYPE} = 'excel' THEN 'mine' ELSE 'default' END AS handler, count(*) AS n FROM {{pages}} WHERE {_TYPE} IN ('excel', 'text') GROUP BY 1, 2")
def handlers(t):
    mark = lambda name: lambda df: df.withColumn("handler", F.lit(name))
    table = Z.Handlers({"excel": mark("default"), "text": mark("default")}).register("excel", mark("mine"))
    return table.extract(Z.route(Z.with_source_ids(t.sql(_FILES)))).groupBy("source_type", "handler").agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------------- parts
_PARTS = """
SELECT concat('m', cast(floor(doc_id / 8) AS bigint)) AS source_id, cast(doc_id % 8 AS int) AS part_idx, doc_id,
  CASE doc_id % 7 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'image/png' WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'text/html' WHEN 5 THEN 'application/x-thing' ELSE 'image/x-webp' END AS content_type,
  CASE doc_id % 5 WHEN 0 THEN 'r/a.xlsx' WHEN 1 THEN NULL WHEN 2 THEN 'note' WHEN 3 THEN '..' ELSE 'b.TXT' END AS filename,
  CASE doc_id % 3 WHEN 0 THEN 'Attachment; x' WHEN 1 THEN '' ELSE 'inline' END AS disposition_header,
  CASE doc_id % 4 WHEN 0 THEN concat('CID', cast(doc_id AS string)) ELSE '' END AS content_id, text AS body FROM {documents}"""
_DESC = f"""
WITH p AS (SELECT *, sha256(body) AS sha, CASE doc_id % 3 WHEN 0 THEN 'attachment' WHEN 1 THEN '' ELSE 'inline' END AS disposition, CASE doc_id % 5 WHEN 0 THEN 'a.xlsx' WHEN 2 THEN 'note' WHEN 4 THEN 'b.TXT' ELSE '' END AS base,
  CASE doc_id % 5 WHEN 0 THEN '.xlsx' WHEN 4 THEN '.txt' ELSE CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '.png' WHEN 3 THEN '.pdf' WHEN 4 THEN '.html' WHEN 5 THEN '' ELSE '.webp' END END AS ext FROM ({_PARTS}) z),
d AS (SELECT *, CASE WHEN base = '' THEN concat(left(sha, 16), CASE WHEN ext = '' THEN '.bin' ELSE ext END) WHEN contains(base, '.') THEN base ELSE concat(base, ext) END AS name,
  doc_id % 7 IN (2, 6) AS is_image, body <> '' AND NOT (content_type IN ('text/plain', 'text/html') AND coalesce(filename, '') = '' AND disposition = '') AND (disposition <> '' OR coalesce(filename, '') <> '' OR NOT starts_with(content_type, 'text/')) AS exported FROM p),
e AS (SELECT *, first_value(part_idx) OVER (PARTITION BY source_id, sha ORDER BY part_idx) AS first_part_idx FROM d WHERE exported),
o AS (SELECT *, first_value(part_idx) OVER (PARTITION BY source_id, name ORDER BY part_idx) AS owner FROM e WHERE part_idx = first_part_idx),
n AS (SELECT source_id, sha, CASE WHEN owner = part_idx THEN name ELSE concat(regexp_replace(name, '[.][^.]*$', ''), '.', left(sha, 8), coalesce(regexp_extract(name, '[.][^.]+$'), '')) END AS export_name FROM o),
x AS (SELECT e.*, export_name FROM e JOIN n USING (source_id, sha))
"""


def _parts(t):
    return M.describe_parts(t.sql(_PARTS).withColumn("content", F.encode("body", "UTF-8")).drop("body"))


def _exports(t):
    """The parts put into the rows of their mails, as the decoder gives them, and exported."""
    given = t.sql(_PARTS).withColumn("content", F.encode("body", "UTF-8")).withColumn("depth", F.lit(0)).withColumn("parent_part_idx", F.lit(None).cast("int")).withColumn("encoding", F.lit(""))
    part = F.struct("part_idx", "parent_part_idx", "depth", "content_type", "filename", "disposition_header", "content_id", "encoding", "content")
    mails = given.groupBy("source_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    key = F.substring("source_id", 2, 20).cast("long") * 8 + F.col("part_idx")
    return M.exported_parts(mails, content=False).withColumn("doc_id", key)


@query("part_rules", _DESC + " SELECT doc_id, ext, name, disposition, is_image, exported FROM d")
def part_rules(t):
    return _parts(t).select("doc_id", "ext", "name", "disposition", "is_image", "exported")


@query("content_dedupe", _DESC + " SELECT doc_id, first_part_idx, part_idx <> first_part_idx AS is_duplicate, export_name FROM x")
def content_dedupe(t):
    return _exports(t).select("doc_id", "first_part_idx", "is_duplicate", "export_name")


@query("parts_summary", _DESC + """ SELECT source_id, n_parts, part_bytes, coalesce(n_attachments, 0) AS n_attachments, coalesce(attachment_bytes, 0) AS attachment_bytes
FROM (SELECT source_id, count(*) AS n_parts, sum(octet_length(encode(body))) AS part_bytes FROM p GROUP BY 1) a LEFT JOIN (SELECT source_id, count(*) AS n_attachments, sum(octet_length(encode(body))) AS attachment_bytes FROM x WHERE disposition = 'attachment' GROUP BY 1) b USING (source_id)""")
def parts_summary(t):
    p = _parts(t)
    a = M.attachment_summary(_exports(t)).select("source_id", "n_attachments", "attachment_bytes")
    return M.parts_summary(p).join(a, "source_id", "left").select("source_id", "n_parts", "part_bytes", F.coalesce("n_attachments", F.lit(0)).alias("n_attachments"), F.coalesce("attachment_bytes", F.lit(0)).alias("attachment_bytes"))


@query("cid_join", _DESC + """, refs AS (SELECT source_id, concat('cid', doc_id) AS cid FROM p WHERE doc_id % 2 = 0)
SELECT r.source_id, r.cid, x.export_name FROM refs r LEFT JOIN x ON x.source_id = r.source_id AND lower(x.content_id) = r.cid""")
def cid_join(t):
    html = t.sql(_PARTS).filter("doc_id % 2 = 0").groupBy("source_id").agg(
        F.concat_ws("", F.collect_list(F.concat(F.lit("<p><IMG alt='x' src=\"cid:"), F.concat(F.lit("cid"), F.col("doc_id").cast("string")), F.lit('"></p>')))).alias("html")
    )
    found, missing = M.inline_images(html.select("source_id", T.inline_image_ids("html").alias("image_ids")), _exports(t))
    return found.select("source_id", "cid", "export_name").unionByName(missing.select(F.col("scope").alias("source_id"), F.col("detail").alias("cid"), F.lit(None).cast("string").alias("export_name")))


@query("part_lineage", _DESC + " SELECT sha256(concat_ws('|', source_id, sha, first_part_idx)) AS source_id, export_name AS source_file, concat(source_id, '.eml') AS parent_file FROM x WHERE part_idx = first_part_idx")
def part_lineage(t):
    kids = _exports(t).filter("NOT is_duplicate").select(F.col("child_id").alias("source_id"), F.col("export_name").alias("source_file"), F.col("source_id").alias("parent_source_id"))
    roots = t.sql(_PARTS).select("source_id", F.concat("source_id", F.lit(".eml")).alias("source_file"), F.lit("").alias("parent_source_id")).distinct()
    return V.lineage(roots.unionByName(kids)).filter("parent_file IS NOT NULL").select("source_id", "source_file", "parent_file")


# ----------------------------------------------------------------- decoders
def _mail_files(t):
    """One mail per document: text body, a copied attachment, a nested mail."""
    b64 = lambda c: F.base64(F.encode(c, "UTF-8"))
    body = F.concat(
        F.lit("From: Ann <ann@x.cn>\r\nTo: b@y.cn, C <c@y.cn>\r\nDate: Mon, 04 Nov 2024 10:00:00 +0800\r\nSubject: =?UTF-8?B?"), b64(F.concat(F.lit("主题"), F.col("doc_id").cast("string"))),
        F.lit('?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="BB"\r\n\r\n--BB\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n'), b64("text"),
        F.lit('\r\n--BB\r\nContent-Type: text/csv; name="a.csv"\r\nContent-Disposition: attachment; filename="a.csv"\r\nContent-Transfer-Encoding: base64\r\n\r\n'), b64("source"),
        F.lit('\r\n--BB\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename="b.csv"\r\nContent-Transfer-Encoding: base64\r\n\r\n'), b64("source"),
        F.lit('\r\n--BB\r\nContent-Type: message/rfc822\r\n\r\nSubject: inner\r\nMIME-Version: 1.0\r\nContent-Type: text/csv; name="c.csv"\r\nContent-Disposition: attachment; filename="c.csv"\r\nContent-Transfer-Encoding: base64\r\n\r\n'), b64("lang"),
        F.lit("\r\n--BB--\r\n"),
    )
    # Decoding is the costly step, so the few input files are spread first.
    docs = t.documents.repartition(t.spark.sparkContext.defaultParallelism)
    return docs.select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("source_id"), F.encode(body, "UTF-8").alias("content"))


@query("mail_decode", "SELECT concat('m', doc_id) AS source_id, concat('主题', doc_id) AS subject, 'Ann' AS sender_name, 'ann@x.cn' AS sender_email, 2 AS n_recipients, '2024-11-04' AS sent, sha256(text) AS body_sha, length(text) AS text_length FROM {documents}")
def mail_decode(t):
    m = M.messages(M.decode_mail(_mail_files(t)))
    return m.select("source_id", "subject", "sender_name", "sender_email", F.size("recipients").alias("n_recipients"), F.date_format("mail_date", "yyyy-MM-dd").alias("sent"), F.sha2("text", 256).alias("body_sha"), "text_length")


@query("mail_parts", """
SELECT concat('m', doc_id) AS source_id, v.part_idx, v.parent_part_idx, v.depth, v.is_duplicate, v.export_name, CASE v.part_idx WHEN 5 THEN sha256(lang) ELSE sha256(source) END AS sha256
FROM {documents}, (VALUES (2, 0, 0, false, 'a.csv'), (3, 0, 0, true, 'a.csv'), (5, 4, 1, false, 'c.csv')) v(part_idx, parent_part_idx, depth, is_duplicate, export_name)""")
def mail_parts(t):
    e = M.exported_parts(M.decode_mail(_mail_files(t)), content=False)
    return e.select("source_id", "part_idx", "parent_part_idx", "depth", "is_duplicate", "export_name", "sha256")


@query("mail_blocks", "SELECT concat('m', doc_id) AS source_id, v.ord, v.type, CASE v.ord WHEN 1 THEN NULL ELSE sha256(CASE v.ord WHEN 2 THEN text ELSE trim(text, chr(32) || chr(10)) END) END AS digest FROM {documents}, (VALUES (1, 'email_headers'), (2, 'email_text'), (3, 'email_body_text')) v(ord, type) UNION ALL SELECT concat('m', doc_id), v.ord, 'eml_file_part', NULL FROM {documents}, (VALUES (102), (105)) v(ord)")
def mail_blocks(t):
    from ..operators import leave as L

    decoded = checkpointed(M.decode_mail(_mail_files(t)))
    # Quoted threads do not occur here, so the body is the whole text.
    b = K.blocks(L.body_text(M.messages(decoded)), M.exported_parts(decoded, content=False), empty=True)
    return b.select("source_id", "ord", "type", F.when(F.col("type").isin("email_text", "email_body_text"), F.sha2("content", 256)).alias("digest"))


def _zip_xml(files: dict) -> bytes:
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, xml in files.items():
            zf.writestr(name, xml)
    return buf.getvalue()


def _xlsx(rows, first: int) -> bytes:
    from xml.sax.saxutils import escape

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    strings, body = [], []
    for i, (key, name, serial, price) in enumerate(rows):
        r = i + first
        strings.append(name)
        body.append(f'<row r="{r}"><c r="A{r}"><v>{key}</v></c><c r="B{r}" t="s"><v>{i}</v></c><c r="C{r}" s="1"><v>{serial}</v></c><c r="D{r}"><f>A{r}*2</f><v>{price}</v></c><c r="F{r}" t="inlineStr"><is><t>in{key}</t></is></c></row>')
    return _zip_xml({
        "xl/workbook.xml": f'<workbook {ns} {rns}><sheets><sheet name="表1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {ns}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {ns}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>",
    })


def workbook_bytes(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook of named sheets, all cells inline texts (None: no cell)."""
    from xml.sax.saxutils import escape, quoteattr

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    parts = {
        "xl/workbook.xml": f"<workbook {ns} {rns}><sheets>" + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="t/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    for i, rows in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>"
    return _zip_xml(parts)


def _pack_books(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("o_orderkey")
    rows = list(zip(pdf["o_orderkey"], pdf["o_orderpriority"], pdf["serial"], pdf["o_totalprice"]))
    book = int(pdf["book"].iloc[0])
    return pd.DataFrame({"source_id": [f"b{book}"], "content": [_xlsx(rows, 0 if book % 2 else 1)]})


def _books(t):
    """One workbook per hundred orders; odd ones number their rows from zero."""
    x = t.orders.select(F.floor(F.col("o_orderkey") / 100).alias("book"), "o_orderkey", "o_orderpriority", "o_totalprice", F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")).alias("serial"))
    return x.groupBy("book").applyInPandas(_pack_books, "source_id string, content binary")


@query("xlsx_cells", """
WITH o AS (SELECT *, floor(o_orderkey / 100) AS book, row_number() OVER (PARTITION BY floor(o_orderkey / 100) ORDER BY o_orderkey) - 1 AS r FROM {orders})
SELECT concat('b', cast(book AS bigint)) AS source_id, cast(r AS int) AS row_idx, i AS col_idx, CASE i WHEN 0 THEN cast(o_orderkey AS string) WHEN 1 THEN o_orderpriority WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') WHEN 5 THEN concat('in', o_orderkey) END AS raw,
  CASE i WHEN 0 THEN 'number' WHEN 2 THEN 'timestamp' ELSE 'string' END AS raw_type FROM o, (VALUES (0), (1), (2), (5)) v(i)""")
def xlsx_cells(t):
    c = W.record_cells(W.decode_workbooks(_books(t)))
    return c.filter("col_idx <> 3").select("source_id", "row_idx", "col_idx", "raw", "raw_type")


@query("xlsx_formulas", "SELECT concat('b', cast(floor(o_orderkey / 100) AS bigint)) AS source_id, count(*) AS n_formulas, cast(floor(o_orderkey / 100) AS bigint) % 2 = 1 AS row_index_zero, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY 1, 3")
def xlsx_formulas(t):
    d = checkpointed(W.decode_workbooks(_books(t)))
    per = d.filter("formula IS NOT NULL").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_formulas"), F.round(F.sum(F.col("raw").cast("double")), 2).alias("total"))
    return per.join(W.row_zero_files(d), "source_id").select("source_id", "n_formulas", "row_index_zero", "total")


def _pack_docs(batches):
    from xml.sax.saxutils import escape

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda s: f"<w:p><w:r><w:t>{escape(s)}</w:t></w:r></w:p>"
    row = lambda cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    for pdf in batches:
        out = []
        for key, name, mail in zip(pdf["s_suppkey"], pdf["s_name"], pdf["mail"]):
            body = p(f" {name} ") + p("  ") + "<w:tbl>" + row(["姓名", "工号"]) + row([name, str(key), "extra"]) + row(["乙"]) + "</w:tbl>" + p("完")
            rels = '<Relationships><Relationship Id="r1" Target="media/image1.png"/></Relationships>'
            out.append((mail, _zip_xml({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels}) if key % 5 else b"broken"))
        yield pd.DataFrame(out, columns=["source_id", "content"])


def _docs(t):
    return t.supplier.select("s_suppkey", "s_name", F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("mail")).mapInPandas(_pack_docs, "source_id string, content binary")


@query("docx_blocks", """
SELECT concat('d', s_suppkey) AS source_id, v.part, v.ord, v.type, CASE v.k WHEN 1 THEN s_name WHEN 2 THEN '完' WHEN 3 THEN concat('[{"姓名":"', s_name, '","工号":"', s_suppkey, '","col_2":"extra"},{"姓名":"乙"}]') ELSE 'docx image detected' END AS content
FROM {supplier}, (VALUES (0, 0, 'text', 1), (0, 2, 'text', 2), (1, 0, 'table', 3), (2, 0, 'image_placeholder', 4)) v(part, ord, type, k) WHERE s_suppkey % 5 <> 0""")
def docx_blocks(t):
    return D.docx_blocks(D.decode_docx(_docs(t)))


@query("docx_counts", "SELECT concat('d', s_suppkey) AS source_id, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 2 END AS paragraphs, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS tables, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS images FROM {supplier}")
def docx_counts(t):
    return D.document_counts(D.decode_docx(_docs(t)))


@query("dead_letters", "SELECT concat('d', s_suppkey) AS source_id, 'BadZipFile' AS error_type FROM {supplier} WHERE s_suppkey % 5 = 0")
def dead_letters(t):
    return Z.split_errors(D.decode_docx(_docs(t)))[1].select("source_id", "error_type")


@query("derived_closure", """
WITH RECURSIVE n AS (SELECT part.p_partkey AS k, 0 AS depth FROM {part} WHERE p_partkey % 64 = 0 UNION SELECT p.p_partkey, n.depth + 1 FROM n JOIN {part} p ON p.p_partkey IN (2 * n.k + 1, 2 * n.k + 2))
SELECT concat('p', k) AS source_id, min(depth) AS depth FROM n GROUP BY 1""")
def derived_closure(t):
    ids = t.part.select("p_partkey").withColumn("source_id", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    roots = ids.filter("p_partkey % 64 = 0").select("source_id", F.lit("").alias("parent_source_id"), "p_partkey")

    def children(level):
        up = level.select(F.col("source_id").alias("parent_source_id"), F.explode(F.array(F.col("p_partkey") * 2 + 1, F.col("p_partkey") * 2 + 2)).alias("p_partkey"))
        return up.join(ids, "p_partkey").select("source_id", "parent_source_id", "p_partkey")

    return V.closure(roots, children).select("source_id", "depth")


def page_files(t) -> str:
    """The pages as files of the shared folder, a JSON line each."""
    root = scratch_path(t.spark, "pages")
    t.pages.select("page_id", "url", "html").repartition(8, "page_id").write.json(root)
    return root


def pages_in(files):
    """The pages read back out of scanned files' bytes."""
    lines = files.filter("ext = '.json'").select("source_type", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).filter("line <> ''")
    page = lines.select("source_type", F.from_json("line", "page_id bigint, url string, html string").alias("p"))
    return page.select("source_type", "p.page_id", "p.url", F.sha2(F.coalesce("p.html", F.lit("")), 256).alias("html_sha256"))


PAGES_BACK = "SELECT 'text' AS source_type, page_id, url, sha256(coalesce(html, '')) AS html_sha256 FROM {pages}"


@query("file_scan", PAGES_BACK)
def file_scan(t):
    return pages_in(Z.route(Z.scan_files(t.spark, [page_files(t)])))


@query("results_written", """
SELECT 'summary' AS part, o_orderstatus AS id, cast(count(*) AS bigint) AS n FROM {orders} GROUP BY 2 UNION ALL SELECT 'fills', cast(o_orderkey AS string), o_custkey FROM {orders}
UNION ALL SELECT 'sources', c_name, c_custkey FROM {customer}""")
def results_written(t):
    """The three result tables written as JSON lines and read back."""
    summary = t.orders.groupBy(F.col("o_orderstatus").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    fills = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("n"))
    sources = t.customer.select(F.col("c_name").alias("id"), F.col("c_custkey").alias("n"))
    root = K.write_results(scratch_path(t.spark, "results"), summary, fills, sources, "job", "20260101")
    part = lambda name: t.spark.read.schema("id string, n bigint").json(f"{root}/{name}").select(F.lit(name).alias("part"), "id", "n")
    return part("summary").unionByName(part("fills")).unionByName(part("sources"))
