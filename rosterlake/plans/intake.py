"""Whole jobs: files to records, records to form cells. Nothing is collected."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import SHEET, checkpointed, spread
from ..functions import text as T
from ..operators import facts as A
from ..operators import leave as L
from ..operators import naming as N
from ..operators import replies as Q
from ..operators import sheets as C
from ..options import FillOptions, RouteOptions, SheetOptions
from ..sources import mail as M
from ..sources import wordfile as D
from ..sources import workbook as W
from ..sources.route import missing_paths, route, text_sources
from . import fill as P
from . import forms as FO
from . import journal as J
from . import mapped as MP
from . import roster as RO


@dataclass
class Extracted:
    """Sources, records, and the job's log: warnings (scope, stage, code, detail, ord) and
    counters (what was read, kept and dropped, by reason)."""

    sources: DataFrame
    records: DataFrame
    warnings: DataFrame
    counters: DataFrame


class _Read(Extracted):
    """What was extracted, of whose records and log each is worked out when first asked for."""

    def __init__(self, sources: DataFrame, records: Callable[[], DataFrame], log: Callable[[], tuple[DataFrame, DataFrame]]):
        self.sources, self._records, self._log = sources, records, log

    @cached_property
    def records(self) -> DataFrame:
        return self._records()

    @cached_property
    def _told(self) -> tuple[DataFrame, DataFrame]:
        return self._log()

    @property
    def warnings(self) -> DataFrame:
        return self._told[0]

    @property
    def counters(self) -> DataFrame:
        return self._told[1]


@dataclass
class SheetsRead:
    """Records of sheets, and what they were read by (`kinds`: `row_kinds`, where written)."""

    records: DataFrame
    cells: DataFrame
    layout: DataFrame
    coverage: DataFrame
    chosen: DataFrame
    demo: DataFrame
    kinds: DataFrame | None = None


def read_sheets(cells: DataFrame, sources: DataFrame | None = None, opts: SheetOptions = SheetOptions(), mode: str = "auto", preferred: str | None = None, proposed: DataFrame | None = None, keep: bool = False) -> SheetsRead:
    """cells → records: choose sheets, find headers, name columns, read rows. A
    workbook whose chosen sheets give no record is read from all its sheets. With `keep`
    the records and what layout and ranks see of a row are written once, for a caller who
    also counts them."""
    cells = C.with_text(cells)
    kinds = checkpointed(C.row_kinds(cells)) if keep else None
    # Layout and column names are small next to the cells and used several
    # times: each is computed once and kept in the shared folder.
    layout = checkpointed(C.sheet_layout(cells, opts, kinds))
    named = checkpointed(N.name_columns(C.column_profiles(cells, layout, opts), proposed, opts).join(layout.select(*SHEET, "n_cols"), SHEET))
    coverage = named.groupBy(*SHEET).agg(F.max("coverage").alias("coverage"))
    every = C.records_from_cells(cells, layout, named, sources, opts, flag_demo=True)
    every = checkpointed(every) if keep else every
    recs, demo = every.filter("NOT is_demo").drop("is_demo"), every.filter("is_demo")
    whole = SheetsRead(recs, cells, layout, coverage, layout.select(*SHEET), demo, kinds)
    if mode == "all":
        return whole
    ranks = C.rank_sheets(cells, opts, kinds)
    return in_mode(whole, checkpointed(ranks) if keep else ranks, mode, preferred)


def in_mode(whole: SheetsRead, ranks: DataFrame, mode: str = "auto", preferred: str | None = None) -> SheetsRead:
    """What a mode takes of sheets read whole (`read_sheets` in mode "all"): several modes
    share the reading and the ranks (`rank_sheets`)."""
    chosen = C.choose_sheets(ranks, mode, preferred)
    picked = whole.records.join(chosen, SHEET, "left_semi")
    if mode != "single":
        rest = whole.records.join(picked.select("source_id").distinct(), "source_id", "left_anti")
        picked = picked.unionByName(rest)
    return replace(whole, records=picked, chosen=chosen)


def sheet_records(cells: DataFrame, sources: DataFrame | None = None, opts: SheetOptions = SheetOptions(), mode: str = "auto", preferred: str | None = None, proposed: DataFrame | None = None) -> DataFrame:
    """Records of `read_sheets`."""
    return read_sheets(cells, sources, opts, mode, preferred, proposed).records


def leave_as_records(leave: DataFrame, sources: DataFrame) -> DataFrame:
    """Leave records in the common record shape."""
    names = ("name", "employee_id", "leave_date_text", "leave_date", "intent")
    rec = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.coalesce(F.col(n), F.lit("")) for n in names]))
    return leave.join(sources.select("source_id", "source_file", "source_type", "parent_source_id"), "source_id").select(
        "source_id", "source_file", "source_type", "parent_source_id", F.lit(None).cast("string").alias("sheet_name"), F.lit(0).alias("sheet_idx"),
        (F.coalesce("line_idx", F.lit(0)).cast("long") * (1 << 31) + F.coalesce("pair_idx", F.lit(0))).alias("row_idx"), rec.alias("rec"), F.lit("leave_lines").alias("extraction_type"),
    )


SOURCE = ["source_id", "source_file", "source_type", "ext", "parent_source_id"]


def with_attachments(top: DataFrame, routes: RouteOptions = RouteOptions()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all sources, all files with their bytes, all decoded mails): the given files and,
    level by level, what is attached to mails, mails among it included. The given files are
    written once, dealt out by number, each level of mails once with its parts; attached files
    are read out of those. The loop ends at the first level without a mail."""
    level = files = checkpointed(spread(top.select(*SOURCE, "content"), "source_id"))
    sources, mails = files.select(*SOURCE), None
    while True:
        decoded = checkpointed(M.with_exports(M.decode_mail(level.filter("ext = '.eml'"))))
        mails = decoded if mails is None else mails.unionByName(decoded)

        def attached(*more: str) -> DataFrame:
            parts = M.exported_parts(decoded, content=bool(more)).filter("NOT is_duplicate")
            kids = parts.select(F.col("child_id").alias("source_id"), F.col("export_name").alias("source_file"), F.col("source_id").alias("parent_source_id"), *more)
            return route(kids, routes).select(*SOURCE, *more)

        level, known = attached("content"), attached()
        files, sources = files.unionByName(level), sources.unionByName(known)
        if known.filter("ext = '.eml'").isEmpty():
            return sources, files, mails


def loose_bodies(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_id, body of text files and documents read like mails; items of the
    documents). A document's body is its paragraphs in order, then the cells of tables
    of one row, which have no header (`document_records` reads the other tables)."""
    texts = text_sources(files.filter("source_type = 'email' AND ext NOT IN ('.eml', '.docx')")).select("source_id", F.col("text").alias("body"))
    items = checkpointed(D.decode_docx(files.filter("ext = '.docx'")))
    cells = items.filter("error IS NULL AND kind = 'cell'")
    boxes = cells.groupBy("source_id", "ord").agg(F.max("row_idx").alias("last")).filter("last = 0").drop("last")
    place = ("kind_idx", "ord", "col_idx", "content")
    texts_and_boxes = items.filter("error IS NULL AND kind = 'text'").withColumn("kind_idx", F.lit(0)).select("source_id", *place).unionByName(
        cells.join(boxes, ["source_id", "ord"]).withColumn("kind_idx", F.lit(1)).select("source_id", *place)
    )
    lines = texts_and_boxes.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct(*place))).alias("ls"))
    docs = lines.select("source_id", F.array_join(F.transform("ls", lambda x: x["content"]), "\n").alias("body"))
    return texts.unionByName(docs), items


#: Extensions a reader takes; files of others are told as unread.
READ_BY = [".eml", ".xlsx", ".docx", ".txt"]


def document_records(items: DataFrame, sources: DataFrame, opts: SheetOptions = SheetOptions(), proposed: DataFrame | None = None) -> DataFrame:
    """Records of the tables of documents: each table is read like a sheet; one whose
    columns can't be named keeps its first row's texts as keys."""
    tables = items.filter("error IS NULL AND kind = 'cell'").select(
        "source_id", F.col("ord").alias("sheet_idx"), F.lit("").alias("sheet_name"), "row_idx", "col_idx", F.col("content").alias("raw"), F.lit("string").alias("raw_type")
    )
    named = checkpointed(sheet_records(tables, sources, opts, "all", proposed=proposed))
    rest = D.table_records(items).withColumnRenamed("table_idx", "sheet_idx").join(named.select(*SHEET).distinct(), SHEET, "left_anti")
    rest = rest.join(sources.select("source_id", "source_file", "source_type", "parent_source_id"), "source_id")
    rest = rest.withColumn("rec", F.map_concat(F.map_filter("rec", lambda k, v: k != "__source_file__"), F.create_map(F.lit("__source_file__"), F.col("source_file"))))
    return named.unionByName(rest.withColumn("sheet_name", F.lit("")), allowMissingColumns=True).withColumn("extraction_type", F.lit("table"))


def run_extract(files: DataFrame, body_replies: DataFrame | None = None, leave_replies: DataFrame | None = None, routes: RouteOptions = RouteOptions(), opts: SheetOptions = SheetOptions(), proposed: DataFrame | None = None, paths: DataFrame | None = None) -> Extracted:
    """files(source_id, source_file, file_path, content) → sources, records and the
    job's log. Attachments of any depth are read like top-level files: workbooks
    for sheet records, mails, text files and documents for leave notices.
    `proposed` holds column names for sheets, as `name_columns` takes them; `paths`
    (file_path) what was asked for: paths without a file are told in the log."""
    top = route(files, routes).withColumn("parent_source_id", F.lit("").cast("string"))
    sources, found, decoded = with_attachments(top, routes)
    # The cells are read many times: their text is written with them.
    raw = checkpointed(W.decode_workbooks(found.filter("ext = '.xlsx'").select(*SOURCE, "content")).withColumn("text", T.cell_text("raw", "raw_type")))
    read = read_sheets(W.record_cells(raw), sources, opts, proposed=proposed, keep=True)
    loose, items = loose_bodies(found)
    # Bodies and notices are read by records, log and counters: written once, with the
    # columns that these look at.
    bodies = L.body_text(M.messages(decoded), opts.limits.body_chars).unionByName(loose, allowMissingColumns=True)
    bodies = checkpointed(bodies.select("source_id", "mail_date", "body"))
    notices = checkpointed(L.leave_records(bodies, leave_replies))
    asked = None
    if body_replies is not None:
        asked = checkpointed(Q.body_records(bodies.join(sources.select("source_id", "source_file"), "source_id"), body_replies))

    def records() -> DataFrame:
        tables = document_records(items, sources, opts, proposed)
        out = read.records.withColumn("extraction_type", F.lit("sheet")).unionByName(tables, allowMissingColumns=True)
        out = out.unionByName(leave_as_records(notices, sources), allowMissingColumns=True)
        if asked is not None:
            more = Q.explode_records(asked).join(sources.select("source_id", "source_type", "parent_source_id"), "source_id").select(
                "source_id", "source_file", "source_type", "parent_source_id", F.lit(None).cast("string").alias("sheet_name"), F.lit(-1).alias("sheet_idx"),
                F.col("row_idx").cast("int").alias("row_idx"), "rec", F.lit("body").alias("extraction_type"),
            )
            out = out.unionByName(more, allowMissingColumns=True)
        return A.with_lineage(out)

    def log() -> tuple[DataFrame, DataFrame]:
        failed = [x.filter("error IS NOT NULL").select("source_id", F.col("error")["type"].alias("code"), F.col("error")["message"].alias("detail")) for x in (decoded, raw, items)]
        missing = None if paths is None else missing_paths(paths.select("file_path"), files.select("file_path"))
        logs = [
            J.source_log(sources, READ_BY, reduce(DataFrame.unionByName, failed), missing),
            J.sheet_log(checkpointed(J.sheet_facts(read, opts)), opts), J.body_log(bodies, notices, asked),
        ]
        warnings, counters = (reduce(DataFrame.unionByName, part) for part in zip(*logs))
        return warnings, counters

    return _Read(sources, records, log)


def run_fill(records: DataFrame, form_cells: DataFrame, forms: DataFrame, registry: DataFrame, tables: DataFrame | None = None, opts: FillOptions = FillOptions(), mappings: DataFrame | None = None) -> DataFrame:
    """records and forms → typed cell writes for every form in one plan: routed
    strategies first, the synonym fallback for forms left empty. Forms that no other
    strategy takes, or whose strategy is `mapped`, are filled from `mappings` (as
    `mapped.read_mappings` gives them) where they have one."""
    # Strategies and fallback read the records time and again: written once.
    records, columns = checkpointed(records), checkpointed(FO.parse_forms(form_cells, tables))
    routed, strategies = RO.route_forms(forms, columns, registry), {}
    if mappings is not None:
        known = mappings.select("template_id").distinct().withColumn("_mapped", F.lit(True))
        routed = routed.join(known, "template_id", "left").withColumn("strategy", F.when(F.col("_mapped") & (F.col("strategy") == "none"), F.lit("mapped")).otherwise(F.col("strategy"))).drop("_mapped")
        strategies["mapped"] = MP.mapped_strategy(mappings, opts)
    planned = checkpointed(RO.plan_fill(records, columns, routed, strategies, written=True))
    backup = P.fallback_cells(records, columns, planned, opts.fallback_one_source).withColumn("strategy", F.lit("fallback"))
    writes = planned.unionByName(backup)
    if opts.allowed_columns:
        writes = writes.filter(F.upper("col_letter").isin(*[c.upper() for c in opts.allowed_columns]))
    formats = form_cells.select("template_id", "sheet", "row", "col", "number_format")
    return P.typed_writes(writes, FO.formula_cells(form_cells), formats)
