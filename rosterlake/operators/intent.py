"""Addition or removal: intents of records, files and forms, and the filters
that use them.

records(source_id, source_file, source_type, parent_source_id, sheet_name,
sheet_idx, row_idx, rec MAP<STRING,STRING>).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import attach, first_k
from ..functions import text as T
from ..options import IntentWords

WORDS = IntentWords()


def _pick(add: Column, remove: Column, in_service: Column | None = None) -> Column:
    out = F.when(add & ~remove, F.lit("add")).when(remove & ~add, F.lit("remove"))
    if in_service is not None:
        out = out.when(in_service & ~add & ~remove, F.lit("in_service"))
    return out


def text_intent(c, words: IntentWords = WORDS, in_service: bool = True) -> Column:
    """Intent of any text (file name, header line) by its words."""
    t = T.fold_text(F.coalesce(T.col(c), F.lit("")))
    return _pick(
        T.contains_any(t, words.add), T.contains_any(t, words.remove),
        T.contains_any(t, words.in_service) if in_service else None,
    )


def form_file_intent(filename) -> Column:
    """Intent of a form by 增员 / 减员 in its file name."""
    t = T.match_text(filename)
    return _pick(F.contains(t, F.lit("增员")), F.contains(t, F.lit("减员")))


def profile_file_intent(filename) -> Column:
    """Intent by file name with the wider word list of the roster profile."""
    t = T.fold_profile(filename)
    return _pick(
        T.contains_any(t, ["增员", "增加", "入职", "新增", "add"]),
        T.contains_any(t, ["减员", "减少", "离职", "删除", "remove", "停保"]),
    )


# ------------------------------------------------------------ record intent
def explicit_intent(rec, words: IntentWords = WORDS) -> Column:
    """From a declare-type-like field; the first field that decides wins."""
    names = [w.lower().replace(" ", "").replace("_", "").replace("-", "") for w in words.declare_headers]
    fields = F.filter(F.map_entries(T.col(rec)), lambda e: T.contains_any(T.fold_text(e["key"]), names))
    decided = F.filter(F.transform(fields, lambda e: text_intent(e["value"], words)), lambda v: v.isNotNull())
    return F.try_element_at(decided, F.lit(1))


def scanned_intent(rec, words: IntentWords = WORDS) -> Column:
    """From words anywhere in the keys and values."""
    parts = F.concat(F.map_keys(T.col(rec)), F.filter(F.map_values(T.col(rec)), lambda v: v.isNotNull()))

    def decide(folded):
        has = lambda ws: F.exists(folded, lambda t: T.contains_any(t, ws))
        return _pick(has(words.add), has(words.remove), has(words.in_service))

    return T.let(F.transform(parts, T.fold_text), decide)


def key_intent(rec, words: IntentWords = WORDS) -> Column:
    """From normalised key names such as terminationdate or startdate."""

    def decide(keys):
        starts = lambda ws: F.exists(keys, lambda k: _starts(k, ws))
        return F.when(starts(words.remove_key_starts), F.lit("remove")).when(starts(words.add_key_starts), F.lit("add"))

    return T.let(F.transform(F.map_keys(T.col(rec)), T.fold_text), decide)


def _starts(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.startswith(c, F.lit(w))
    return out


def sheet_intent(sheet_name) -> Column:
    s = F.coalesce(T.col(sheet_name), F.lit(""))
    return F.when(T.contains_any(s, ["减员", "离职"]), F.lit("remove")).when(F.contains(s, F.lit("增员")), F.lit("add"))


def record_type(rec, words: IntentWords = WORDS) -> Column:
    ex = explicit_intent(rec, words)
    return F.coalesce(F.when(ex.isin("add", "remove"), ex), key_intent(rec, words))


def combined_type(rec, sheet_name, words: IntentWords = WORDS) -> Column:
    return F.coalesce(record_type(rec, words), sheet_intent(sheet_name))


def with_intents(records: DataFrame, words: IntentWords = WORDS) -> DataFrame:
    """All intent signals of each record, each computed once."""
    out = records.select(
        *records.columns, explicit_intent("rec", words).alias("explicit_intent"),
        key_intent("rec", words).alias("key_intent"), scanned_intent("rec", words).alias("scanned_intent"),
        text_intent("source_file", words).alias("file_intent"), sheet_intent("sheet_name").alias("sheet_intent"),
    )
    typed = F.when(F.col("explicit_intent").isin("add", "remove"), F.col("explicit_intent"))
    return out.withColumn("record_type", F.coalesce(typed, "key_intent", "sheet_intent"))


# ------------------------------------------------------------------ filters
def sheet_action(intent, sheet_name) -> Column:
    """kept / blocked / neutral for a record's sheet under a form's intent. A
    missing sheet name is neutral; removal keeps only removal sheets."""
    s = T.fold_profile(sheet_name)
    add, remove = T.contains_any(s, ["增员", "新增", "入职"]), T.contains_any(s, ["减员", "离职"])
    stop = T.contains_any(s, ["减员", "离职", "停保"])
    for_remove = F.when(s == "", F.lit("neutral")).when(add | ~remove, F.lit("blocked")).otherwise(F.lit("kept"))
    for_add = F.when(s == "", F.lit("neutral")).when(stop, F.lit("blocked")).when(add, F.lit("kept")).otherwise(F.lit("neutral"))
    return F.when(T.col(intent) == "remove", for_remove).when(T.col(intent) == "add", for_add).otherwise(F.lit("neutral"))


def sheet_action_counts(records: DataFrame, intent: str) -> DataFrame:
    return records.withColumn("action", sheet_action(F.lit(intent), "sheet_name")).groupBy("sheet_name", "action").count()


def filter_by_sheet(records: DataFrame, intent: str) -> DataFrame:
    """Only records of sheets named for the intent (nameless ones kept)."""
    words = {"add": ["增员"], "remove": ["减员", "离职"]}.get(intent)
    if words is None:
        return records
    blank = T.is_empty("sheet_name")
    return records.filter(blank | T.contains_any("sheet_name", words))


def ignored_sheet_warning(records: DataFrame, intent: str = "remove") -> DataFrame:
    """Warning rows for sheets the removal filter leaves out."""
    gone = records.filter(sheet_action(F.lit(intent), "sheet_name") == "blocked")
    return gone.groupBy("source_id", "sheet_name").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("source_id").alias("scope"), F.lit("remove_intent_ignore_non_leave_sheets").alias("code"),
        F.concat_ws(":", "sheet_name", F.col("n").cast("string")).alias("detail"),
    )


def filter_by_type(records: DataFrame, intent: str, words: IntentWords = WORDS) -> DataFrame:
    """Records of the wanted type, unless no record has it: then all stay.

    The test over all records is a scalar subquery, so nothing is joined."""
    typed = records.withColumn("_t", combined_type("rec", "sheet_name", words))
    wanted = F.coalesce(F.col("_t") == intent, F.lit(False))
    found = typed.agg(F.coalesce(F.max(wanted), F.lit(False))).scalar()
    return typed.filter(wanted | ~found).drop("_t")


def _passes(intent: str, signal: Column, strict: bool) -> Column:
    file_ok = F.coalesce((F.col("file_intent") == intent), F.lit(True))
    explicit_ok = F.coalesce((F.col("explicit_intent") == intent), F.lit(True))
    known = F.coalesce(F.col("file_intent") == intent, F.lit(False)) | F.coalesce(F.col("explicit_intent") == intent, F.lit(False))
    scan = F.when(F.col("scanned_intent").isNull(), known | ~signal).otherwise(F.col("scanned_intent") == intent)
    rest = file_ok & explicit_ok & (scan if strict else F.lit(True))
    return F.when(F.col("record_type").isNotNull(), F.col("record_type") == intent).otherwise(rest)


def filter_by_intent(records: DataFrame, intent: str, scope: list[str] | None = None, words: IntentWords = WORDS) -> DataFrame:
    """Records that fit a form's intent. Where the strict test leaves a scope
    (each source by default) empty, the relaxed test decides; with scope [] the
    whole set falls back to all its records."""
    return known_by_intent(with_intents(records, words), intent, scope).select(*records.columns)


def known_by_intent(known: DataFrame, intent: str, scope: list[str] | None = None) -> DataFrame:
    """`filter_by_intent` of records that have their signals (`with_intents`): a caller who
    asks for several intents writes those once."""
    scope = ["source_id"] if scope is None else scope
    has = lambda c: F.coalesce(F.col(c) == intent, F.lit(False))
    signal = known.agg(F.coalesce(F.max(has("file_intent") | has("explicit_intent") | has("scanned_intent")), F.lit(False))).scalar()
    flagged = known.withColumn("_strict", _passes(intent, signal, True))
    if scope:
        flagged = flagged.withColumn("_relaxed", _passes(intent, signal, False))
        flagged = attach(flagged, scope, F.max("_strict").alias("_any"))
        kept = flagged.filter(F.when(F.col("_any"), F.col("_strict")).otherwise(F.col("_relaxed")))
    else:
        found = flagged.agg(F.coalesce(F.max("_strict"), F.lit(False))).scalar()
        kept = flagged.filter(F.col("_strict") | ~found)
    return kept.select(*known.columns)


def own_intent_allows(rec, intent) -> Column:
    """A record that states its intent must state the wanted one."""
    own = F.coalesce(F.try_element_at(T.col(rec), F.lit("intent")), F.lit(""))
    return own.isin(F.lit(""), T.col(intent)) | ~T.col(intent).isin("add", "remove")


def filter_by_field(records: DataFrame, field: str, values: list[str], exclude: bool = False) -> DataFrame:
    """Field value in (or not in) a list; a missing field matches only when
    excluding."""
    v = F.lower(T.utrim(F.try_element_at(F.col("rec"), F.lit(field))))
    hit = v.isin(*[str(x).lower().strip() for x in values])
    return records.filter(F.coalesce(~hit if exclude else hit, F.lit(exclude)))


def filter_conflicts(values: list[str], exclude, intent, words: IntentWords = WORDS) -> Column:
    """A record filter that works against the form's intent."""
    t = T.fold_text(F.lit(" ".join(str(v) for v in values))) if isinstance(values, (list, tuple)) else T.fold_text(F.array_join(values, " "))
    a, r = T.contains_any(t, words.add), T.contains_any(t, words.remove)
    exclude, intent = T.col(exclude) if not isinstance(exclude, bool) else F.lit(exclude), T.col(intent)
    return (
        F.when(intent == "add", (~exclude & r & ~a) | (exclude & a & ~r))
        .when(intent == "remove", (~exclude & a & ~r) | (exclude & r & ~a))
        .otherwise(F.lit(False))
    )


def gate_records(records: DataFrame, keys, ratio: float = 0.4, top: int | None = None, scope: list[str] | None = None) -> DataFrame:
    """Records filling enough of the matched keys; a scope where none does keeps
    all of its own, or its best `top`. `keys` is a list, or an array column of the records."""
    return gate_scored(records.withColumn("filled_ratio", filled_share(keys)), ratio, top, scope)


def filled_share(keys) -> Column:
    """Share of the keys (a list, or an array column) that a record fills; 1 without keys."""
    keys = F.array(*[F.lit(k) for k in keys]) if isinstance(keys, (list, tuple)) else T.col(keys)
    filled = F.size(F.filter(keys, lambda k: T.is_non_empty(F.try_element_at(F.col("rec"), k))))
    return F.when(F.size(keys) == 0, F.lit(1.0)).otherwise(filled / F.size(keys))


def gate_scored(records: DataFrame, ratio: float = 0.4, top: int | None = None, scope: list[str] | None = None) -> DataFrame:
    """`gate_records` of records that have their filled_ratio."""
    scope = ["source_id"] if scope is None else scope
    scored = attach(records, scope, F.max("filled_ratio").alias("_best"))
    if top is None:
        return scored.filter((F.col("filled_ratio") >= ratio) | (F.col("_best") < ratio)).drop("_best")
    good = scored.filter(F.col("filled_ratio") >= ratio)
    rest = first_k(
        scored.filter(F.col("_best") < ratio), scope, [F.col("filled_ratio").desc(), F.col("sheet_idx"), F.col("row_idx")], top, "_rank"
    )
    return good.unionByName(rest.drop("_rank")).drop("_best")


# -------------------------------------------------------------- form intent
def form_intent(forms: DataFrame, words: IntentWords = WORDS) -> DataFrame:
    """Intent of each form: its file name, else its sheet names and headers.
    forms(template_id, filename, sheet, header_path)."""
    per = forms.groupBy("template_id").agg(
        F.max("filename").alias("filename"),
        F.concat_ws(" ", F.array_sort(F.collect_set("sheet")), F.array_sort(F.collect_set("header_path"))).alias("words"),
    )
    return per.select("template_id", F.coalesce(text_intent("filename", words, False), text_intent("words", words, False)).alias("intent"))


def mapping_intent(constants, mapping, filename, header_text, words: IntentWords = WORDS) -> Column:
    """Intent of a planned mapping: a declare-type constant, then mapped header
    names, then the form itself. constants and mapping are header → value maps."""
    decl = F.filter(F.map_entries(T.col(constants)), lambda e: T.contains_any(T.fold_text(e["key"]), ["申报类型", "declaretype"]))
    add, rem = ["增", "增员", "入职", "新增"], ["减", "减员", "离职", "退工", "退保"]
    said = F.try_element_at(
        F.filter(
            F.transform(decl, lambda e: _pick(T.contains_any(T.fold_text(e["value"]), add), T.contains_any(T.fold_text(e["value"]), rem))),
            lambda v: v.isNotNull(),
        ),
        F.lit(1),
    )
    heads = F.transform(F.map_keys(T.col(mapping)), T.fold_text)
    return F.coalesce(
        said,
        F.when(F.arrays_overlap(heads, F.array(F.lit("terminationdate"), F.lit("terminationreason"))), F.lit("remove")),
        F.when(F.array_contains(heads, "startdate"), F.lit("add")),
        text_intent(filename, words, False), text_intent(header_text, words, False),
    )
