"""Fill plans for addition and removal forms.

Work is done once per intent, whatever the number of forms; forms are joined on
their intent only when rows become cells.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..common import checkpointed, positions, settled
from ..functions import dates as D
from ..functions import text as T
from ..functions.checks import final_guard, is_digits, is_id_number, is_person_name, row_errors
from ..operators import intent as I
from ..operators import resolve as S
from ..options import FillOptions
from .fill import ordered
from .forms import detect_profiles, is_insurance_form, main_region, profile_columns, suffix_columns

ORDER = ["parent_source_id", "source_type", "source_file", "source_id", "sheet_idx", "row_idx"]
LINEAGE = [*ORDER]


def intent_keys(records: DataFrame, intents: list[str], hints: DataFrame | None = None) -> DataFrame:
    """Name, id and date key per source and intent: what is read of the records for it is
    the same for all intents and read once."""
    facts = checkpointed(S.key_facts(records, intents))
    per = facts.select("source_id", "ks")
    one = lambda i: S.fix_keys(records, S.proposed_keys(records, i, hints, facts), i, per).withColumn("intent", F.lit(i))
    return reduce(DataFrame.unionByName, [one(i).select("source_id", "intent", *KEYS) for i in intents])


KEYS = ["name_key", "id_key", "date_key", "id_available"]


def extract_people(records: DataFrame, intent: str, hints: DataFrame | None = None) -> DataFrame:
    """One row per record with name, id, event date and reason, or the reason
    it is skipped. Keys are chosen and repaired per source."""
    return _people(records, intent, intent_keys(records, [intent], hints), hints)


def _people(records: DataFrame, intent: str, keys: DataFrame, hints: DataFrame | None = None, kept: bool = False) -> DataFrame:
    """`extract_people` with the keys of the intent's sources. With `kept`, records whose
    sheet or source rules them out are left before anything is read of them."""
    j = ordered(records).join(keys.select("source_id", *KEYS), "source_id")
    if hints is not None:
        j = j.join(hints.select("source_id", F.nullif("reason_key", F.lit("")).alias("reason_key")), "source_id", "left")
    else:
        j = j.withColumn("reason_key", F.lit(None).cast("string"))
    j = j.withColumn("action", I.sheet_action(F.lit(intent), "sheet_name")).filter(I.own_intent_allows("rec", F.lit(intent)))
    if kept:
        j = j.filter("action <> 'blocked' AND date_key IS NOT NULL")

    j = T.with_lookup(j)
    values = lambda keys, folded=False: F.transform(T.found_values(keys, folded), lambda x: x["v"])
    first = lambda vs, test: F.try_element_at(F.filter(vs, lambda v: v.isNotNull() & test(v)), F.lit(1))
    name = F.coalesce(T.get_ci(F.col("name_key")), first(values(R.NAME_KEYS), is_person_name))
    cands = R.DATE_CANDIDATES[intent]
    # The source's own keys mostly decide; the other candidates are looked up where they don't.
    dates = F.transform(values(cands, True), D.record_date)
    when = F.coalesce(D.record_date("_date"), F.try_element_at(F.filter(dates, lambda d: d.isNotNull()), F.lit(1)))
    good_id = lambda v: is_id_number(v) & ~is_person_name(v) & ~D.is_date_like(v)
    idn = F.coalesce(F.when(F.col("_id").isNotNull() & good_id(F.col("_id")), F.col("_id")), first(values(R.ID_KEYS), good_id))
    reason = F.coalesce(T.get_folded(F.col("reason_key")), F.try_element_at(values(R.REASON_CANDIDATES, True), F.lit(1))) if intent == "remove" else F.lit(None).cast("string")
    j = j.withColumn("_date", T.get_folded(F.col("date_key"))).withColumn("_id", T.get_ci(F.col("id_key")))
    out = j.select(
        *LINEAGE, "sheet_name", "action", "date_key", name.alias("name"),
        F.coalesce(F.when(F.col("id_available"), idn), F.lit("")).alias("id_number"), when.alias("event_date"), F.coalesce(reason, F.lit("")).alias("reason"),
    )
    skip = (
        F.when(F.col("action") == "blocked", F.lit("sheet_blocked"))
        .when(F.col("date_key").isNull(), F.lit(f"required_field_missing:{cands[0]}"))
        .when(F.coalesce(is_digits("name"), F.lit(False)), F.lit("name_is_digits"))
        .when(~is_person_name("name"), F.lit("name_invalid"))
        .when(F.col("event_date").isNull(), F.lit("no_date"))
    )
    return settled(out, "skipped", skip)


def roster_people(records: DataFrame, intent: str, opts: FillOptions = FillOptions(), hints: DataFrame | None = None) -> DataFrame:
    """People of the intent's sources (all that are not excluded, or the best few if
    the options say so), one row each."""
    return roster_people_of(records, [intent], opts, hints)[intent]


def roster_people_of(records: DataFrame, intents: list[str], opts: FillOptions = FillOptions(), hints: DataFrame | None = None) -> dict[str, DataFrame]:
    """`roster_people` of each intent. Sources and keys, a row a source, are written once, so
    that each intent then reads only the records of its sources that have a date key."""
    if opts.max_sources is None:
        top = S.listed_sources(records)
        keys = checkpointed(intent_keys(records.join(top, "source_id", "left_semi"), intents, hints))
    else:
        best = checkpointed(S.top_sources(S.score_sources(records, intents), opts.max_sources).select("intent", "source_id"))
        keys = checkpointed(intent_keys(records.join(best.select("source_id").distinct(), "source_id", "left_semi"), intents, hints).join(best, ["intent", "source_id"], "left_semi"))

    def one(intent):
        own = keys.filter((F.col("intent") == intent) & F.col("date_key").isNotNull())
        people = _people(records, intent, own, hints, kept=True).filter("skipped IS NULL")
        return S.dedupe_people(people.drop("skipped", "action", "date_key", "sheet_name"), ORDER, opts.name_only_dedupe)

    return {i: one(i) for i in intents}


def check_rows(people: DataFrame, intent: str, fmt: str = "YYYYMM") -> DataFrame:
    """People as form rows with the fee month, guarded and validated; `errors`
    is empty for rows that may be written."""
    declare = "增" if intent == "add" else "减"
    rows = people.withColumn("declare_type", F.lit(declare)).withColumn("fee_month", D.next_month("event_date", fmt)).withColumn("_g", final_guard("name", "id_number"))
    rows = rows.withColumn("id_number", F.col("_g")["id_number"]).withColumn("warning", F.col("_g")["warning"]).withColumn("_rejected", F.col("_g")["rejected"])
    both = F.concat(F.when(F.col("_rejected"), F.array("warning")).otherwise(F.array().cast("array<string>")), row_errors("name", "id_number", "declare_type", "fee_month", declare))
    return settled(rows.drop("_g"), "errors", both).drop("_rejected")


def skip_counts(people: DataFrame) -> DataFrame:
    return people.filter("skipped IS NOT NULL").groupBy("skipped").agg(F.count(F.lit(1)).alias("n"))


CELL_WRITES = "template_id string, sheet string, row int, col int, col_letter string, key string, value string"


def _wanted(forms: DataFrame) -> list[str]:
    """The intents some form asks for. Forms are the caller's configuration: at
    most two rows come back, and work for unused intents is not planned."""
    found = forms.filter(F.col("intent").isin("add", "remove")).select("intent").distinct().collect()
    return sorted(r.intent for r in found)


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else like.sparkSession.createDataFrame([], CELL_WRITES)


def _cells(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows(intent, pos, name, id_number, declare_type, month, reason) joined to
    the forms of their intent. targets(template_id, intent, sheet, data_row, plan
    ARRAY of (col_index, col_letter, role, key)), fee_month_format.

    Rows fall into blocks by their position and forms, which are few, are copied to the
    blocks, so the rows of an intent don't meet its forms under one key."""
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_block", F.pmod("pos", F.lit(blocks)))
    targets = targets.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    j = rows.join(targets, ["intent", "_block"]).select(
        "template_id", "sheet", (F.col("data_row") + F.col("pos") - 1).cast("int").alias("row"), "name", "id_number", "declare_type",
        "event_date", "reason", "fee_month_format", F.explode("plan").alias("p"),
    )
    role = F.col("p")["role"]
    value = (
        F.when(role == "name", F.col("name")).when(role == "id", F.col("id_number")).when(role == "declare", F.col("declare_type"))
        .when(role == "fee_month", D.next_month("event_date", F.col("fee_month_format"))).when(role == "reason", F.col("reason"))
    )
    return j.select(
        "template_id", "sheet", "row", F.col("p")["col_index"].alias("col"), F.col("p")["col_letter"].alias("col_letter"),
        F.col("p")["key"].alias("key"), value.alias("value"),
    )


def roster_plan(records: DataFrame, columns: DataFrame, forms: DataFrame, samples: DataFrame | None = None, opts: FillOptions = FillOptions(), hints: DataFrame | None = None) -> DataFrame:
    """cell_writes of forms with a detected profile. forms(template_id, intent)."""
    found = checkpointed(detect_profiles(columns, samples).filter("detected").join(forms.select("template_id", "intent"), "template_id"))
    parts, wanted = [], _wanted(found)
    people = roster_people_of(records, wanted, opts, hints) if wanted else {}
    for intent in wanted:
        rows = check_rows(people[intent], intent).filter(F.size("errors") == 0)
        placed = checkpointed(positions(checkpointed(rows.withColumn("intent", F.lit(intent))), ["intent"], ORDER, ["row_idx"]))
        has_id = placed.agg(F.coalesce(F.max(F.col("id_number") != ""), F.lit(False))).scalar()
        roles = profile_columns(columns).filter((F.col("role_idx") == 0) | F.col("role").isin("declare", "fee_month", "reason"))
        if intent == "add":
            roles = roles.filter("role != 'reason'")
        key = (
            F.when(F.col("role") == "name", F.lit("__name__")).when(F.col("role") == "id", F.lit("__id_number__"))
            .when(F.col("role") == "reason", F.concat(F.lit("__termination_reason__"), F.col("role_idx").cast("string")))
            .otherwise(F.concat(F.lit("__"), F.when(F.col("role") == "declare", F.lit("declare_type")).otherwise(F.lit("fee_month")), F.lit("__"), "section", F.lit("_"), F.col("role_idx").cast("string")))
        )
        roles = roles.withColumn("key", key).filter((F.col("role") != "id") | has_id)
        plan = roles.groupBy("template_id").agg(
            F.max("sheet").alias("sheet"), F.max("data_row").alias("data_row"),
            F.array_sort(F.collect_list(F.struct("col_index", "col_letter", "role", "key"))).alias("plan"),
        )
        parts.append(_cells(placed, found.filter(F.col("intent") == intent).join(plan, "template_id").drop("detected")))
    return _union(parts, columns)


# ----------------------------------------------------------- insurance forms
def mail_leave_rows(records: DataFrame) -> DataFrame:
    """Leave records found in mails."""
    get = lambda k: F.coalesce(T.utrim(F.try_element_at("rec", F.lit(k))), F.lit(""))
    m = ordered(records).filter("source_type = 'email'").filter((get("intent") == "remove") | (get("leave_date") != ""))
    return m.select(*ORDER, *[get(k).alias(k) for k in ("name", "employee_id", "leave_date", "leave_date_text")])


def sheet_leave_rows(records: DataFrame, choice: DataFrame) -> DataFrame:
    """Leave records of the chosen workbook: name key, then the first date key
    holding a date."""
    get = lambda k: F.coalesce(T.utrim(F.try_element_at("rec", k if not isinstance(k, str) else F.lit(k))), F.lit(""))
    keys = ["leave_date", "end_date", "ss_end_month", "hf_end_month", "termination_date", "减员月份", "停保月份"]
    j = I.filter_by_sheet(ordered(records), "remove").join(choice.filter("name_key IS NOT NULL"), "source_id")
    values = [F.when(F.col("date_key").isNotNull(), F.nullif(get(F.coalesce("date_key", F.lit(""))), F.lit("")))] + [F.nullif(get(k), F.lit("")) for k in keys]
    # The date rule stands once in the plan, over the array of candidate texts.
    texts = F.filter(F.array(*values), lambda v: v.isNotNull())
    dates = F.filter(F.transform("_texts", D.record_date), lambda d: d.isNotNull())
    return j.withColumn("_texts", texts).select(
        *ORDER, get(F.col("name_key")).alias("name"), F.coalesce(F.nullif(get("employee_id"), F.lit("")), get("工号")).alias("employee_id"),
        F.coalesce(D.iso(F.try_element_at(dates, F.lit(1))), F.lit("")).alias("leave_date"), F.coalesce(F.try_element_at("_texts", F.lit(1)), F.lit("")).alias("leave_date_text"),
    ).filter("name != ''")


def insurance_rows(records: DataFrame, intent: str, proposal: DataFrame | None = None, opts: FillOptions = FillOptions()) -> DataFrame:
    """People for an insurance form: removals from mails and the workbook,
    deduplicated; additions from one workbook. `skipped` tells who is left out."""
    books = records.filter("source_type = 'excel'")
    choice = checkpointed(S.select_source(books, intent, proposal, opts.words).select("source_id", "name_key", "date_key"))
    if intent == "remove":
        both = mail_leave_rows(records).unionByName(sheet_leave_rows(books, choice))
        rows = S.dedupe_leave(both, ORDER).withColumn("event_date", D.record_date("leave_date"))
        idn = F.col("employee_id")
    else:
        j = I.filter_by_sheet(ordered(books), intent).join(choice.filter("name_key IS NOT NULL AND date_key IS NOT NULL"), "source_id")
        rows = j.select(
            *ORDER, F.coalesce(T.utrim(F.try_element_at("rec", F.col("name_key"))), F.lit("")).alias("name"),
            D.record_date(F.try_element_at("rec", F.col("date_key"))).alias("event_date"),
        )
        idn = F.lit("")
    skip = F.when(F.col("name") == "", F.lit("no_name")).when(F.col("event_date").isNull(), F.lit("date_parse_failed"))
    return rows.select(
        *ORDER, "name", idn.alias("id_number"), "event_date", F.lit("增" if intent == "add" else "减").alias("declare_type"),
        D.next_month("event_date").alias("fee_month"), F.lit("").alias("reason"), skip.alias("skipped"),
    )


def insurance_plan(records: DataFrame, columns: DataFrame, forms: DataFrame, proposal: DataFrame | None = None, opts: FillOptions = FillOptions()) -> DataFrame:
    """cell_writes of insurance forms: first name, declare-type and fee-month
    column each."""
    ok = checkpointed(is_insurance_form(columns).filter("is_insurance").join(forms.select("template_id", "intent"), "template_id"))
    main = main_region(columns)
    first = lambda suffix, role: suffix_columns(main, suffix).groupBy("template_id").agg(
        F.min(F.struct("col_index", "col_letter", "header_path")).alias("c"), F.max("sheet").alias("sheet"), F.max("data_row").alias("data_row")
    ).select("template_id", "sheet", "data_row", "c.*", F.lit(role).alias("role"))
    cols = first("姓名", "name").unionByName(first("申报类型", "declare")).unionByName(first("费用年月", "fee_month"))
    key = (
        F.when(F.col("role") == "name", F.lit("__name__"))
        .when(F.col("role") == "declare", F.concat(F.lit("__declare_type__"), T.fund_tag("header_path")))
        .otherwise(F.concat(F.lit("__fee_month__"), T.fund_tag("header_path")))
    )
    plan = cols.withColumn("key", key).groupBy("template_id").agg(
        F.max("sheet").alias("sheet"), F.max("data_row").alias("data_row"), F.array_sort(F.collect_list(F.struct("col_index", "col_letter", "role", "key"))).alias("plan")
    )
    parts = []
    for intent in _wanted(ok):
        rows = checkpointed(insurance_rows(records, intent, proposal, opts).filter("skipped IS NULL").withColumn("intent", F.lit(intent)))
        placed = positions(rows, ["intent"], ORDER, ["row_idx"])
        targets = ok.filter(F.col("intent") == intent).join(plan, "template_id").withColumn("fee_month_format", F.lit("YYYYMM")).drop("is_insurance")
        parts.append(_cells(placed, targets))
    return _union(parts, columns)


# ------------------------------------------------------------------- routing
def merge_registry(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """(template_key, strategy_key): user entries laid over the built-in ones."""
    u = user.filter(T.is_non_empty("strategy_key")).select(T.utrim("template_key").alias("template_key"), T.utrim("strategy_key").alias("u"))
    return builtin.select("template_key", F.col("strategy_key").alias("b")).join(u, "template_key", "full_outer").select(
        "template_key", F.coalesce("u", "b").alias("strategy_key")
    )


def route_forms(forms: DataFrame, columns: DataFrame, registry: DataFrame) -> DataFrame:
    """Strategy and intent per form: explicit strategy, then template key, then
    the detected profile; else by file name to the insurance plan; else none,
    with a warning. forms(template_id, filename, template_key, strategy_key)."""
    seen = detect_profiles(columns).select("template_id", "detected")
    known = registry.select("template_key", F.col("strategy_key").alias("_r"))
    j = forms.join(known, "template_key", "left").join(seen, "template_id", "left")
    explicit = F.nullif(T.utrim("strategy_key"), F.lit(""))
    old = F.coalesce(explicit, "_r", F.when(F.coalesce("detected", F.lit(False)), F.lit("roster")))
    named = I.form_file_intent("filename")
    strategy = F.coalesce(old, F.when(named.isNotNull(), F.lit("insurance")), F.lit("none"))
    return j.select(
        "template_id", "filename", strategy.alias("strategy"),
        F.coalesce(named, F.when(strategy == "roster", F.lit("add"))).alias("intent"),
        F.when(strategy == "none", F.lit("insurance_intent_unknown"))
        .when((strategy == "roster") & ~F.coalesce("detected", F.lit(False)), F.lit("social_security_profile_not_detected")).alias("warning"),
    )


Strategy = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def plan_fill(records: DataFrame, columns: DataFrame, routed: DataFrame, strategies: dict[str, Strategy] | None = None, postprocess: Callable[[DataFrame], DataFrame] | None = None, written: bool = False) -> DataFrame:
    """cell_writes of all forms by their strategy. A strategy maps (records,
    columns, forms) to cell_writes; own ones may be added or replace these.

    Strategies read the records several times: they are written once, unless the caller
    says that his are (`written`)."""
    table = {"roster": roster_plan, "insurance": insurance_plan, **(strategies or {})}
    routed, parts = checkpointed(routed), []
    used = {r.strategy for r in routed.filter(F.col("strategy").isin(*table)).select("strategy").distinct().collect()}
    if used and not written:
        records = checkpointed(records)
    for name, strategy in sorted((n, s) for n, s in table.items() if n in used):
        forms = routed.filter(F.col("strategy") == name)
        own = columns.join(forms.select("template_id"), "template_id", "left_semi")
        parts.append(strategy(records, own, forms).withColumn("strategy", F.lit(name)))
    if not parts:
        parts = [_union([], columns).withColumn("strategy", F.lit(None).cast("string"))]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.transform(postprocess) if postprocess else out
