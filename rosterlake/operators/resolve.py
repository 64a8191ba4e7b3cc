"""Choosing sources, fields and one record per person."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..common import attach, best_per_group, checkpointed, first_k
from ..functions import text as T
from ..functions.checks import LOOKS, SCORES, is_national_id, is_person_name
from ..functions.dates import record_date
from ..options import IntentWords

RECORD_ORDER = ["sheet_idx", "row_idx"]
#: Stands for a missing sheet or row: before all others, as null is.
_NO_PLACE = 1 - (1 << 31)


# ------------------------------------------------------------------ dedupe
def _keyed(rows: DataFrame, kind: Column, keys: dict, order: list) -> DataFrame:
    """Rows with what they are matched by, written once: each kind is then read alone."""
    return checkpointed(rows.select(F.struct(*rows.columns).alias("_row"), kind.alias("_kind"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_order"), *[v.alias(k) for k, v in keys.items()]))


def _winners(keyed: DataFrame, kind: int, keys: list[str]) -> DataFrame:
    """The first row of each key: an aggregate, combined before its shuffle."""
    return keyed.filter(F.col("_kind") == kind).groupBy(*keys).agg(F.min_by("_row", "_order").alias("_row"))


def dedupe_leave(rows: DataFrame, order: list[str]) -> DataFrame:
    """One record per employee id, else per (name, leave date), keeping the one
    with most filled fields; a name and date already covered by an id winner is
    dropped; rows without id and name all stay, also equal ones. Only rows matched by
    name meet the id winners' names; winners by id take no part in that join."""
    fields = [c for c in rows.columns if c not in order]
    filled = sum((F.when(T.is_non_empty(F.col(c).cast("string")), 1).otherwise(0) for c in fields), F.lit(0))
    trimmed = lambda c: F.coalesce(T.utrim(c), F.lit(""))
    who, name, when = trimmed("employee_id"), trimmed("name"), trimmed("leave_date")
    kind = F.when(who != "", 0).when(name != "", 1).otherwise(2)
    keyed = _keyed(rows, kind, {"_id": who, "_name": name, "_date": when}, [-filled, *[F.col(o) for o in order]])
    by_id, by_name = _winners(keyed, 0, ["_id"]), _winners(keyed, 1, ["_name", "_date"])
    covered = by_id.select(trimmed(F.col("_row.name")).alias("_name"), trimmed(F.col("_row.leave_date")).alias("_date")).filter("_name <> ''").distinct()
    left = by_name.join(covered, ["_name", "_date"], "left_anti")
    return by_id.select("_row.*").unionByName(left.select("_row.*")).unionByName(keyed.filter("_kind = 2").select("_row.*"))


def dedupe_people(rows: DataFrame, order: list[str], name_only: bool = False) -> DataFrame:
    """One record per id of four characters or more, else per (name, event
    date); rows without id are dropped when an id winner has the name. With
    `name_only`, at most one row per name is kept overall."""
    who, name = F.coalesce(T.utrim("id_number"), F.lit("")), F.coalesce("name", F.lit(""))
    size = F.length(F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns if c not in order]))
    day = F.coalesce(F.col("event_date").cast("string"), F.lit(""))
    keyed = _keyed(rows, F.when(F.length(who) >= 4, 0).otherwise(1), {"_id": who, "_name": name, "_date": day}, [-size, *[F.col(o) for o in order]])
    by_id, by_name = _winners(keyed, 0, ["_id"]), _winners(keyed, 1, ["_name", "_date"])
    covered = by_id.select(F.coalesce("_row.name", F.lit("")).alias("_name")).distinct()
    left = by_name.join(covered, "_name", "left_anti").select("_row.*")
    if name_only:
        left = best_per_group(left, ["name"], [F.col(o) for o in order])
    return by_id.select("_row.*").unionByName(left)


def dedupe_simple(rows: DataFrame, order: list[str]) -> DataFrame:
    """One record per id, else per name; rows with an id preferred."""
    key = F.coalesce(F.nullif("id_number", F.lit("")), F.nullif("name", F.lit("")))
    keyed = rows.withColumn("_k", key).filter("_k IS NOT NULL")
    lacks = F.when(F.coalesce(F.col("id_number"), F.lit("")) == "", 1).otherwise(0)
    return best_per_group(keyed, ["_k"], [lacks, *[F.col(o) for o in order]]).select(*rows.columns)


# ------------------------------------------------------------ source scores
def file_score(filename, intent) -> Column:
    """Weight of the intent words in a file name."""
    t, intent = T.fold_profile(filename), T.col(intent)
    count = lambda words: sum((F.when(F.contains(t, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    s = R.FILE_SIGNALS
    add = 30.0 * count(s["add_strong"]) + 10.0 * count(s["add_weak"]) - 20.0 * count(s["remove_strong"])
    remove = 30.0 * count(s["remove_strong"]) + 10.0 * count(s["remove_weak"]) - 20.0 * count(s["add_strong"])
    base = F.when(intent == "add", add).when(intent == "remove", remove).otherwise(F.lit(0.0))
    return F.when(t == "", F.lit(0.0)).otherwise(base - F.when(T.contains_any(t, s["exclude"]), 15.0).otherwise(0.0))


def is_excluded_file(filename) -> Column:
    return T.contains_any(T.fold_profile(filename), R.FILE_SIGNALS["exclude"])


def key_score(keys, intent) -> Column:
    """Weight of the record keys for an intent. `keys` is an array column."""
    intent = T.col(intent)

    def score(folded):
        has = lambda words: F.exists(folded, lambda k: T.contains_any(k, words))
        k = R.KEY_SIGNALS
        base = F.when(has(k["name"]), 10.0).otherwise(0.0) + F.when(has(k["id"]), 10.0).otherwise(0.0)
        conflicts = sum((F.when(has([w]), 5.0).otherwise(0.0) for w in k["end"]), F.lit(0.0))
        add = F.when(has(k["start"]), 20.0).otherwise(0.0) - conflicts
        remove = F.when(has(k["end"]), 20.0).otherwise(0.0)
        return base + F.when(intent == "add", add).when(intent == "remove", remove).otherwise(F.lit(0.0))

    return T.let(F.transform(T.col(keys), T.fold_profile), score)


def coverage_flags() -> list[Column]:
    """has_name, has_id, has_national_id, has_start and has_leave of a record on
    a frame with `with_lookup`."""
    named = lambda keys, ok: F.exists(T.found_values(keys), lambda x: F.coalesce(ok(x["v"]), F.lit(False)))
    idn = F.try_element_at(T.found_values(R.ID_KEYS), F.lit(1))["v"]
    dated = lambda keys: named(keys, lambda v: record_date(v).isNotNull())
    return [
        named(R.NAME_KEYS, is_person_name).alias("has_name"), idn.isNotNull().alias("has_id"),
        is_national_id(idn).alias("has_national_id"), dated(R.START_DATE_KEYS).alias("has_start"),
        dated(R.LEAVE_DATE_KEYS).alias("has_leave"),
    ]


def field_coverage(records: DataFrame) -> DataFrame:
    """Share of a source's records with a name, an id, a start or leave date."""
    flags = T.with_lookup(records.select("source_id", "rec")).select("source_id", *coverage_flags())
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    return flags.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("record_count"), share("has_name").alias("name_coverage"), share("has_id").alias("id_coverage"),
        F.sum(F.when(F.col("has_national_id"), 1).otherwise(0)).alias("national_ids"),
        share("has_start").alias("start_coverage"), share("has_leave").alias("leave_coverage"),
    )


def source_keys(records: DataFrame) -> DataFrame:
    """Distinct keys per source in first-seen order, over all its records."""
    spread = records.select("source_id", *RECORD_ORDER, F.posexplode(F.map_keys("rec")).alias("key_idx", "key"))
    return spread.groupBy("source_id", "key").agg(F.min(F.struct(*RECORD_ORDER, "key_idx")).alias("seen"))


def score_sources(records: DataFrame, intents=("add", "remove")) -> DataFrame:
    """One row per source and intent: file name, key and coverage scores, mail
    bonus, halved when the name says it lists people in service."""
    per = field_coverage(records)
    keys = source_keys(records).groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "key"))), lambda x: x["key"]).alias("keys"))
    facts = records.groupBy("source_id").agg(
        F.max("source_file").alias("source_file"), F.max("source_type").alias("source_type"),
        F.max("parent_source_id").alias("parent_source_id"),
        F.sum(F.when(F.try_element_at("rec", F.lit("intent")) == "remove", 1).otherwise(0)).alias("said_remove"),
    )
    base = per.join(facts, "source_id").join(keys, "source_id").withColumn(
        "intent", F.explode(F.array(*[F.lit(i) for i in intents]))
    )
    removal = F.col("intent") == "remove"
    date_cov = F.when(removal, F.col("leave_coverage")).otherwise(F.col("start_coverage"))
    bonus = F.when(removal & (F.col("source_type") == "email"), F.least(F.col("said_remove") * 5.0, F.lit(20.0))).otherwise(F.lit(0.0))
    total = F.col("file_score") + F.col("key_score") + F.col("coverage_score")
    return (
        base.withColumn("file_score", file_score("source_file", "intent")).withColumn("key_score", key_score("keys", "intent"))
        .withColumn("date_coverage", date_cov).withColumn("excluded", is_excluded_file("source_file"))
        .withColumn("coverage_score", F.col("name_coverage") * 25.0 + F.col("id_coverage") * 15.0 + F.col("date_coverage") * 30.0 + bonus)
        .withColumn("total_score", F.when(F.col("excluded"), total * 0.5).otherwise(total))
        .drop("keys", "start_coverage", "leave_coverage")
    )


def top_sources(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Sources per intent, the best k if a number is given; excluded ones only when
    all are."""
    seen = attach(scores, ["intent"], F.min("excluded").alias("all_excluded"))
    pool = seen.filter(~F.col("excluded") | F.col("all_excluded"))
    if k is None:
        return pool
    order = [F.col("total_score").desc(), F.col("parent_source_id"), F.col("source_type"), F.col("source_file"), F.col("source_id")]
    return first_k(pool, ["intent"], order, k)


def listed_sources(records: DataFrame) -> DataFrame:
    """`top_sources` of any intent where no number is given: which sources are excluded
    depends on their file names alone, so nothing is scored."""
    each = records.groupBy("source_id", "source_file").agg(F.max(F.size("rec") > 0).alias("has_keys"))
    per = each.groupBy("source_id").agg(F.max("source_file").alias("source_file"), F.max("has_keys").alias("has_keys"))
    seen = checkpointed(per.filter("source_id IS NOT NULL AND has_keys").select("source_id", is_excluded_file("source_file").alias("excluded")))
    return seen.filter(~F.col("excluded") | seen.agg(F.min("excluded")).scalar()).select("source_id")


# -------------------------------------------------------------- field types
def folds_alike(rec) -> Column:
    """The record has keys that are equal when folded."""
    return F.size(F.array_distinct(F.transform(F.map_keys(T.col(rec)), T.fold_record_key))) < F.size(rec)


def _key_scores(records: DataFrame) -> DataFrame:
    """`field_type_scores` with `told`: a record whose keys fold to different ones has a value
    under the key. A source without any key has a row without one."""
    spread = records.select(
        "source_id", *[F.coalesce(c, F.lit(_NO_PLACE)).cast("long").alias(c) for c in RECORD_ORDER],
        (~folds_alike("rec")).alias("plain"), F.posexplode_outer(F.map_entries("rec")).alias("key_idx", "e"),
    )
    # Sheet and row as one number: numbers are gathered by hashing, structs by sorting every
    # value of every record.
    texts = spread.select(
        "source_id", "plain", F.col("e")["key"].alias("key"), "key_idx", (F.shiftleft("sheet_idx", 32) + F.col("row_idx")).alias("at"),
        F.coalesce(T.utrim(F.col("e")["value"]), F.lit("")).alias("value"),
    )
    looks = texts.select("source_id", "plain", "key", "key_idx", "at", (F.col("value") != "").alias("filled"), *[look(F.col("value")).alias(kind) for kind, look in LOOKS.items()])
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    each = looks.groupBy("source_id", "key", "key_idx").agg(
        F.min("at").alias("at"), count(F.col("filled")).alias("filled"), F.max(F.col("filled") & F.col("plain")).alias("told"), *[count(F.col(k)).alias(k) for k in LOOKS]
    )
    sheet = F.shiftright(F.col("at") + (1 << 31), 32)
    seen = F.struct(sheet.cast("int").alias("sheet_idx"), (F.col("at") - F.shiftleft(sheet, 32)).cast("int").alias("row_idx"), "key_idx")
    share = lambda k: F.coalesce(F.try_divide(F.sum(k).cast("double"), F.sum("filled").cast("double")), F.lit(0.0))
    return each.groupBy("source_id", "key").agg(F.min(seen).alias("seen"), *[share(k).alias(k) for k in LOOKS], F.coalesce(F.max("told"), F.lit(False)).alias("told"))


def field_type_scores(records: DataFrame) -> DataFrame:
    """Per source, key and type: share of non-blank values that look right, over
    all records: hash aggregates of numbers, no window."""
    return _key_scores(records).filter("key IS NOT NULL").drop("told")


def gathered_keys(records: DataFrame) -> DataFrame:
    """Each source's keys with their scores in first-seen order, one array (`ks`) a source."""
    one = F.when(F.col("key").isNotNull(), F.struct("seen", "key", *LOOKS, "told"))
    return _key_scores(records).groupBy("source_id").agg(F.array_sort(F.collect_list(one)).alias("ks"))


def key_facts(records: DataFrame, intents: list[str]) -> DataFrame:
    """Per source its `gathered_keys`, the first usual name and id key with a value, and for
    each intent the date key and why (`date_key_add`, `date_reason_add`).

    Which candidates have values is told by the source's keys. Only where a record has keys
    folding alike does one hide another, so candidates are looked up in those records."""
    lists = {"_name": (R.NAME_KEYS, False), "_id": (R.ID_KEYS, False), **{f"_date_{i}": (R.DATE_CANDIDATES[i], True) for i in intents}}
    odd = T.with_lookup(records.filter(folds_alike("rec")).select("source_id", "rec"))
    looked = odd.select("source_id", *[F.try_element_at(T.found_values(keys, folded), F.lit(1))["i"].alias(c) for c, (keys, folded) in lists.items()])
    looked = looked.groupBy("source_id").agg(*[F.min(c).alias(c) for c in lists])

    def place(keys, folded):
        fold = T.fold_record_key if folded else F.lower
        at = lambda x: F.nullif(F.array_position(F.array(*[fold(F.lit(k)) for k in keys]), fold(x["key"])), F.lit(0)).cast("int") - 1
        return F.array_min(F.transform(F.filter("ks", lambda x: x["told"]), at))

    own = gathered_keys(records).select("*", *[place(*v).alias(f"{c}_own") for c, v in lists.items()]).join(looked, "source_id", "left")
    key = lambda c: F.try_element_at(F.array(*[F.lit(k) for k in lists[c][0]]), F.least(c, f"{c}_own") + 1)
    out = own.withColumn("name_key", F.coalesce(key("_name"), F.lit(R.NAME_KEYS[0]))).withColumn("id_key", F.coalesce(key("_id"), F.lit(R.ID_KEYS[0])))
    for i in intents:
        found, missing = key(f"_date_{i}"), F.lit(f"required_field_missing:{R.DATE_CANDIDATES[i][0]}")
        # For removals the first key of a record is taken, whether it has a value or not.
        starts = lambda w: F.try_element_at(F.filter(F.transform("ks", lambda x: x["key"]), lambda k: F.startswith(T.fold_record_key(k), F.lit(w))), F.lit(1))
        end, term = (starts(w) if i == "remove" else F.lit(None).cast("string") for w in ("enddate", "terminationdate"))
        reason = F.when(end.isNotNull(), F.lit("forced_end_date")).when(term.isNotNull(), F.lit("forced_termination")).when(found.isNotNull(), F.lit("found")).otherwise(missing)
        out = out.withColumn(f"date_key_{i}", F.coalesce(end, term, found)).withColumn(f"date_reason_{i}", reason)
    return out.select("source_id", "ks", "name_key", "id_key", *[f"date_{c}_{i}" for i in intents for c in ("key", "reason")])


def choose_date_key(records: DataFrame, intent: str) -> DataFrame:
    """Per source the date key of an intent: for removals any key starting with
    enddate, then terminationdate; else the first candidate with a value."""
    return key_facts(records, [intent]).select("source_id", F.col(f"date_key_{intent}").alias("date_key"), F.col(f"date_reason_{intent}").alias("date_key_reason"))


def proposed_keys(records: DataFrame, intent: str, hints: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """name_key, id_key and date_key proposed per source; hints(source_id,
    name_key, id_key, date_key) are used where no usual key is present. `facts` are the
    records' `key_facts` where a caller has them."""
    facts = key_facts(records, [intent]) if facts is None else facts
    out = facts.select("source_id", "name_key", "id_key", F.col(f"date_key_{intent}").alias("date_key"), F.col(f"date_reason_{intent}").alias("date_key_reason"))
    if hints is not None:
        h = hints.select("source_id", F.nullif("name_key", F.lit("")).alias("hn"), F.nullif("id_key", F.lit("")).alias("hi"), F.nullif("date_key", F.lit("")).alias("hd"))
        present = records.join(h.filter("hd IS NOT NULL").select("source_id", "hd"), "source_id").groupBy("source_id").agg(
            F.max(T.rec_value_folded("rec", F.col("hd")).isNotNull()).alias("hd_ok")
        )
        out = out.join(h, "source_id", "left").join(present, "source_id", "left").withColumn(
            "date_key", F.when(F.col("hd_ok"), F.col("hd")).otherwise(F.col("date_key"))
        ).withColumn("name_key", F.when(F.col("name_key") == R.NAME_KEYS[0], F.coalesce("hn", "name_key")).otherwise(F.col("name_key"))).withColumn(
            "id_key", F.when(F.col("id_key") == R.ID_KEYS[0], F.coalesce("hi", "id_key")).otherwise(F.col("id_key"))
        ).drop("hn", "hi", "hd", "hd_ok")
    return out


def fix_keys(records: DataFrame, proposed: DataFrame, intent: str, per: DataFrame | None = None) -> DataFrame:
    """Check the proposed keys against the values and repair them: name first,
    then id (not the name key), then date (neither). What is gathered per source is
    its keys, a row each; `per` are the records' `gathered_keys` where a caller has them."""
    per = gathered_keys(records) if per is None else per
    base = proposed.join(per, "source_id", "left").withColumn("ks", F.coalesce("ks", F.array().cast("array<struct<seen:struct<sheet_idx:int,row_idx:int,key_idx:int>,key:string,name:double,id:double,date:double,told:boolean>>")))

    def own(kind, key):
        # The proposed key is looked up exactly, else in lower case.
        exact = F.filter("ks", lambda x: x["key"] == F.col(key))
        loose = F.filter("ks", lambda x: F.lower(x["key"]) == F.lower(F.col(key)))
        return F.coalesce(F.try_element_at(exact, F.lit(1))[kind], F.try_element_at(loose, F.lit(1))[kind], F.lit(0.0))

    def best(kind, allowed):
        pool = F.filter("ks", lambda x: allowed(x) & (x[kind] > 0))
        top = F.array_max(F.transform(pool, lambda x: x[kind]))
        hit = F.filter(pool, lambda x: x[kind] == top)
        return F.try_element_at(hit, F.lit(1))

    def step(df, kind, key, allowed):
        b = best(kind, allowed)
        df = df.withColumn("_s", own(kind, key)).withColumn("_b", b)
        repaired = (F.col("_s") < 0.5) & (F.col("_b")[kind] >= 0.3)
        return (
            df.withColumn(f"{kind}_valid", (F.col("_s") >= 0.5) | F.coalesce(repaired, F.lit(False)))
            .withColumn(f"{kind}_repaired", F.coalesce(repaired, F.lit(False)))
            .withColumn(f"{kind}_score", F.when(F.coalesce(repaired, F.lit(False)), F.col("_b")[kind]).otherwise(F.col("_s")))
            .withColumn(key, F.when(F.coalesce(repaired, F.lit(False)), F.col("_b")["key"]).otherwise(F.col(key)))
            .drop("_s", "_b")
        )

    out = step(base, "name", "name_key", lambda x: F.lit(True))
    any_id = F.exists("ks", lambda x: ((x["key"] == F.col("id_key"))) | (x["id"] > 0))
    out = out.withColumn("id_available", any_id)
    out = step(out, "id", "id_key", lambda x: x["key"] != F.col("name_key"))
    out = out.withColumn("id_key", F.when(F.col("id_valid") | F.col("id_available"), F.col("id_key")))
    # Date repair looks at the candidate list only, in its order.
    cands = R.DATE_CANDIDATES[intent]
    rank = lambda x: F.array_position(F.array(*[F.lit(c) for c in cands]), x["key"])
    out = out.withColumn("ks", F.transform(F.array_sort(F.transform(F.filter("ks", lambda x: rank(x) > 0), lambda x: F.struct(rank(x).alias("o"), x.alias("x")))), lambda y: y["x"]))
    out = step(out, "date", "date_key", lambda x: (x["key"] != F.col("name_key")) & ~F.coalesce(x["key"] == F.col("id_key"), F.lit(False)))
    return out.drop("ks")


# ------------------------------------------------- single-source choice (adds)
def source_pick(records: DataFrame, intent: str, words: IntentWords = IntentWords()) -> DataFrame:
    """The sources a form reads: those whose file name says the intent; where none
    does, those with date-like keys."""
    kw = words.add_files if intent == "add" else words.remove_files
    dk = words.add_date_keys if intent == "add" else words.remove_date_keys
    keys = source_keys(records)
    folded = T.match_text("key")
    dated = F.avg(F.when(T.contains_any(folded, [d.lower().replace("_", "") for d in dk]), 1.0).otherwise(0.0))
    per = records.groupBy("source_id").agg(*[F.max(c).alias(c) for c in ("parent_source_id", "source_type", "source_file")])
    scored = per.join(keys.groupBy("source_id").agg(dated.alias("date_share")), "source_id").withColumn(
        "by_name", T.contains_any(T.match_text("source_file"), kw)
    )
    named = scored.filter("by_name").select("source_id").limit(1).withColumn("_any", F.lit(True)).agg(F.coalesce(F.max("_any"), F.lit(False))).scalar()
    return scored.filter(F.when(named, F.col("by_name")).otherwise(F.col("date_share") > 0)).select("source_id", "source_file", "date_share", "by_name")


def heuristic_keys(records: DataFrame, intent: str) -> DataFrame:
    """name_key and date_key per source by key names, else by values."""
    keys = source_keys(records)
    counts = records.select("source_id", F.explode(F.map_entries("rec")).alias("e")).groupBy("source_id", F.col("e")["key"].alias("key")).agg(
        F.sum(F.when(is_person_name(F.col("e")["value"]), 1).otherwise(0)).alias("people")
    )
    low, fold = F.lower("key"), T.match_text("key")
    tier = F.when(low == "name", 0).when(F.contains(fold, F.lit("姓名")), 1).when(F.col("people") > 0, 2)
    name_order = F.when(tier.isNotNull(), F.struct(tier.alias("t"), F.when(tier == 2, -F.col("people")).otherwise(F.lit(0)).alias("p"), "seen"))
    if intent == "add":
        dt = F.when(low == "start_date", 0).when(T.contains_any(fold, ["入职日期", "到岗日期"]), 1)
    else:
        dt = (
            F.when(low.isin("leave_date", "end_date"), 0)
            .when(T.contains_any(fold, ["减员月份", "减员年月", "停保月份", "停保年月", "费用年月"]), 1)
            .when(T.contains_any(fold, ["离职日期", "终止日期"]), 2)
        )
    date_order = F.when(dt.isNotNull(), F.struct(dt.alias("t"), "seen"))
    return keys.join(counts, ["source_id", "key"]).groupBy("source_id").agg(
        F.min_by("key", name_order).alias("name_key"), F.min_by("key", date_order).alias("date_key")
    )


def select_source(records: DataFrame, intent: str, proposal: DataFrame | None = None, words: IntentWords = IntentWords()) -> DataFrame:
    """Sources, name keys and date keys: a valid proposal(source_id, name_key,
    date_key) wins over the heuristics, field by field, and is then the only
    source. Of several valid proposals the first in source order is taken."""
    keys = source_keys(records).select("source_id", "key")
    guess = source_pick(records, intent, words).select("source_id")
    usual = heuristic_keys(records, intent)
    if proposal is None:
        return guess.join(usual, "source_id", "left").withColumn("origin", F.lit("heuristic"))
    order = records.groupBy("source_id").agg(F.min(F.struct("parent_source_id", "source_type", "source_file", "source_id")).alias("_o"))
    known = proposal.join(order, "source_id").agg(F.min_by(F.struct("source_id", F.col("name_key").alias("n"), F.col("date_key").alias("d")), F.struct("_o", "name_key", "date_key")).alias("p")).select("p.*").filter("source_id IS NOT NULL")
    has = lambda c, as_: known.join(keys.withColumnRenamed("key", c), ["source_id", c], "left_semi").select("source_id", F.col(c).alias(as_))
    said = known.select("source_id").join(has("n", "pn"), "source_id", "left").join(has("d", "pd"), "source_id", "left").withColumn("_said", F.lit(True))
    any_said = known.agg(F.count(F.lit(1)) > 0).scalar()
    out = guess.filter(~any_said).join(said, "source_id", "left").unionByName(said).join(usual, "source_id", "left")
    return out.select(
        "source_id", F.coalesce("pn", "name_key").alias("name_key"), F.coalesce("pd", "date_key").alias("date_key"),
        F.when(F.col("_said"), F.lit("proposal")).otherwise(F.lit("heuristic")).alias("origin"),
    )
