"""Replies of an outside reader or model as a table of texts: parsing, shape
repair, field mappings. replies(source_id, reply STRING)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..functions import text as T
from ..rules import CONTAINER_KEYS

FENCE = r"```(?:json)?\s*(\{[\s\S]*?\}|\[[\s\S]*?\])\s*```"


def is_json(c) -> Column:
    """Strict JSON object, array or scalar."""
    return F.try_parse_json(c).isNotNull()


def balanced_slice(c) -> Column:
    """The first balanced {...} or [...] of a text; null when it never closes.

    Depth is a running sum over the brackets of the opening kind. Only the
    bracket positions are walked, not every character."""
    text = T.col(c)

    def cut(t):
        o, s = F.instr(t, "{"), F.instr(t, "[")
        start = F.when((o > 0) & ((s == 0) | (o < s)), o).when(s > 0, s)
        opener = F.substring(t, start, F.lit(1))
        tail = F.substring(t, start, F.length(t))
        pieces = F.when(opener == "{", F.split(tail, r"(?<=[{}])", -1)).otherwise(F.split(tail, r"(?<=[\[\]])", -1))

        def walk(acc, p):
            last = F.right(p, F.lit(1))
            step = F.when(last == opener, 1).when(last.isin("}", "]"), -1).otherwise(0)
            done = acc["done"]
            depth = F.when(done, acc["depth"]).otherwise(acc["depth"] + step)
            return F.struct(
                F.when(done, acc["len"]).otherwise(acc["len"] + F.length(p)).alias("len"), depth.alias("depth"),
                (done | ((step == -1) & (depth == 0))).alias("done"),
            )

        end = F.aggregate(pieces, F.struct(F.lit(0).alias("len"), F.lit(0).alias("depth"), F.lit(False).alias("done")), walk)
        return F.when(start.isNotNull(), T.let(end, lambda e: F.when(e["done"], F.substring(tail, F.lit(1), e["len"]))))

    return T.let(text, cut)


def parse_reply(c) -> Column:
    """struct(json, parse_error): the text itself, a fenced block, or the first
    balanced slice, whichever is JSON first."""
    raw = F.coalesce(T.utrim(c), F.lit(""))

    valid = lambda x: T.let(x, lambda v: F.when(is_json(v), v))

    def read(t):
        # Later readings are tried only where the earlier ones fail.
        good = F.coalesce(F.when(is_json(t), t), valid(F.nullif(F.regexp_extract(t, FENCE, 1), F.lit(""))), valid(balanced_slice(t)))
        return F.struct(t.alias("t"), F.when(t != "", good).alias("json"))

    def label(v):
        error = F.when(v["t"] == "", F.lit("empty_output")).when(v["json"].isNull(), F.lit("unable_to_parse_json"))
        return F.struct(v["json"].alias("json"), error.alias("parse_error"))

    return T.let(T.let(raw, read), label)


def json_kind(c) -> Column:
    """object, array, string, number, boolean or null by the first character."""
    first = F.substring(T.utrim(c), 1, 1)
    return (
        F.when(T.col(c).isNull(), F.lit("null")).when(first == "{", F.lit("object")).when(first == "[", F.lit("array"))
        .when(first == '"', F.lit("string")).when(first.isin("t", "f"), F.lit("boolean")).when(first == "n", F.lit("null"))
        .otherwise(F.lit("number"))
    )


def json_member(c, name: str) -> Column:
    """JSON text of an object's member, strings still quoted; null if absent."""
    return F.try_element_at(F.from_json(T.col(c), "map<string,string>"), F.lit(name))


def coerce_shape(c) -> Column:
    """struct(data ARRAY<STRING>, metadata, warnings): any reply to the standard
    envelope, with a warning for each repair."""
    as_list = lambda t: F.from_json(t, "array<string>")
    none = F.array().cast("array<string>")

    def split(j):
        members = F.from_json(F.when(json_kind(j) == "object", j), "map<string,string>")
        return F.struct(j.alias("j"), json_kind(j).alias("kind"), members.alias("m"))

    def take(v):
        get = lambda n: F.try_element_at(v["m"], F.lit(n))
        return F.struct(v["j"].alias("j"), v["kind"].alias("kind"), *[get(n).alias(n) for n in ("data", "metadata", "warnings")])

    def shape(v):
        kind, scalar = v["kind"], v["kind"].isin("string", "number", "boolean")
        wrong = lambda name, want, fix: F.when(v[name].isNotNull() & (json_kind(v[name]) != want), F.lit(f"'{name}' is not {fix}"))
        repairs = F.filter(
            F.array(
                F.when(kind == "null", F.lit("reply is empty")),
                F.when(kind == "array", F.lit("reply is an array; wrapped into data")),
                F.when(scalar, F.concat(F.lit("reply is a "), kind, F.lit("; kept as raw_output"))),
                wrong("data", "array", "a list; replaced with []"), wrong("metadata", "object", "an object; replaced with {}"),
                wrong("warnings", "array", "a list; replaced with []"),
            ),
            lambda w: w.isNotNull(),
        )
        own = F.coalesce(F.filter(as_list(F.when(json_kind(v["warnings"]) == "array", v["warnings"])), lambda w: w.isNotNull() & (w != "")), none)
        listed = F.when(kind == "array", v["j"]).when(json_kind(v["data"]) == "array", v["data"])
        raw = F.when(scalar, F.to_json(F.struct(v["j"].alias("raw_output"))))
        return F.struct(
            F.coalesce(as_list(listed), none).alias("data"),
            F.coalesce(F.when(json_kind(v["metadata"]) == "object", v["metadata"]), raw, F.lit("{}")).alias("metadata"),
            F.array_distinct(F.concat(repairs, own)).alias("warnings"),
        )

    return T.let(T.let(T.let(T.col(c), split), take), shape)


def container_items(c) -> Column:
    """Record list of an extracted payload: the payload itself, else the first
    priority key holding objects, else the first member that does."""
    as_list = lambda t: F.from_json(t, "array<string>")
    objects = lambda t: (json_kind(t) == "array") & F.coalesce(json_kind(F.try_element_at(as_list(t), F.lit(1))) == "object", F.lit(False))
    holding = lambda x: T.let(x, lambda v: F.when(objects(v), v))

    def pick(j):
        members = F.from_json(F.when(json_kind(j) == "object", j), "map<string,string>")
        by_rank = lambda m: F.coalesce(
            *[holding(F.try_element_at(m, F.lit(k))) for k in CONTAINER_KEYS], F.try_element_at(F.filter(F.map_values(m), objects), F.lit(1))
        )
        return F.coalesce(holding(j), T.let(members, by_rank))

    listed = T.let(T.let(T.col(c), pick), as_list)
    return F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: json_kind(x) == "object")


def item_record(item) -> Column:
    """One JSON object to a record map; nested values stay JSON text."""
    return T.stringify_record(F.from_json(T.col(item), "map<string,string>"))


def body_records(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies about mail bodies to records with lineage. Mails with an empty
    body or without a usable reply get a warning instead."""
    asked = messages.select("source_id", "source_file", "body").join(replies.select("source_id", "reply"), "source_id", "left")
    parsed = asked.withColumn("p", parse_reply("reply")).withColumn("s", coerce_shape(F.col("p")["json"]))
    usable = T.is_non_empty("body") & F.col("p")["json"].isNotNull()
    return parsed.select(
        "source_id", "source_file",
        F.when(usable, F.col("s")["data"]).otherwise(F.array().cast("array<string>")).alias("items"),
        F.when(T.is_empty("body"), F.lit("body_extracted: empty normalized body text"))
        .when(F.col("reply").isNull(), F.lit("body_extracted: no reply"))
        .when(F.col("p")["json"].isNull(), F.concat(F.lit("body_extracted: "), F.col("p")["parse_error"])).alias("warning"),
    )


def explode_records(bodies: DataFrame) -> DataFrame:
    """Items of `body_records` as records, one row each."""
    items = bodies.select("source_id", "source_file", F.posexplode("items").alias("row_idx", "item"))
    rec = F.map_concat(
        F.map_filter(item_record("item"), lambda k, v: k != "__source_file__"), F.create_map(F.lit("__source_file__"), F.col("source_file"))
    )
    return items.filter(json_kind("item") == "object").withColumn("rec", rec).drop("item")


# ------------------------------------------------------------ mapping fields
_MAP = "map<string,string>"


def _members(c) -> Column:
    """Members of a reply that is an object; each is looked up in the one parsed map."""
    return F.from_json(F.when(json_kind(c) == "object", T.col(c)), _MAP)


def _object(text: Column, schema: str) -> Column:
    return T.let(text, lambda t: F.from_json(F.when(json_kind(t) == "object", t), schema))


def _columns(members: Column) -> Column:
    inner = _object(F.try_element_at(members, F.lit("column_mapping")), _MAP)
    chosen = F.when(F.map_contains_key(members, "column_mapping"), inner).otherwise(members)
    plain = lambda v: F.coalesce(~F.substring(T.utrim(v), 1, 1).isin("{", "["), F.lit(False))
    kept = F.map_filter(chosen, lambda k, v: ~k.isin("column_mapping", "constant_values") & T.is_non_empty(k) & T.is_non_empty(v) & plain(v))
    return F.transform_values(F.transform_keys(kept, lambda k, v: T.utrim(k)), lambda k, v: T.utrim(v))


def _constants(members: Column) -> Column:
    kept = F.map_filter(_object(F.try_element_at(members, F.lit("constant_values")), _MAP), lambda k, v: T.is_non_empty(k) & v.isNotNull())
    return F.coalesce(F.transform_keys(kept, lambda k, v: T.utrim(k)), F.create_map().cast(_MAP))


def _filter(members: Column) -> Column:
    def checked(s):
        ok = T.is_non_empty(s["field"]) & (F.size(s["values"]) > 0)
        return F.when(
            ok,
            F.struct(
                T.utrim(s["field"]).alias("field"),
                F.transform(F.filter(s["values"], lambda v: v.isNotNull()), T.utrim).alias("values"),
                F.coalesce(s["exclude"], F.lit(False)).alias("exclude"),
            ),
        )

    return T.let(_object(F.try_element_at(members, F.lit("record_filter")), "field string, values array<string>, exclude boolean"), checked)


def column_mapping(c) -> Column:
    """header → key map of a reply: `column_mapping` or the reply itself."""
    return T.let(_members(c), _columns)


def constant_values(c) -> Column:
    return T.let(_members(c), _constants)


def record_filter(c) -> Column:
    """struct(field, values, exclude), or null when incomplete."""
    return T.let(_members(c), _filter)


def mapping_parts(c) -> Column:
    """struct(columns, constants, record_filter) of a reply that is parsed once."""
    return T.let(_members(c), lambda m: F.struct(_columns(m).alias("columns"), _constants(m).alias("constants"), _filter(m).alias("record_filter")))


YEAR_MONTH_STYLES = ("from_template_sample", "YYYYMM", "YYYY-MM", "YYYY/MM", "YYYY年MM月")


def derived_fields(replies: DataFrame, json: str = "json") -> DataFrame:
    """One row per proposed derived field with its reject reason, or null."""
    listed = json_member(json, "derived_fields")
    items = F.from_json(F.when(json_kind(listed) == "array", listed), "array<string>")
    rows = replies.select("source_id", F.posexplode(items).alias("idx", "item"))
    s = F.from_json(
        F.when(json_kind("item") == "object", F.col("item")),
        "new_key string, op string, args struct<source_keys:array<string>,strategy:string,output_format:string>",
    )
    rows = rows.withColumn("s", s).withColumn("args_kind", json_kind(json_member("item", "args")))
    a = F.col("s")["args"]
    keys_ok = F.coalesce(F.size(a["source_keys"]) >= 0, F.lit(False)) & F.coalesce(F.forall(a["source_keys"], T.is_non_empty), F.lit(False))
    reject = (
        F.when(F.col("s").isNull(), F.lit("not an object"))
        .when(T.is_empty(F.col("s")["new_key"]), F.lit("missing new_key"))
        .when(F.coalesce(F.col("s")["op"] != "MONTH_FROM_DATE", F.lit(True)), F.lit("unsupported op"))
        .when(F.col("args_kind") != "object", F.lit("args must be object"))
        .when(~keys_ok, F.lit("invalid source_keys"))
        .when(F.coalesce(a["strategy"] != "first_non_empty", F.lit(True)), F.lit("invalid strategy"))
        .when(F.coalesce(~a["output_format"].isin(*YEAR_MONTH_STYLES), F.lit(True)), F.lit("invalid output_format"))
    )
    return rows.select(
        "source_id", "idx", T.utrim(F.col("s")["new_key"]).alias("new_key"), a["source_keys"].alias("source_keys"),
        a["output_format"].alias("output_format"), reject.alias("reject"),
    )


TARGETS = ("name", "id_number", "event_date", "termination_reason")


def target_mapping(replies: DataFrame, known_keys: DataFrame, json: str = "json") -> DataFrame:
    """target field → source key of a reply, kept when the source has the key.
    known_keys(source_id, key). Rejected rows carry a warning."""
    nested = F.coalesce(
        *[F.when(json_kind(json_member(json, n)) == "object", json_member(json, n)) for n in ("target_field_to_source_key", "mapping")]
    )
    pairs = replies.select("source_id", F.explode(F.from_json(nested, "map<string,string>")).alias("target", "key")).filter(
        F.col("target").isin(*TARGETS) & T.is_non_empty("key")
    )
    have = known_keys.select("source_id", "key").distinct().withColumn("known", F.lit(True))
    out = pairs.join(have, ["source_id", "key"], "left")
    return out.select(
        "source_id", "target", T.utrim("key").alias("key"), F.coalesce("known", F.lit(False)).alias("known"),
        F.when(F.col("known").isNull(), F.concat(F.lit("mapping_invalid_key:"), "target", F.lit("->"), "key")).alias("warning"),
    )


def mapping_hints(mapping: DataFrame) -> DataFrame:
    """Known targets of `target_mapping` as one row of key hints per source."""
    pick = lambda t: F.max(F.when(F.col("known") & (F.col("target") == t), F.col("key")))
    return mapping.groupBy("source_id").agg(
        pick("name").alias("name_key"), pick("id_number").alias("id_key"), pick("event_date").alias("date_key"),
        pick("termination_reason").alias("reason_key"),
    )


def leave_reply_records(replies: DataFrame) -> DataFrame:
    """Leave-notice replies to records: only the known fields, intent removal."""
    shaped = replies.withColumn("s", coerce_shape(parse_reply("reply")["json"]))
    items = shaped.select("source_id", F.posexplode(F.col("s")["data"]).alias("idx", "item")).filter(json_kind("item") == "object")
    m = F.from_json("item", "map<string,string>")
    get = lambda k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit("")).alias(k)
    return items.select(
        "source_id", "idx", *[get(k) for k in ("name", "employee_id", "leave_date_text", "leave_date", "note")], F.lit("remove").alias("intent")
    )
