"""Mail bodies: thread cut, leave notices, leave records."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import attach, best_per_group, checkpointed
from ..functions import dates as D
from ..functions import text as T
from ..functions.text import WS
from ..rules import LEAVE_WORDS

# Lines that start a quoted message, in order of trial.
SEPARATORS = (
    ("原始邮件_separator", rf"^{WS}*-{{3,}}{WS}*原始邮件{WS}*-{{3,}}{WS}*$"),
    ("original_message_separator", rf"^{WS}*-{{3,}}{WS}*Original{WS}+Message{WS}*-{{3,}}{WS}*$"),
    ("forwarded_message_separator", rf"^{WS}*-{{3,}}{WS}*Forwarded{WS}+message{WS}*-{{3,}}{WS}*$"),
    ("begin_forwarded", rf"^{WS}*Begin{WS}+forwarded{WS}+message{WS}*[:：]?{WS}*$"),
    ("dashes_separator", rf"^{WS}*-{{5,}}{WS}*$"),
    ("on_wrote_separator", rf"^{WS}*On{WS}.+wrote{WS}*[:：]{WS}*$"),
)
# Mail header fields a quoted block repeats.
QUOTED_FIELDS = ("发件人", "From", "发送时间", "Sent", "Date", "收件人", "To", "主题", "Subject", "抄送", "Cc")
WINDOW, MIN_FIELDS, MIN_POSITION = 10, 3, 100

HAN_NAME = r"[一-龥]{2,4}"
NAME_ID = rf"({HAN_NAME})[（(]([0-9]{{4,}})[）)]"
LEAVE_WORD = "|".join(LEAVE_WORDS)
ANY_DATE = r"[0-9]{1,2}月[0-9]{1,2}日|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"


# --------------------------------------------------------------- thread cut
def _line_marks(line: Column) -> Column:
    marker = F.lit(None).cast("string")
    for name, pattern in reversed(SEPARATORS):
        marker = F.when(line.rlike("(?i)" + pattern), F.lit(name)).otherwise(marker)
    field = F.lower(F.regexp_extract(line, rf"(?i)^{WS}*({'|'.join(QUOTED_FIELDS)}){WS}*[:：]", 1))
    return F.struct(F.length(line).alias("len"), marker.alias("marker"), F.nullif(field, F.lit("")).alias("field"))


def cut_thread(text) -> Column:
    """struct(text, rule, marker, line) keeping only the newest message.

    One row in, one row out: the lines of a body are an array, so no shuffle is
    needed. Bodies without any separator or header-like line skip the work."""
    text = F.coalesce(T.col(text), F.lit(""))
    suspicious = text.rlike(rf"(?im)^{WS}*(?:-{{3,}}|Begin{WS}+forwarded|On{WS}|(?:{'|'.join(QUOTED_FIELDS)}){WS}*[:：])")

    def with_marks(t):
        marks = F.transform(F.split(t, "\n", -1), _line_marks)
        return F.struct(t.alias("t"), marks.alias("m"))

    def find(v):
        m = v["m"]
        # (index, marker) of separator lines; a separator on line 0 cuts nothing.
        cut1 = F.try_element_at(
            F.filter(F.transform(m, lambda x, i: F.struct(i.alias("i"), x["marker"].alias("k"))), lambda x: (x["i"] > 0) & x["k"].isNotNull()),
            F.lit(1),
        )
        fields = F.transform(m, lambda x: x["field"])
        starts = F.transform(
            m,
            lambda x, i: F.struct(
                i.alias("i"),
                F.size(F.array_distinct(F.filter(F.slice(fields, i + 1, F.lit(WINDOW)), lambda f: f.isNotNull()))).alias("n"),
            ),
        )
        before = lambda i: F.aggregate(F.slice(m, F.lit(1), i), F.lit(0), lambda acc, x: acc + x["len"] + 1)
        cut2 = F.try_element_at(
            F.filter(starts, lambda s: (s["n"] >= MIN_FIELDS) & (before(s["i"]) > MIN_POSITION)), F.lit(1)
        )
        line = F.coalesce(cut1["i"], cut2["i"])
        return F.struct(
            T.utrim(F.when(line.isNotNull(), F.substring(v["t"], F.lit(1), before(line))).otherwise(v["t"])).alias("text"),
            F.when(cut1.isNotNull(), F.lit("explicit_separator")).when(cut2.isNotNull(), F.lit("quoted_header_block")).alias("rule"),
            F.when(cut1.isNotNull(), cut1["k"]).when(cut2.isNotNull(), F.concat(F.lit("header_block_"), cut2["n"].cast("string"), F.lit("_fields"))).alias("marker"),
            line.alias("line"),
        )

    untouched = F.struct(
        T.utrim(text).alias("text"), F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("marker"), F.lit(None).cast("int").alias("line"),
    )
    return F.when(suspicious, T.let(T.let(text, with_marks), find)).otherwise(untouched)


def body_text(messages: DataFrame, max_chars: int | None = None, open_ended: bool = True) -> DataFrame:
    """Plain text of a mail: the text body, else the stripped html body (`open_ended` as in
    `html_to_text`); quoted thread cut; optional length cap. Adds body and its facts."""
    plain = F.col("text").isNotNull() & (F.col("text") != "")
    base = F.when(plain, F.col("text")).otherwise(T.html_to_text("html", open_ended))
    used = F.when(plain, F.lit("text/plain")).when(T.is_non_empty("html"), F.lit("text/html")).otherwise(F.lit("none"))
    out = messages.withColumn("_cut", cut_thread(base)).withColumn("used_body", used)
    body = F.col("_cut")["text"]
    capped = body if max_chars is None else F.left(body, F.lit(max_chars))
    over = F.lit(False) if max_chars is None else F.length(body) > max_chars
    return out.select(
        *messages.columns, capped.alias("body"), "used_body", F.col("_cut")["rule"].alias("cut_rule"),
        F.col("_cut")["marker"].alias("cut_marker"), F.col("_cut")["line"].alias("cut_line"),
        over.alias("capped"), F.length(capped).alias("char_count"),
    )


# --------------------------------------------------------------- leave lines
def _line_flags(line: Column) -> Column:
    def flags(v):
        t, who, word, when = v["t"], v["who"], v["word"], v["when"]
        return F.struct(
            t.alias("line"),
            (who & word & when).alias("high"),
            ((who & (word | when)) | (word & when & (F.length(t) < 100))).alias("hit"),
        )

    tests = lambda t: F.struct(t.alias("t"), t.rlike(NAME_ID).alias("who"), t.rlike(LEAVE_WORD).alias("word"), t.rlike(ANY_DATE).alias("when"))
    return T.let(T.let(T.utrim(line), tests), flags)


def leave_flags(line) -> Column:
    """struct(line, high, hit) for one line of a mail."""
    return _line_flags(T.col(line))


def leave_lines(bodies: DataFrame, body: str = "body", cap: int | None = None) -> DataFrame:
    """Mails with their matched lines, kept when the notice triggers (two
    matched lines or one sure one). Lines stay arrays: no shuffle."""
    text = F.coalesce(T.col(body), F.lit(""))
    maybe = text.rlike(LEAVE_WORD + "|" + NAME_ID)
    flags = F.filter(
        F.transform(F.split(F.when(maybe, text).otherwise(F.lit("")), "\r\n|\n|\r", -1), lambda l, i: F.struct(i.alias("i"), _line_flags(l).alias("f"))),
        lambda x: x["f"]["hit"],
    )
    counted = T.let(flags, lambda m: F.struct(m.alias("matched"), F.size(m).alias("matched_count"), F.size(F.filter(m, lambda x: x["f"]["high"])).alias("high_count")))
    # A generator is never copied: the lines are looked at once, and the filter
    # stays above them.
    out = bodies.select("*", F.explode(F.filter(F.array(counted), lambda c: (c["matched_count"] >= 2) | (c["high_count"] >= 1))).alias("_c")).select("*", "_c.*").drop("_c")
    if cap is not None:
        out = out.withColumn("matched", F.slice("matched", 1, cap))
    return out


def lines_of(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per line of every text."""
    rest = [c for c in docs.columns if c != body]
    return docs.select(*rest, F.posexplode(F.split(T.col(body), "\r\n|\n|\r", -1)).alias("line_idx", "line"))


def triggered_lines(lines: DataFrame) -> DataFrame:
    """The same test on a table of lines (source_id, line_idx, line)."""
    hits = lines.withColumn("f", leave_flags("line")).filter(F.col("f")["hit"])
    counted = attach(
        hits, ["source_id"], F.count(F.lit(1)).alias("matched_count"),
        F.sum(F.when(F.col("f")["high"], 1).otherwise(0)).alias("high_count"),
    )
    return counted.filter((F.col("matched_count") >= 2) | (F.col("high_count") >= 1)).withColumn("line", F.col("f")["line"]).drop("f")


# ------------------------------------------------------------- leave records
def leave_date_of(line, sent) -> Column:
    """struct(date_text, leave_date) of a line: full Chinese date, ISO date,
    then month and day with the wide year rule."""
    tidy = lambda t: F.regexp_replace(t, r"(?<![0-9])0+(?=[0-9])", "")
    # Beside a generator aliases inside lambdas get lost, so the fields are named here.
    named = lambda **f: F.named_struct(*[x for k, v in f.items() for x in (F.lit(k), v)])

    def found(t):
        return named(cn=F.regexp_extract(t, D.CN_FULL, 0), iso=F.regexp_extract(t, D.ISO_ANY, 0), part=F.regexp_extract(t, D.CN_PART, 0))

    def dated(v):
        month = D.whole(F.regexp_extract(v["part"], D.CN_PART, 1))
        part_date = F.concat_ws(
            "-", D.year_wide(T.col(sent), month).cast("string"), F.regexp_replace(v["part"], r"^([0-9]+)月([0-9]+)日$", "$1-$2")
        ).try_cast("date")
        return named(v=v, cn=D._date_by(v["cn"], D.CN_FULL), iso=D._date_by(v["iso"], D.ISO_ANY), part=F.when(v["part"] != "", part_date))

    def first(d):
        return (
            F.when(d["cn"].isNotNull(), named(date_text=tidy(d["v"]["cn"]), leave_date=d["cn"]))
            .when(d["iso"].isNotNull(), named(date_text=d["v"]["iso"], leave_date=d["iso"]))
            .when(d["part"].isNotNull(), named(date_text=tidy(d["v"]["part"]), leave_date=d["part"]))
            .otherwise(named(date_text=F.lit(""), leave_date=F.lit(None).cast("date")))
        )

    return T.let(T.let(T.let(T.col(line), found), dated), first)


def rule_records(noticed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All name-and-id pairs of the matched lines, each with its line's date;
    the first mention of an id within a mail wins."""
    keep = ["source_id", "mail_date"] if keep is None else keep
    lines = noticed.select(*keep, F.explode("matched").alias("m")).select(
        *keep, F.col("m")["i"].alias("line_idx"), F.col("m")["f"]["line"].alias("line")
    )
    pairs = lines.filter(F.col("line").rlike(NAME_ID)).select(
        *keep, "line_idx", leave_date_of("line", "mail_date").alias("d"),
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all("line", F.lit(NAME_ID), 1).alias("name"),
                F.regexp_extract_all("line", F.lit(NAME_ID), 2).alias("id"),
            )
        ).alias("pair_idx", "p"),
    )
    rows = pairs.select(
        *keep, "line_idx", "pair_idx", F.col("p")["name"].alias("name"), F.col("p")["id"].alias("employee_id"),
        F.col("d")["date_text"].alias("leave_date_text"), D.iso(F.col("d")["leave_date"]).alias("wide_date"),
    )
    return best_per_group(rows, ["source_id", "employee_id"], [F.col("line_idx"), F.col("pair_idx")])


def normalized_leave_date(date_text, sent, as_of=None) -> Column:
    """Date text of a record to ISO: full date, else month and day with the
    narrow year rule; '' when it cannot be read. `as_of` stands in for mails
    without a date."""
    base = T.col(sent) if as_of is None else F.coalesce(T.col(sent), T.col(as_of))

    def in_year(md):
        part = F.concat_ws("-", D.year_narrow(base, md["month"]).cast("string"), md["month"].cast("string"), md["day"].cast("string")).try_cast("date")
        return F.when(md.isNotNull(), part)

    # Each text is looked at once: the rules stand in the plan over its parts.
    read = lambda t: F.coalesce(D.date_in_text(t), T.let(D.month_day_in_text(t), in_year))
    return F.coalesce(D.iso(T.let(F.coalesce(T.utrim(date_text), F.lit("")), read)), F.lit(""))


def leave_date_warning(date_text, leave_date) -> Column:
    t = F.coalesce(T.utrim(date_text), F.lit(""))
    return F.when((t != "") & (T.col(leave_date) == ""), F.concat(F.lit("leave_date: failed to parse '"), t, F.lit("'")))


def valid_reply_record(name, employee_id, leave_date) -> Column:
    """A proposed record is usable: a person's name, a digit id, an ISO date."""
    idn, d = F.coalesce(T.utrim(employee_id), F.lit("")), F.coalesce(T.utrim(leave_date), F.lit(""))
    name_ok = F.coalesce(T.utrim(name).rlike(rf"^{HAN_NAME}$"), F.lit(False))
    id_ok = (idn == "") | idn.rlike(r"^[0-9]{4,}$")
    date_ok = (d == "") | (d.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & d.try_cast("date").isNotNull())
    return name_ok & id_ok & date_ok


def validated_reply(reply: DataFrame, rule: DataFrame) -> DataFrame:
    """Usable proposed records; mails where none is usable use the rule records."""
    good = reply.filter(valid_reply_record("name", "employee_id", "leave_date"))
    back = rule.join(good.select("source_id").distinct(), "source_id", "left_anti")
    return good.withColumn("origin", F.lit("reply")).unionByName(back.withColumn("origin", F.lit("rule")), allowMissingColumns=True)


def merge_leave(reply: DataFrame, rule: DataFrame) -> DataFrame:
    """Proposed records first; a rule record only when its id is new."""
    ids = reply.filter(T.is_non_empty("employee_id")).select("source_id", T.utrim("employee_id").alias("employee_id")).distinct()
    extra = rule.filter(T.is_non_empty("employee_id")).join(ids, ["source_id", "employee_id"], "left_anti")
    return reply.unionByName(extra, allowMissingColumns=True)


def labelled_merge(asked: DataFrame, rule: DataFrame, new_only: bool = True) -> DataFrame:
    """`merge_leave` of `validated_reply`, with a provenance label: usable proposed records,
    then the rule records, of a mail with usable ones only those whose id is new (all with
    `new_only` off).

    What a mail's replies come to is one row, so the rule records meet them once."""
    usable = valid_reply_record("name", "employee_id", "leave_date")
    asked = asked.withColumn("_ok", usable)
    own = F.when(F.col("_ok") & T.is_non_empty("employee_id"), T.utrim("employee_id"))
    replied = asked.groupBy("source_id").agg(F.max("_ok").alias("_ok"), F.collect_set(own).alias("_ids"))
    met = rule.join(replied, "source_id", "left")
    new = T.is_non_empty("employee_id") & ~F.array_contains("_ids", F.col("employee_id"))
    label = F.when(F.col("_ok"), F.lit("llm_validated")).when(F.col("_ok").isNotNull(), F.lit("regex_fallback_llm_invalid")).otherwise(F.lit("regex_fallback_llm_empty"))
    kept = met.filter(~F.coalesce("_ok", F.lit(False)) | new) if new_only else met
    rest = kept.withColumn("extraction_source", label).drop("_ok", "_ids")
    good = asked.filter("_ok").drop("_ok").withColumn("extraction_source", F.lit("llm_validated"))
    return good.unionByName(rest, allowMissingColumns=True)


def leave_records(messages: DataFrame, reply: DataFrame | None = None, as_of=None, cap: int | None = None, new_only: bool = True) -> DataFrame:
    """Bodies to final leave records with a provenance label per mail (`new_only` as in
    `labelled_merge`)."""
    bodies = messages if "body" in messages.columns else body_text(messages)
    noticed = leave_lines(bodies, cap=cap)
    if reply is not None:  # read by records and replies: the lines are looked at once
        noticed = checkpointed(noticed.select("source_id", "mail_date", "matched"))
    rule = rule_records(noticed).select("source_id", "mail_date", "name", "employee_id", "leave_date_text", "line_idx", "pair_idx")
    if reply is None:
        merged = rule.withColumn("extraction_source", F.lit("regex_fallback_llm_empty"))
    else:
        merged = labelled_merge(reply.join(noticed.select("source_id", "mail_date"), "source_id"), rule, new_only)
    final = normalized_leave_date("leave_date_text", "mail_date", as_of)
    return merged.withColumn("leave_date", final).withColumn("intent", F.lit("remove")).withColumn(
        "warning", leave_date_warning("leave_date_text", "leave_date")
    )


def reply_lines(noticed: DataFrame, cap: int | None = None) -> DataFrame:
    """The matched lines of a mail as the text a reviewer or model is given."""
    m = F.col("matched") if cap is None else F.slice("matched", 1, cap)
    return noticed.select("source_id", F.array_join(F.transform(m, lambda x: x["f"]["line"]), "\n").alias("snippet"))
