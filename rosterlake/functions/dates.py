"""Lenient dates, months and typed cells as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, col, contains_any, let, none_if_blank, utrim


def _date_by(c, pattern: str, order: str = "$1-$2-$3") -> Column:
    """Date from the first match of a pattern; null when there is no match or
    the parts are no calendar date. Reads its input once, so nested layouts
    stay small enough for code generation."""
    hit = F.regexp_extract(c, pattern, 0)
    return F.regexp_replace(hit, pattern, order).try_cast("date")


def whole(digits: Column) -> Column:
    """Number of a text of digits, null for ''. The empty text is kept from the cast: one
    that fails costs an exception a row."""
    return F.when(digits != "", digits).try_cast("int")


def serial_date(n) -> Column:
    """Spreadsheet day number 1..60000 to a date."""
    n = col(n).cast("double")
    return F.when(n.between(1, 60000), F.date_add(F.make_date(F.lit(1899), F.lit(12), F.lit(30)), F.floor(n).cast("int")))


_YM_ONLY = r"^([1-9][0-9]{3})[./-]([0-9]{1,2})$"
_YMD_ONLY = r"^([1-9][0-9]{3})[./-]([0-9]{1,2})[./-]([0-9]{1,2})$"
_CN_MONTH = rf"^([1-9][0-9]{{3}}){WS}*年{WS}*([0-9]{{1,2}}){WS}*月$"
_CN_DAY = rf"^([1-9][0-9]{{3}}){WS}*年{WS}*([0-9]{{1,2}}){WS}*月{WS}*([0-9]{{1,2}}){WS}*日$"


def normalize_value(text, raw_type=None, serial=None) -> Column:
    """Cell text to record text: dates to ISO, day numbers to dates when the
    `serial` flag of the row says so, everything else trimmed."""
    return trimmed_value(F.coalesce(utrim(text), F.lit("")), raw_type, serial)


def trimmed_value(t: Column, raw_type=None, serial=None) -> Column:
    """`normalize_value` of a text that is trimmed; null stays null."""
    parsed = [
        _date_by(t, _YM_ONLY, "$1-$2-1"),
        _date_by(t, _YMD_ONLY),
        _date_by(t, _CN_MONTH, "$1-$2-1"),
        _date_by(t, _CN_DAY),
    ]
    if raw_type is not None:
        kind = col(raw_type)
        parsed.insert(0, F.when(kind.isin("timestamp", "date"), F.substring(t, 1, 10).try_cast("date")))
    if serial is not None:
        number = t.rlike(r"^[0-9]+$")
        if raw_type is not None:
            number = number | (col(raw_type) == "number") & t.rlike(r"^[0-9]+(\.[0-9]+)?$")
        parsed.append(F.when(number & col(serial), serial_date(t.try_cast("double"))))
    return F.coalesce(F.date_format(F.coalesce(*parsed), "yyyy-MM-dd"), t)


def month_start(text) -> Column:
    t = utrim(text)
    return F.coalesce(
        _date_by(t, r"^([1-9][0-9]{3})[./-]([0-9]{1,2})(?:[./-][0-9]{1,2})?$", "$1-$2-1"),
        _date_by(t, rf"^([1-9][0-9]{{3}}){WS}*年{WS}*([0-9]{{1,2}}){WS}*月?$", "$1-$2-1"),
    )


# ----------------------------------------------------------- dates in mail text
CN_FULL = r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日"
ISO_ANY = r"([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})"
COMPACT = r"([0-9]{4})([0-9]{2})([0-9]{2})"
CN_PART = r"([0-9]{1,2})月([0-9]{1,2})日"


def date_in_text(text) -> Column:
    """First full date found anywhere in the text."""
    t = col(text)
    return F.coalesce(_date_by(t, CN_FULL), _date_by(t, ISO_ANY), _date_by(t, COMPACT))


def month_day_in_text(text) -> Column:
    """`M月D日` to struct(month, day), range checked."""
    t = col(text)
    m = whole(F.regexp_extract(t, CN_PART, 1))
    d = whole(F.regexp_extract(t, CN_PART, 2))
    return F.when(m.between(1, 12) & d.between(1, 31), F.named_struct(F.lit("month"), m, F.lit("day"), d))


def year_narrow(sent, month) -> Column:
    """Mail year; December mail about January means next year."""
    return F.year(sent) + F.when((F.month(sent) == 12) & (col(month) == 1), 1).otherwise(0)


def year_wide(sent, month, as_of=None) -> Column:
    """Mail year; last-quarter mail about January or February means next year."""
    base = F.year(sent) + F.when((F.month(sent) >= 10) & (col(month) <= 2), 1).otherwise(0)
    return base if as_of is None else F.coalesce(base, F.year(col(as_of)))


def iso(d) -> Column:
    return F.date_format(col(d), "yyyy-MM-dd")


# Month names of mail headers.
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def mail_header_date(text) -> Column:
    """Date of a mail header: `4 Nov 2025 ...` anywhere, else an ISO date."""
    t = col(text)
    named = rf"([0-9]{{1,2}})\s+({'|'.join(_MONTHS)})\s+([0-9]{{4}})"
    hit = F.regexp_extract(t, named, 0)
    for i, name in enumerate(_MONTHS, 1):
        hit = F.replace(hit, F.lit(name), F.lit(str(i)))
    return F.coalesce(_date_by(hit, r"^([0-9]{1,2})\s+([0-9]{1,2})\s+([0-9]{4})$", "$3-$2-$1"), _date_by(t, ISO_ANY))


# ------------------------------------------------------------- record dates
_ISO_STAMP = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:.([01][0-9]|2[0-3])(?::[0-5][0-9](?::[0-5][0-9](?:[.,][0-9]+)?)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2}(?::?[0-9]{2})?)?)?$"
_COMPACT_STAMP = r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:.([01][0-9]|2[0-3])(?:[0-5][0-9](?:[0-5][0-9](?:[.,][0-9]+)?)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
_WEEK = r"^([0-9]{4})-?W([0-9]{2})(?:-?([1-7]))?$"
_LOOSE = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$"


def _week_date(t: Column) -> Column:
    """ISO week date; only evaluated for texts holding a W."""
    jan4 = _date_by(t, _WEEK, "$1-1-4")
    week = F.regexp_extract(t, _WEEK, 2).try_cast("int")
    day = F.coalesce(F.regexp_extract(t, _WEEK, 3).try_cast("int"), F.lit(1))
    monday = F.date_add(F.date_sub(jan4, F.weekday(jan4)), (week - 1) * 7)
    ok = (week >= 1) & (F.year(F.date_add(monday, 3)) == F.year(jan4))
    return F.when(F.contains(t, F.lit("W")), F.when(ok, F.date_add(monday, day - 1)))


#: How every text begins that one of the layouts takes: others are left after one look.
_DATED = r"^[0-9]{4}(?:[-/][0-9]|[0-9]{4}|-?W)"


def record_date(text) -> Column:
    """ISO date or date-time, week date, `Y-M-D`, `Y/M/D` or `YYYYMMDD`."""
    t = utrim(text)
    read = F.coalesce(_date_by(t, _ISO_STAMP), _date_by(t, _LOOSE), _date_by(t, _COMPACT_STAMP), _week_date(t))
    return F.when(t.rlike(_DATED), read)


def record_date_of_number(n) -> Column:
    return record_date(F.floor(col(n)).cast("string"))


# ---------------------------------------------------------------- year-months
_YM = (
    r"^([0-9]{4})[-/]([0-9]{1,2})[-/][0-9]{1,2}",
    r"^([0-9]{4})[-/]([0-9]{1,2})$",
    r"^([0-9]{4})年([0-9]{1,2})月$",
    r"^([0-9]{4})([0-9]{2})[0-9]{2}$",
    r"^([0-9]{4})([0-9]{2})$",
)


def year_month(text) -> Column:
    """First day of the month from five layouts; null when the month is wrong."""
    t = utrim(text)
    return F.coalesce(*[_date_by(t, p, "$1-$2-1") for p in _YM])


def year_month_loose(text) -> Column:
    """`20YY[年-./]MM` anywhere in the text (file names, remarks)."""
    return _date_by(col(text), r"(20[0-9]{2})[年\-./]?([0-9]{1,2})", "$1-$2-1")


def format_year_month(month, fmt) -> Column:
    """Month date in YYYYMM, YYYY/MM, YYYY年MM月 or (default) YYYY-MM."""
    month = col(month)
    if isinstance(fmt, str):
        layout = {"YYYYMM": "yyyyMM", "YYYY/MM": "yyyy/MM", "YYYY年MM月": "yyyy年MM月"}.get(fmt, "yyyy-MM")
        return F.date_format(month, layout)
    return (
        F.when(fmt == "YYYYMM", F.date_format(month, "yyyyMM"))
        .when(fmt == "YYYY/MM", F.date_format(month, "yyyy/MM"))
        .when(fmt == "YYYY年MM月", F.date_format(month, "yyyy年MM月"))
        .otherwise(F.date_format(month, "yyyy-MM"))
    )


def year_month_style(text) -> Column:
    """The year-month style a sample value is written in, or null."""
    t = utrim(text)
    return (
        F.when(F.contains(t, F.lit("年")) & F.contains(t, F.lit("月")), F.lit("YYYY年MM月"))
        .when(F.contains(t, F.lit("/")), F.lit("YYYY/MM"))
        .when(F.contains(t, F.lit("-")), F.lit("YYYY-MM"))
        .when(t.rlike(r"^[0-9]{6}$"), F.lit("YYYYMM"))
    )


def next_month(d, fmt="YYYYMM") -> Column:
    """The fee month rule: the month after the event's month."""
    nxt = F.add_months(F.trunc(col(d), "MM"), 1)
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    return F.when(fmt == "YYYY-MM", F.date_format(nxt, "yyyy-MM")).otherwise(F.date_format(nxt, "yyyyMM"))


# ------------------------------------------------------------- cell values
def form_timestamp(text) -> Column:
    """Date-time for a form cell: ISO, then Chinese, then the fixed layouts,
    day-first before month-first. Zone marks are read past, not applied."""
    t = utrim(text)
    stamp = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})T([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2}(?:\.[0-9]{1,6})?)$"
    iso_time = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}).((?:[01][0-9]|2[0-3])(?::[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?)?)(?:Z|[+-][0-9]{2}:?[0-9]{2})?$"
    hour = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}.[0-9]{2})$"
    timed = F.regexp_replace(F.regexp_extract(t, iso_time, 0), iso_time, "$1 $2")
    timed = F.regexp_replace(timed, hour, "$1:00").try_cast("timestamp_ntz")
    loose = F.regexp_replace(F.regexp_extract(t, stamp, 0), stamp, "$1-$2-$3 $4:$5:$6").try_cast("timestamp_ntz")
    slash = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    day = F.coalesce(
        _date_by(t, r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"),
        _date_by(t, r"^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})[日号]?$"),
        _date_by(t, r"^([0-9]{4})[/.]([0-9]{1,2})[/.]([0-9]{1,2})$"),
        _date_by(t, slash, "$3-$2-$1"),
        _date_by(t, slash, "$3-$1-$2"),
        _date_by(t, r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})$", "$3-$2-$1"),
        _date_by(t, r"^([0-9]{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12][0-9]|0[1-9]|[1-9])$"),
        _week_date(t),
    )
    return F.coalesce(timed, loose, day.cast("timestamp_ntz"))


def looks_like_date(text) -> Column:
    t = utrim(text)
    return F.coalesce(
        t.rlike(
            r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
            r"|^[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}[日号]?$"
            r"|^[0-9]{1,4}/[0-9]{1,2}/[0-9]{1,4}$"
            r"|^[0-9]{4}\.[0-9]{2}\.[0-9]{2}$"
            r"|^[0-9]{8}$"
        ),
        F.lit(False),
    )


def is_date_format(fmt) -> Column:
    """A number format holding any of d, m, y, h, s in either case."""
    return F.coalesce(col(fmt).rlike(r"[dmyhsDMYHS]"), F.lit(False))


def is_iso_date(text) -> Column:
    return F.coalesce(
        utrim(text).rlike(
            r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
        ),
        F.lit(False),
    )


def is_date_like(text) -> Column:
    """Date-shaped record value (used to keep dates out of names and ids)."""
    return F.coalesce(
        utrim(text).rlike(
            r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$|^[0-9]{8}$"
            r"|^[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日$|^[0-9]{1,2}月[0-9]{1,2}日$"
        ),
        F.lit(False),
    )


def typed_cell(text, number_format=None) -> Column:
    """struct(kind, l, d, ts, s): long ids and phones stay text, dates by
    format or look, integers and decimals with separators removed."""
    fmt = F.lit("") if number_format is None else F.replace(col(number_format), F.lit("General"), F.lit(""))
    number = r"^[+-]?[0-9]+(?:_[0-9]+)*$"

    def read(t):
        keep = t.rlike(r"^[0-9]{11,}$|^[0-9]{14,}[Xx]$")
        as_date = is_date_format(fmt) | looks_like_date(t)
        bare = F.translate(t, ", ", "")
        return F.struct(
            t.alias("t"),
            (~keep & as_date).alias("as_date"),
            F.when(~keep & as_date, form_timestamp(t)).alias("ts"),
            F.when(~keep & ~as_date, F.regexp_extract(bare, r"^[+-]?[0-9]+\.[0-9]+$", 0).try_cast("double")).alias("d"),
            F.when(~keep & ~as_date, F.translate(F.regexp_extract(bare, number, 0), "_", "").try_cast("bigint")).alias("l"),
        )

    def shape(v):
        kind = (
            F.when(F.coalesce(v["t"] == "", F.lit(True)), F.lit("empty"))
            .when(v["ts"].isNotNull(), F.lit("date"))
            .when(v["d"].isNotNull(), F.lit("double"))
            .when(v["l"].isNotNull(), F.lit("long"))
            .otherwise(F.lit("text"))
        )
        return F.struct(
            kind.alias("kind"), v["l"].alias("l"), v["d"].alias("d"), v["ts"].alias("ts"),
            F.when(kind == "text", v["t"]).alias("s"),
        )

    return let(let(utrim(text), read), shape)


def month_from_date(rec, keys, fmt) -> Column:
    """Derived field: first non-blank of the keys, as a year-month."""
    value = F.coalesce(*[none_if_blank(F.try_element_at(col(rec), F.lit(k))) for k in keys])
    return F.coalesce(format_year_month(year_month(value), fmt), F.lit(""))


def has_date_word(c) -> Column:
    return contains_any(c, ["日期", "时间"])
