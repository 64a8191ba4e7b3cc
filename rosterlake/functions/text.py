"""Text, header and record-value scalars as Column expressions.

Everything runs inside the JVM; the only Python function is the optional full
NFKC fold, which Spark has no built-in for.
"""
from __future__ import annotations

import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WS_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` (a one-element transform).

    Catalyst inlines a Column wherever it is mentioned; for a costly value used
    in several conditional branches this keeps the expression, and the work,
    single."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utrim(c) -> Column:
    """Trim all Unicode whitespace from both ends (no regex, ends only)."""
    return F.trim(col(c), F.lit(WS_CHARS))


def none_if_blank(c) -> Column:
    return F.nullif(utrim(c), F.lit(""))


def is_empty(c) -> Column:
    return F.coalesce(utrim(c) == "", F.lit(True))


def is_non_empty(c) -> Column:
    return ~is_empty(c)


def contains_any(c, words) -> Column:
    """True when any of a short fixed list of words occurs in the text."""
    words = list(words)
    if not words:
        return F.lit(False)
    return F.coalesce(col(c).rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def cell_text(raw, raw_type=None) -> Column:
    """Cell to text: trimmed; nan/none/nat blank unless typed as a string;
    date-time values keep second precision with a blank between the parts."""
    text = F.coalesce(utrim(raw), F.lit(""))
    if raw_type is None:
        return text
    kind = F.coalesce(col(raw_type), F.lit("string"))
    stamp = F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd HH:mm:ss")
    return (
        F.when(kind == "string", text)
        .when(kind == "timestamp", F.coalesce(stamp, text))
        .when(F.lower(text).isin("nan", "none", "nat"), F.lit(""))
        .otherwise(text)
    )


# ---------------------------------------------------------------- headers
def header_compact(c) -> Column:
    """Drop bracketed notes, whitespace and separators; lower case."""
    no_ascii = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\([^)]*\)", "")
    no_wide = F.regexp_replace(no_ascii, r"（[^）]*）", "")
    return _squeeze_header(no_wide)


def header_flat(c) -> Column:
    """`header_compact` without dropping the bracketed notes."""
    return _squeeze_header(F.coalesce(col(c), F.lit("")))


def _squeeze_header(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?:" + WS + r"|[，,。.:：;；/／\\\-_|])+", ""))


def header_semantic(c) -> Column:
    return F.replace(header_compact(c), F.lit("参加保险情况养老"), F.lit("参加保险情况"))


def match_text(c) -> Column:
    """Width fold, lower case, drop whitespace, `_`, `-` and `/`."""
    half = F.translate(F.coalesce(col(c), F.lit("")), _FULL_WIDTH, _HALF_WIDTH)
    return F.regexp_replace(F.lower(half), r"(?:" + WS + r"|[_\-/])+", "")


def nfkc(c) -> Column:
    """Full compatibility fold, for texts `match_text` does not cover."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return fold(col(c))


def fold_text(c) -> Column:
    return utrim(F.translate(F.lower(col(c)), " _-", ""))


def fold_profile(c) -> Column:
    return F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "\u3000 /\\", "")


def fold_record_key(c) -> Column:
    """`fold_profile` without underscores, in one pass over the text."""
    return F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "\u3000 /\\_", "")


def header_variants(c) -> Column:
    """Folded full path, then each folded level, distinct, blanks dropped."""
    parts = F.transform(F.split(col(c), "/"), match_text)
    full = F.array(match_text(c))
    both = F.when(F.contains(col(c), F.lit("/")), F.concat(full, parts)).otherwise(full)
    return F.coalesce(F.filter(F.array_distinct(both), lambda v: v != ""), F.array().cast("array<string>"))


def header_path(h1, h2, fallback) -> Column:
    a, b = none_if_blank(h1), none_if_blank(h2)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" / "), b)).otherwise(
        F.coalesce(a, b, col(fallback))
    )


def alnum_fold(c) -> Column:
    """Lower case with everything but letters and digits removed."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"(?U)[\s\W_]+", "")


def group_tag(*cols) -> Column:
    """hf / ss / med / '' from one or more header texts."""
    merged = header_compact(F.concat_ws(" ", *[col(c) for c in cols]))
    return (
        F.when(F.contains(merged, F.lit("公积")), F.lit("hf"))
        .when(contains_any(merged, ["社保", "社会保险"]), F.lit("ss"))
        .when(contains_any(merged, ["医保", "医疗"]), F.lit("med"))
        .otherwise(F.lit(""))
    )


def section_tag(c) -> Column:
    n = fold_profile(c)
    return (
        F.when(F.contains(n, F.lit("公积")), F.lit("housing_fund"))
        .when(contains_any(n, ["社保", "社会保险"]), F.lit("social_security"))
        .otherwise(F.lit("unknown"))
    )


def fund_tag(c) -> Column:
    return F.when(F.contains(col(c), F.lit("公积")), F.lit("gj")).otherwise(F.lit("ss"))


# ------------------------------------------------------------ cell addresses
def col_letter(n) -> Column:
    """1-based column number to letters, up to three letters."""
    n = col(n).cast("int")
    ch = lambda v: F.char(v + F.lit(65))
    two, three = n - 27, n - 703
    return (
        F.when(n <= 26, ch(n - 1))
        .when(n <= 702, F.concat(ch(F.floor(two / 26)), ch(two % 26)))
        .otherwise(
            F.concat(ch(F.floor(three / 676)), ch(F.floor(three / 26) % 26), ch(three % 26))
        )
    )


def col_number(letters) -> Column:
    """Column letters to a 1-based number."""
    chars = F.split(F.upper(utrim(letters)), "")
    return F.aggregate(
        F.filter(chars, lambda x: x != ""), F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64
    )


def cell_ref(ref) -> Column:
    """`B12` to struct(col, row); null when it is not an A1 reference."""
    up = F.upper(utrim(ref))
    ok = up.rlike(r"^[A-Z]+[0-9]+$")
    return F.when(
        ok,
        F.struct(
            col_number(F.regexp_extract(up, r"^([A-Z]+)", 1)).alias("col"),
            F.regexp_extract(up, r"([0-9]+)$", 1).try_cast("int").alias("row"),
        ),
    )


# ------------------------------------------------------------------- html
# What character references 128..159 stand for in HTML.
_C1 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
# Frequent names, looked up before the full table.
_COMMON = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\xa0", "copy": "©", "middot": "·"}
_REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_CLOSED = r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[^\t\n\f <&#;]{1,32};)"


def _entity_map() -> Column:
    """All named references as one foldable map, taken from the standard table."""
    packed = "\x01".join(f"{name}\x02{value}" for name, value in sorted(html5.items()))
    return F.str_to_map(F.lit(packed), F.lit("\x01"), F.lit("\x02"))


def _code_point(digits: Column, base: int) -> Column:
    n = F.conv(digits, base, 10).try_cast("bigint")
    wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    c1 = F.substring(F.lit(_C1), (n - 127).cast("int"), F.lit(1))
    bad = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    dropped = (
        n.between(1, 8) | n.between(0xE, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF)
        | (n == 0xB) | ((n % 65536) >= 65534)
    )
    return (
        F.when(bad, F.lit("�"))
        .when(n == 13, F.lit("\r"))
        .when(n.between(0x80, 0x9F), c1)
        .when(dropped, F.lit(""))
        .otherwise(wide)
    )


def _named(name: Column, table: Column) -> Column:
    """Longest known prefix of the name, else the text unchanged."""
    exact = F.try_element_at(table, name)
    cuts = F.filter(
        F.transform(F.sequence(F.length(name) - 1, F.lit(2), F.lit(-1)), lambda n: F.substring(name, F.lit(1), n)),
        lambda p: F.try_element_at(table, p).isNotNull(),
    )
    cut = F.try_element_at(cuts, F.lit(1))
    by_prefix = F.when(
        F.length(name) > 2,
        F.concat(F.try_element_at(table, cut), F.substring(name, F.length(cut) + 1, F.length(name))),
    )
    return F.coalesce(exact, by_prefix, F.concat(F.lit("&"), name))


def unescape(c, open_ended: bool = True) -> Column:
    """Resolve HTML character references in one left-to-right pass. Without `open_ended`
    a reference that no semicolon ends stays as it is."""
    text, reference = col(c), _REFERENCE if open_ended else _CLOSED
    table = _entity_map()

    def one(ref):
        bare = F.rtrim(ref, F.lit(";"))
        common = F.lit(None).cast("string")
        for name, value in _COMMON.items():
            common = F.when(ref == name + ";", F.lit(value)).otherwise(common)
        return (
            F.when(common.isNotNull(), common)
            .when(F.lower(F.substring(ref, 1, 2)) == "#x", _code_point(F.substring(bare, F.lit(3), F.length(bare)), 16))
            .when(F.startswith(ref, F.lit("#")), _code_point(F.substring(bare, F.lit(2), F.length(bare)), 10))
            .otherwise(_named(ref, table))
        )

    found = F.transform(F.regexp_extract_all(text, F.lit(reference), 1), one)
    plain = F.split(text, reference, -1)
    joined = F.array_join(
        F.zip_with(plain, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def html_to_text(c, open_ended: bool = True) -> Column:
    """Scripts and styles out, br and /p to line ends, tags to blanks,
    references resolved (see `unescape`), runs of blanks and line ends shortened."""
    t = F.coalesce(col(c), F.lit(""))
    t = F.regexp_replace(t, r"(?i)<\s*script[^>]*>[\s\S]*?<\s*/\s*script\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<\s*style[^>]*>[\s\S]*?<\s*/\s*style\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<\s*br\s*/?\s*>|</\s*p\s*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = unescape(t, open_ended)
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return utrim(t)


def inline_image_ids(html) -> Column:
    """Distinct `cid:` targets of img tags, in order."""
    pattern = r"""(?i)<img[^>]+src=["']cid:([^"']+)["']"""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(pattern), 1))


# --------------------------------------------------------------- addresses
def address(c) -> Column:
    """`Name <box@host>` to struct(name, email); comment form understood."""
    t = utrim(c)
    angled = F.contains(t, F.lit("<"))
    name = F.when(angled, F.regexp_extract(t, r"^([^<]*)<", 1)).otherwise(
        F.regexp_extract(t, r"\(([^)]*)\)", 1)
    )
    email = F.when(angled, F.regexp_extract(t, r"<([^>]*)>?", 1)).otherwise(
        F.regexp_replace(t, r"\([^)]*\)", "")
    )
    return F.struct(
        F.trim(utrim(name), F.lit('"')).alias("name"), utrim(email).alias("email")
    )


def address_list(c) -> Column:
    """Comma-separated recipients; entries without an address are dropped."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), address), lambda a: a["email"] != "")


# ------------------------------------------------------------ record values
def rec_value(rec, key) -> Column:
    """Exact key, else a `.`/`/` path into JSON held by the first level."""
    rec = col(rec)
    exact = F.try_element_at(rec, F.lit(key))
    parts = [p for p in key.replace("/", ".").split(".") if p]
    if len(parts) < 2:
        return exact
    path = "$" + "".join(f"['{p}']" for p in parts[1:])
    nested = F.get_json_object(F.try_element_at(rec, F.lit(parts[0])), path)
    return F.when(F.map_contains_key(rec, F.lit(key)), exact).otherwise(nested)


def first_entry(rec, predicate) -> Column:
    """Value of the first map entry whose key satisfies the predicate."""
    hit = F.filter(F.map_entries(col(rec)), lambda e: predicate(e["key"]))
    return F.try_element_at(hit, F.lit(1))["value"]


def rec_value_ci(rec, key) -> Column:
    """Exact key, else the first key equal in lower case; blank is null."""
    rec, k = col(rec), F.lit(key) if isinstance(key, str) else key
    return none_if_blank(
        F.when(F.try_element_at(rec, k).isNotNull(), F.try_element_at(rec, k)).otherwise(
            first_entry(rec, lambda x: F.lower(x) == F.lower(k))
        )
    )


def rec_value_folded(rec, key) -> Column:
    """`rec_value_ci`, else the first key equal after `fold_record_key`."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(
        rec_value_ci(rec, k),
        none_if_blank(first_entry(rec, lambda x: fold_record_key(x) == fold_record_key(k))),
    )


def _rekeyed(rec: Column, fold) -> Column:
    """The record under folded keys; of keys folding alike the first stays."""

    def build(ks):
        first = F.filter(F.sequence(F.lit(0), F.size(ks) - 1), lambda i: F.array_position(ks, F.element_at(ks, i + 1)) == i + 1)
        pick = lambda arr: F.transform(first, lambda i: F.element_at(arr, i + 1))
        distinct = F.size(F.array_distinct(ks)) == F.size(ks)
        built = F.when(distinct, F.map_from_arrays(ks, F.map_values(rec))).otherwise(F.map_from_arrays(pick(ks), pick(F.map_values(rec))))
        # A record whose keys are folded already is its own lookup.
        return F.when(F.size(ks) > 0, F.when(ks == F.map_keys(rec), rec).otherwise(built))

    return let(F.transform(F.map_keys(rec), fold), build)


def with_lookup(df):
    """Add the record under lower-case and folded keys, so that looking up many
    candidate keys per record costs one fold of its keys."""
    rec = F.col("rec")
    return df.withColumn("_lower", _rekeyed(rec, F.lower)).withColumn("_folded", _rekeyed(rec, fold_record_key))


def get_ci(key) -> Column:
    """`rec_value_ci` on a frame with `with_lookup`."""
    k = F.lit(key) if isinstance(key, str) else key
    return none_if_blank(F.coalesce(F.try_element_at("rec", k), F.try_element_at("_lower", F.lower(k))))


def get_folded(key) -> Column:
    """`rec_value_folded` on a frame with `with_lookup`."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(get_ci(k), none_if_blank(F.try_element_at("_folded", fold_record_key(k))))


def found_values(keys, folded: bool = False) -> Column:
    """array of struct(i, v): candidate keys with a value that is not blank, in their order,
    each looked up as `get_ci` or, `folded`, as `get_folded` does, on a frame `with_lookup`.

    The candidates are one constant array: the plan holds one lookup however many there are,
    and only keys that the record has at all, in any spelling, are looked up."""
    cands = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lower(F.lit(k)).alias("low"), fold_record_key(F.lit(k)).alias("fold")) for i, k in enumerate(keys)])

    def value(c):
        tried = [F.coalesce(F.try_element_at("rec", c["k"]), F.try_element_at("_lower", c["low"]))]
        tried += [F.try_element_at("_folded", c["fold"])] if folded else []
        # Each is trimmed once: nullif would stand in the lambda with its text twice.
        return F.try_element_at(F.filter(F.array(*[utrim(v) for v in tried]), lambda v: v != ""), F.lit(1))

    present = F.filter(cands, lambda c: F.coalesce(F.map_contains_key(F.col("_folded"), c["fold"]), F.lit(False)))
    found = F.filter(F.transform(present, lambda c: F.struct(c["i"].alias("i"), value(c).alias("v"))), lambda x: x["v"].isNotNull())
    # Records with none of the candidates are told by one look at their keys.
    some = F.arrays_overlap(F.map_keys("_folded"), F.array(*[fold_record_key(F.lit(k)) for k in keys]))
    return F.when(some, found).otherwise(F.array().cast("array<struct<i:int,v:string>>"))


def stringify_record(rec) -> Column:
    """Blank keys dropped, nulls to ''. Nested values arrive as JSON text."""
    kept = F.map_filter(col(rec), lambda k, v: is_non_empty(k))
    return F.transform_values(kept, lambda k, v: F.coalesce(v, F.lit("")))


def first_fields(rec, n: int) -> Column:
    return F.map_from_entries(F.slice(F.map_entries(col(rec)), 1, n))


def filled_count(rec) -> Column:
    """How many values of the record are not blank."""
    return F.size(F.filter(F.map_values(col(rec)), is_non_empty))


def is_json_scalar(c) -> Column:
    """JSON text that is neither an object nor an array (null included)."""
    return F.coalesce(~F.substring(utrim(c), 1, 1).isin("{", "["), F.lit(True))


def sha256(c) -> Column:
    return F.sha2(col(c), 256)
