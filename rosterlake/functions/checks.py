"""Validators and value scores as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import is_date_like, record_date
from .text import col, utrim

HAN = r"[一-鿿]"


def _full(c, pattern: str) -> Column:
    return F.coalesce(utrim(c).rlike(pattern), F.lit(False))


def is_person_name(c) -> Column:
    return _full(c, rf"^{HAN}{{2,4}}$")


def is_national_id(c) -> Column:
    return _full(c, r"^[0-9]{15}$|^[0-9]{17}[0-9Xx]$")


def is_id_number(c) -> Column:
    """Blank is accepted; else a national id or at least four digits."""
    return F.coalesce(col(c) == "", F.lit(True)) | _full(c, r"^[0-9]{15}$|^[0-9]{17}[0-9Xx]$|^[0-9]{4,}$")


def is_fee_month(c) -> Column:
    return _full(c, r"^[0-9]{6}$|^[0-9]{4}-[0-9]{2}$")


def is_declare_type(c) -> Column:
    return F.coalesce(utrim(c).isin("增", "减"), F.lit(False))


def is_digits(c) -> Column:
    return _full(c, r"^[0-9]+$")


def is_gender(c) -> Column:
    return F.coalesce(F.lower(utrim(c)).isin("男", "女", "male", "female", "m", "f", "1", "2"), F.lit(False))


def is_boolean_check(c) -> Column:
    return F.coalesce(
        F.lower(utrim(c)).isin("true", "false", "是", "否", "通过", "不通过", "y", "n", "yes", "no", "1", "0"),
        F.lit(False),
    )


def name_score(c) -> Column:
    v = utrim(c)
    return (
        F.when(v.isNull() | (v == ""), F.lit(0.0))
        .when(is_digits(v) | is_date_like(v) | is_gender(v), F.lit(0.0))
        .when(is_person_name(v), F.lit(1.0))
        .when(v.rlike(rf"^{HAN}{{1,6}}$"), F.lit(0.7))
        .when(v.rlike(r"^[A-Za-z\s]+$") & (F.length(v) >= 2), F.lit(0.5))
        .otherwise(F.lit(0.1))
    )


def id_score(c) -> Column:
    v = utrim(c)
    return (
        F.when(v.isNull() | (v == ""), F.lit(0.0))
        .when(is_national_id(v), F.lit(1.0))
        .when(v.rlike(r"^[0-9]{6,14}$"), F.lit(0.7))
        .when(v.rlike(r"^[0-9]{4,}$"), F.lit(0.5))
        .when(is_person_name(v), F.lit(0.0))
        .otherwise(F.lit(0.1))
    )


def date_score(c) -> Column:
    return F.when(is_date_like(c) | record_date(c).isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))


SCORES = {"name": name_score, "id": id_score, "date": date_score}

#: Whether a trimmed text's score is 0.5 or more, in a look or two instead of one a grade.
LOOKS = {
    "name": lambda v: v.rlike(rf"^{HAN}{{1,6}}$|^[A-Za-z\s]{{2,}}$") & ~is_gender(v),
    "id": lambda v: v.rlike(r"^[0-9]{4,}$|^[0-9]{17}[0-9Xx]$"),
    "date": lambda v: is_date_like(v) | record_date(v).isNotNull(),
}


def row_errors(name, id_number, declare_type, fee_month, expected) -> Column:
    """Why a form row is not acceptable; an empty array means it is."""
    name, idn = F.coalesce(col(name), F.lit("")), F.coalesce(col(id_number), F.lit(""))
    decl, fee = F.coalesce(col(declare_type), F.lit("")), F.coalesce(col(fee_month), F.lit(""))
    name_error = (
        F.when(name == "", F.lit("name_empty"))
        .when(is_digits(name), F.concat(F.lit("name_is_digits:"), name))
        .when(~is_person_name(name) & ~name.rlike(rf"^{HAN}+"), F.concat(F.lit("name_not_chinese_like:"), name))
    )
    id_error = F.when(
        idn != "",
        F.when(is_person_name(idn), F.concat(F.lit("id_looks_like_name:"), idn)).when(
            is_date_like(idn), F.concat(F.lit("id_looks_like_date:"), idn)
        ),
    )
    decl_errors = [
        F.when(decl != expected, F.concat(F.lit("declare_type_not_constant:"), decl)),
        F.when((decl != "") & ~decl.isin("增", "减"), F.concat(F.lit("declare_type_invalid:"), decl)),
    ]
    fee_error = (
        F.when(fee == "", F.lit("fee_month_empty"))
        .when(is_date_like(fee), F.concat(F.lit("fee_month_is_raw_date:"), fee))
        .when(~is_fee_month(fee), F.concat(F.lit("fee_month_invalid_format:"), fee))
    )
    return F.filter(F.array(name_error, id_error, *decl_errors, fee_error), lambda e: e.isNotNull())


def final_guard(name, id_number) -> Column:
    """struct(rejected, id_number, warning) for the last check before writing:
    impossible names reject the row, impossible ids are blanked."""
    name, idn = col(name), F.coalesce(col(id_number), F.lit(""))
    reject = (
        F.when(is_digits(name), F.lit("validation_rejected_name_is_digits"))
        .when(is_date_like(name), F.lit("validation_rejected_name_is_date"))
        .when(is_gender(name), F.lit("validation_rejected_name_is_gender"))
    )
    blank = F.when(
        idn != "",
        F.when(is_person_name(idn), F.lit("validation_rejected_id_is_name"))
        .when(is_date_like(idn), F.lit("validation_rejected_id_is_date"))
        .when(is_gender(idn), F.lit("validation_rejected_id_is_gender")),
    )
    return F.struct(
        reject.isNotNull().alias("rejected"),
        F.when(blank.isNotNull(), F.lit("")).otherwise(idn).alias("id_number"),
        F.coalesce(reject, blank).alias("warning"),
    )
