"""Secret scans in DataFrame functions only.

Fixed patterns give the base spans. Other candidate strings are judged by the
Shannon entropy of a window that slides over them: counts of characters change by
the one that enters and the one that leaves, and with them the sum of c*log2(c),
so a candidate costs one pass. Known harmless shapes suppress a candidate."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Fixed pattern; its group is the value.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharacterClass:
    """Strings of one alphabet: window length and the entropy (bits a character)
    that some window must exceed."""

    name: str
    pattern: str
    window: int
    bits: float


#: Hexadecimal text can reach 4 bits, base64 6; prose stays well below both marks.
CLASSES = (
    CharacterClass("hex", r"(?<![A-Za-z0-9])(?:[0-9a-f]{20,}+|[0-9A-F]{20,}+)(?![A-Za-z0-9])", 20, 3.0),
    CharacterClass("base64", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}", 20, 3.8),
)
#: Candidates that are no secrets: UUIDs, paths and names in words, runs in alphabetical order.
ALLOWED = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"/?(?:[A-Za-z]+[-_/])+[A-Za-z]*[0-9]{0,4}",
    r"(?i).*(?:0123456789|abcdefghij|example|xxxxxx|deadbeef).*",
)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost, non-overlapping matches,
    in code points: what lies between matches gives their places."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), found.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, value: string>>").alias("out"))

    def step(state, x):
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["value"])
        return F.when(x["value"].isNull(), state).otherwise(
            F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))
        )

    return F.when(text.rlike(pattern), F.aggregate(gaps, start, step, lambda s: s["out"])).otherwise(start["out"])


def window_entropy(value: Column, window: int) -> Column:
    """Largest Shannon entropy of `window` characters in a row of a longer string."""
    chars = F.split(value, "")

    def over(c, letters):
        places = F.transform(c, lambda x: F.array_position(letters, x).cast("int"))

        def walk(at):
            zero = F.struct(
                F.transform(letters, lambda x: F.lit(0)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"), F.lit(0).alias("i")
            )
            weigh = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)

            def step(s, enters):
                leaves = F.when(s["i"] >= window, F.try_element_at(at, s["i"] - window + 1)).otherwise(F.lit(0))
                n_in = F.element_at(s["counts"], enters)
                mid = s["sum"] + weigh(n_in + 1) - weigh(n_in)
                # the leaving character is counted with the entering one already there
                n_out = F.when(leaves > 0, F.element_at(s["counts"], F.greatest(leaves, F.lit(1))) + F.when(leaves == enters, 1).otherwise(0)).otherwise(0)
                total = mid + F.when(leaves > 0, weigh(n_out - 1) - weigh(n_out)).otherwise(0.0)
                counts = F.transform(s["counts"], lambda c, k: c + F.when(k + 1 == enters, 1).otherwise(0) - F.when(k + 1 == leaves, 1).otherwise(0))
                full = s["i"] >= window - 1
                return F.struct(
                    counts.alias("counts"), total.alias("sum"), F.when(full, F.least(s["least"], total)).otherwise(s["least"]).alias("least"), (s["i"] + 1).alias("i")
                )

            return F.aggregate(at, zero, step, lambda s: F.log2(F.lit(float(window))) - s["least"] / window)

        return let(places, walk)

    return let(chars, lambda c: let(F.array_distinct(c), lambda letters: over(c, letters)))


def _allowed(value: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | value.rlike(f"^(?:{pattern})$")
    return out


def _random_looking(c: CharacterClass):
    return lambda x: ~_allowed(x["value"]) & (window_entropy(x["value"], c.window) > c.bits)


def _tagged(found: Column, kind: str, keep) -> Column:
    rank = KINDS.index(kind)
    return F.transform(F.filter(found, keep), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `base` and `spans` added: array<struct<start, rank, end>> by start,
    then kind (rank in KINDS), ends exclusive, in code points. `spans` has the base
    spans and the entropy spans that no base span holds.

    A null or empty text has none; every row keeps its columns and is judged for
    itself. Columns named `base` or `spans` are replaced."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    long_enough = lambda n: lambda x: (x["end"] - x["start"]) >= n
    base = F.concat(
        _tagged(located(body, ASSIGN), "assign", lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 1)) >= 6),
        _tagged(located(body, r"AKIA[A-Z0-9]{16,}"), "access", long_enough(20)),
        _tagged(located(body, r"[0-9a-f]{24,}"), "hex", long_enough(24)),
    )
    more = [_tagged(located(body, c.pattern), "entropy", _random_looking(c)) for c in CLASSES]
    out = docs.withColumn("base", F.array_sort(base))
    new = F.array_distinct(F.filter(F.concat(*more), lambda x: ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))))
    return out.withColumn("spans", F.array_sort(F.concat("base", new)))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda r: F.element_at(F.array(*map(F.lit, KINDS)), r + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["rank"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by `mark`."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        gap = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
        return F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), gap.alias("out"))
        )

    whole = F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
