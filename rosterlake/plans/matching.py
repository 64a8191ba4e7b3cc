"""Fuzzy and synonym matching of form headers to record keys.

Candidates come from an equi-join on character grams that cannot miss a pair
scoring at the threshold, so header and key sets are never crossed.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import checkpointed
from ..functions import text as T
from ..rules import SYNONYMS


def similarity(a, b) -> Column:
    """0..100 by edit distance; 90 at least when one text holds the other."""
    a, b = T.col(a), T.col(b)
    longest = F.greatest(F.length(a), F.length(b))
    ratio = F.floor(100 * (1 - F.levenshtein(a, b) / longest))
    holds = F.contains(a, b) | F.contains(b, a)
    return F.when(longest == 0, F.lit(0)).otherwise(F.when(holds, F.greatest(ratio, F.lit(90))).otherwise(ratio)).cast("int")


def _segments(c: Column, threshold: int) -> Column:
    """Cut a text into one piece more than the edits the threshold allows: a
    text within that distance, or containing it, holds one piece unchanged."""
    n = F.length(c)
    pieces = F.least(n, F.floor(n * (100 - threshold) / threshold).cast("int") + 1)
    size, extra = F.floor(n / pieces).cast("int"), n % pieces

    def piece(i):
        longer = F.greatest(F.lit(0), i - (pieces - extra))
        return F.substring(c, (i * size + longer + 1).cast("int"), size + F.when(i >= pieces - extra, 1).otherwise(0))

    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), pieces - 1), piece)))


def _grams(c: Column, threshold: int) -> Column:
    top = max(math.ceil(threshold / (100 - threshold)), 1)
    n = F.length(c)
    cut = lambda k: lambda i: F.substring(c, i, F.lit(k))
    sizes = [
        F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), cut(k))).otherwise(F.array().cast("array<string>"))
        for k in range(1, top + 1)
    ]
    return F.array_distinct(F.concat(*sizes))


def similar_pairs(left: DataFrame, right: DataFrame, a: str, b: str, by: list[str], threshold: int = 80) -> DataFrame:
    """Distinct (by, a, b) pairs scoring at least the threshold (80 or more)."""
    if not 50 < threshold < 100:
        raise ValueError("threshold must lie between 50 and 100")
    lt = left.select(*by, a).distinct().filter(F.length(a) > 0)
    rt = right.select(*by, b).distinct().filter(F.length(b) > 0)
    seg = lambda d, c: d.select(*by, c, F.explode(_segments(F.col(c), threshold)).alias("_g"))
    gram = lambda d, c: d.select(*by, c, F.explode(_grams(F.col(c), threshold)).alias("_g"))
    pairs = seg(lt, a).join(gram(rt, b), [*by, "_g"]).select(*by, a, b).unionByName(gram(lt, a).join(seg(rt, b), [*by, "_g"]).select(*by, a, b))
    return pairs.distinct().withColumn("score", similarity(a, b)).filter(F.col("score") >= threshold)


def match_headers(columns: DataFrame, keys: DataFrame, threshold: int = 80) -> DataFrame:
    """Best key per header over its variants: (template_id, header_path, key,
    score). keys(template_id, key). Of keys folding alike the first one counts."""
    norm = keys.select("template_id", "key", T.match_text("key").alias("nk")).filter("nk != ''").groupBy("template_id", "nk").agg(F.min("key").alias("key"))
    heads = columns.filter("header_path != ''").select("template_id", "header_path", F.explode(T.header_variants("header_path")).alias("variant"))
    pairs = similar_pairs(heads, norm, "variant", "nk", ["template_id"], threshold)
    scored = heads.join(pairs, ["template_id", "variant"]).join(norm, ["template_id", "nk"])
    return scored.groupBy("template_id", "header_path").agg(
        F.min_by(F.struct("key", "score"), F.struct((-F.col("score")).alias("s"), F.col("key"))).alias("m")
    ).select("template_id", "header_path", "m.key", "m.score")


def enrich_mapping(columns: DataFrame, keys: DataFrame, existing: DataFrame, threshold: int = 80) -> DataFrame:
    """Keys for headers the mapping (template_id, header_path, key) leaves open:
    strictly above the threshold, each key used once, leftmost header first."""
    heads = columns.filter("header_path != ''").join(existing.select("template_id", "header_path"), ["template_id", "header_path"], "left_anti")
    pairs = similar_pairs(heads, keys, "header_path", "key", ["template_id"], threshold)
    best = pairs.filter(F.col("score") > threshold).groupBy("template_id", "header_path").agg(
        F.min_by(F.struct("key", "score"), F.struct((-F.col("score")).alias("s"), F.col("key"))).alias("m")
    ).select("template_id", "header_path", "m.key", "m.score")
    order = heads.groupBy("template_id", "header_path").agg(F.min("col_index").alias("col_index"))
    free = best.join(existing.select("template_id", "key"), ["template_id", "key"], "left_anti").join(order, ["template_id", "header_path"])
    one = free.groupBy("template_id", "key").agg(F.min_by(F.struct("header_path", "score"), "col_index").alias("h"))
    return one.select("template_id", F.col("h")["header_path"].alias("header_path"), "key", F.col("h")["score"].alias("score"))


def _squash(c) -> Column:
    return F.translate(T.col(c), " _-", "")


def _last_part(header: Column) -> Column:
    return F.when(F.contains(header, F.lit("/")), T.utrim(F.element_at(F.split(header, "/"), -1))).otherwise(header)


def _flat(group) -> list[str]:
    return [g.replace(" ", "").replace("_", "").replace("-", "") for g in group]


def synonym_tier(header, key) -> Column:
    """1 for equal or contained names, 2 for synonyms, else null."""
    h, k = T.col(header), T.col(key)
    h0 = _last_part(h)
    near = F.contains(k, h) | F.contains(h, k) | F.contains(k, h0) | F.contains(h0, k) | (_squash(h0) == _squash(k))
    known = F.lit(False)
    for word, group in SYNONYMS.items():
        flat = _flat(group)
        known = known | ((k == word) & h0.isin(*group)) | ((h0 == word) & k.isin(*group)) | (_squash(h0).isin(*flat) & _squash(k).isin(*flat))
    return F.when(near, F.lit(1)).when(known, F.lit(2))


#: Longest run of characters that a contained name is looked up by.
_LEAD = 4


def _marks(kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda x: F.concat(F.lit(kind), x))


def _leads(texts: Column) -> Column:
    """What a name is looked up by inside longer ones: its first characters."""
    return F.transform(texts, lambda x: F.substring(x, 1, _LEAD))


def _runs(c: Column) -> Column:
    """All runs of at most `_LEAD` characters, the empty one too."""
    n = F.length(c)
    cut = lambda k: lambda i: F.substring(c, i, F.lit(k))
    sizes = [F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), cut(k))).otherwise(F.array().cast("array<string>")) for k in range(1, _LEAD + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *sizes))


def _groups(c: Column) -> Column:
    """Marks of the synonym groups that a name may belong to."""
    hit = lambda word, group: (c == word) | c.isin(*group) | _squash(c).isin(*_flat(group))
    return F.filter(F.array(*[F.when(hit(word, group), F.lit(f"g{i}")) for i, (word, group) in enumerate(SYNONYMS.items())]), lambda x: x.isNotNull())


def synonym_pairs(headers: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct (header_path, key, tier) of all header and key texts that have a tier.

    Texts meet by equal marks, so they are never crossed: a contained name's first
    characters with the runs of the longer one, names without separators, and synonym
    groups. Every pair with a tier shares a mark; tiers are worked out for those alone.
    The tier depends on the texts only, so each text is looked at once however many
    forms and records hold it."""
    h, k = F.col("header_path"), F.col("key")
    names = F.array(h, _last_part(h))
    of_header = F.concat(_marks("in", _leads(names)), _marks("of", _runs(h)), F.array(F.concat(F.lit("s"), _squash(_last_part(h)))), _groups(_last_part(h)))
    of_key = F.concat(_marks("of", _leads(F.array(k))), _marks("in", _runs(k)), F.array(F.concat(F.lit("s"), _squash(k))), _groups(k))
    left = headers.select("header_path").distinct().select("header_path", F.explode(F.array_distinct(of_header)).alias("_mark"))
    right = keys.select("key").distinct().select("key", F.explode(F.array_distinct(of_key)).alias("_mark"))
    met = left.join(right, "_mark").select("header_path", "key").distinct()
    return met.withColumn("tier", synonym_tier("header_path", "key")).filter("tier IS NOT NULL")


def synonym_match(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """First key per header by `synonym_tier`, then one header per key.
    keys(template_id, key, key_idx): the keys of one record (a template_id may also be a
    form and a list of keys). Only pairs with a tier (`synonym_pairs`) reach the join by
    form."""
    heads = columns.filter("header_path != ''").select("template_id", "header_path", "col_index", "col_letter")
    # Pairs and choices are written, so that no task holds the sorts of two steps at once.
    pairs = checkpointed(heads.join(synonym_pairs(heads, keys), "header_path").join(keys, ["template_id", "key"]))
    best = pairs.groupBy("template_id", "header_path", "col_index", "col_letter").agg(F.min_by("key", F.struct("tier", "key_idx")).alias("key"))
    w = Window.partitionBy("template_id", "key").orderBy("col_index")
    return checkpointed(best).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
