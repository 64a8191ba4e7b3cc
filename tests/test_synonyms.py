"""The search for synonym pairs misses none that a look at every pair finds."""
import random

from pyspark.sql import functions as F

from rosterlake.plans import matching as X
from rosterlake.rules import SYNONYMS


def _texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    words = [w for word, group in SYNONYMS.items() for w in (word, *group)] + ["姓", "a", "ab c", "A_b", "x-y", "名字编号", "employee"]
    out = ["", "/", "a/", " ", "参保人/ 姓名 ", "a b_c-d", "abcd"]
    while len(out) < n:
        t = rng.choice(words)
        roll = rng.random()
        if roll < 0.2:
            t = rng.choice(words) + "/" + t
        elif roll < 0.4:
            t = t + rng.choice(words)
        elif roll < 0.5:
            t = "_".join(t)
        elif roll < 0.6 and len(t) > 1:
            t = t[rng.randrange(len(t)):]
        out.append(t)
    return out


def test_no_pair_is_missed(spark):
    heads = spark.createDataFrame([(t,) for t in _texts(1, 250)], "header_path string")
    keys = spark.createDataFrame([(t,) for t in _texts(2, 250)], "key string")
    got = X.synonym_pairs(heads, keys)
    every = heads.distinct().crossJoin(keys.distinct()).withColumn("tier", X.synonym_tier("header_path", "key")).filter("tier IS NOT NULL")
    want = sorted(tuple(r) for r in every.collect())
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {t for *_, t in want} == {1, 2}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_match_equals_a_look_at_every_pair(spark):
    rng = random.Random(3)
    texts, names = [t for t in _texts(4, 120) if t], _texts(5, 120)
    cols = spark.createDataFrame([(f"t{f}", h, i, "A") for f in range(12) for i, h in enumerate(rng.sample(texts, 10))], "template_id string, header_path string, col_index int, col_letter string")
    keys = spark.createDataFrame([(f"t{f}", k, i) for f in range(12) for i, k in enumerate(dict.fromkeys(rng.sample(names, 9)))], "template_id string, key string, key_idx int")
    rows = {}
    crossed = cols.join(keys, "template_id").withColumn("tier", X.synonym_tier("header_path", "key")).filter("tier IS NOT NULL")
    for r in crossed.orderBy("template_id", "col_index", "tier", "key_idx").collect():
        rows.setdefault((r.template_id, r.col_index), (r.header_path, r.key))
    want, used = set(), set()
    for (form, col), (head, key) in sorted(rows.items()):
        if (form, key) not in used:
            used.add((form, key))
            want.add((form, head, col, key))
    got = {(r.template_id, r.header_path, r.col_index, r.key) for r in X.synonym_match(cols, keys).collect()}
    assert got == want and len(got) > 20
