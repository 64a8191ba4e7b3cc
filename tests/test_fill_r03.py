"""Small cases of the findings of round 3 on filling."""
import random
import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from rosterlake import rules as R
from rosterlake.functions import checks as K
from rosterlake.functions import dates as D
from rosterlake.functions import text as T
from rosterlake.operators import resolve as S
from rosterlake.options import FillOptions
from rosterlake.plans import roster as RO
from rosterlake.queries.derive import RECORD_COLS, records
from rosterlake.queries.registry import Tables

SF = "/root/testdata/sf0.001"
RECS = "source_id string, source_file string, sheet_idx int, row_idx int, rec map<string,string>"


def test_intents_share_what_is_read(spark, monkeypatch):
    """keys are read once for both intents, no source is scored where none is left
    out, and each intent has the people it has alone."""
    r, asked = records(Tables(spark, SF)).select(*RECORD_COLS), []
    best = {i: {x.source_id for x in S.top_sources(S.score_sources(r, (i,))).collect()} for i in ("add", "remove")}
    assert best["add"] == best["remove"] == {x.source_id for x in S.listed_sources(r).collect()}
    own = S.key_facts
    monkeypatch.setattr(S, "key_facts", lambda d, intents: asked.append(intents) or own(d, intents))
    both = RO.roster_people_of(r, ["add", "remove"])
    assert asked == [["add", "remove"]]
    rows = lambda d: sorted(map(str, d.collect()))
    for i in both:
        assert rows(both[i]) == rows(RO.roster_people(r, i)) != []
        few = RO.roster_people(r, i, FillOptions(max_sources=10 ** 6))
        assert rows(few) == rows(both[i])
    monkeypatch.setattr(S, "score_sources", None)
    RO.roster_people(r, "add")


def test_only_excluded_sources_are_all_listed(spark):
    """excluded files count only where there are no others; a source without keys is none."""
    rows = [("a", "在职.xlsx", 0, 0, {"name": "x"}), ("b", "new.xlsx", 0, 0, {}), ("c", "active.xlsx", 0, 0, {"k": None})]
    listed = lambda rs: sorted(x.source_id for x in S.listed_sources(spark.createDataFrame(rs, RECS)).collect())
    assert listed(rows) == ["a", "c"] and listed([*rows, ("d", "new.xlsx", 0, 0, {"k": "v"})]) == ["d"]


def test_keys_as_looked_up_in_each_record(spark):
    """keys told by the gathered keys are those found record by record, also where
    keys that fold alike hide one another."""
    rng = random.Random(5)
    names = ["name", "Name", "姓名", "id_number", "ID Number", "工号", "start_date", "Start Date", "STARTDATE", "month", "End_Date_2", "enddate", "termination date", "离职日期", "leave_date", "x"]
    rows = []
    for i in range(400):
        keys = rng.sample(names, rng.randrange(5))
        rows.append((f"s{i // 4}", "f", rng.randrange(2), i, {k: rng.choice(["v", "", " ", None]) for k in keys}))
    df = spark.createDataFrame(rows, RECS)
    look = T.with_lookup(df)
    place = lambda keys, get: F.array_min(F.array(*[F.when(get(k).isNotNull(), F.lit(i)) for i, k in enumerate(keys)]))
    cols = [place(R.NAME_KEYS, T.get_ci), place(R.ID_KEYS, T.get_ci), place(R.DATE_CANDIDATES["add"], T.get_folded), place(R.DATE_CANDIDATES["remove"], T.get_folded)]
    hits = look.groupBy("source_id").agg(*[F.min(c).alias(f"c{i}") for i, c in enumerate(cols)]).collect()
    forced, placed = {}, df.select("source_id", "sheet_idx", "row_idx", F.map_keys("rec").alias("ks")).collect()
    for word in ("enddate", "terminationdate"):
        for sid, _, _, ks in sorted(map(tuple, placed), key=lambda x: x[:3]):
            hit = [k for k in ks if k.lower().replace(" ", "").replace("_", "").startswith(word)]
            if hit and sid not in forced:
                forced[sid] = hit[0]
    want, lists = {}, (R.NAME_KEYS, R.ID_KEYS, R.DATE_CANDIDATES["add"], R.DATE_CANDIDATES["remove"])
    for h in hits:
        got = [None if h[f"c{i}"] is None else keys[h[f"c{i}"]] for i, keys in enumerate(lists)]
        want[h.source_id] = (got[0] or "name", got[1] or "id_number", got[2], forced.get(h.source_id, got[3]))
    facts = S.key_facts(df, ["add", "remove"]).collect()
    assert {f.source_id: (f.name_key, f.id_key, f.date_key_add, f.date_key_remove) for f in facts} == want and len(want) == 100
    plan = S.key_facts(df, ["add"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r" HashAggregate\(keys=\[[^]]*key_idx", plan) and not re.search(r"SortAggregate\(keys=\[[^]]*key_idx", plan)


def test_missing_places_come_first(spark):
    """a key's first place is the least sheet and row, a missing one before all."""
    rows = [("a", "f", 1, -5, {"p": "v"}), ("a", "f", 0, 7, {"r": "v"}), ("a", "f", None, 3, {"q": "v"}), ("a", "f", 0, None, {"p": ""}), ("a", "f", None, None, {"t": "1"}), ("a", "f", -1, 2 ** 31 - 1, {"u": "v"})]
    ks = S.gathered_keys(spark.createDataFrame(rows, RECS)).first().ks
    assert [k.key for k in ks] == ["t", "q", "u", "p", "r"] and tuple(ks[2].seen) == (-1, 2 ** 31 - 1, 0)


def test_looks_are_the_scores(spark):
    """a look says what the score says at one half, and dates are told as by all layouts."""
    texts = ["", "1", "123", "1234", "12345", "123456", "1" * 14, "1" * 15, "1" * 17 + "x", "1" * 17 + "X", "1" * 18, "a", "ab", "a b", "male", "F", "男", "王", "王伟", "王伟伟伟", "王" * 6, "王" * 7, "王a",
             "2025-01-02", "2025/1/2", "20250102", "2025-W03", "2025W031", "2025-W3", "2025-01-02T10:00", "20250102T1000Z", "2025-13-01", "2025年1月2日", "1月2日", "2025-1", "202501", "2025x", "x2025-01-02", "2025-01-02T", "2025/01/02 "]
    df = spark.createDataFrame([(x,) for x in texts], "v string")
    v = T.utrim("v")
    for kind, score in K.SCORES.items():
        wrong = df.filter((score(v) >= 0.5) != ((v != "") & K.LOOKS[kind](v))).collect()
        assert wrong == [], (kind, wrong)
    layouts = [D._date_by(v, p) for p in (D._ISO_STAMP, D._LOOSE, D._COMPACT_STAMP)] + [D._week_date(v)]
    assert df.filter(~D.record_date("v").eqNullSafe(reduce(lambda a, b: F.coalesce(a, b), layouts))).collect() == []


def test_people_are_worked_out_once(spark):
    """leaving skipped rows out does not work their dates and ids out a second time."""
    r = records(Tables(spark, SF)).select(*RECORD_COLS)
    size = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("W([0-9]{2})")
    people = RO.extract_people(r, "add")
    assert size(people.filter("skipped IS NULL")) == size(people)


def test_records_of_a_job_are_written_once(spark, monkeypatch):
    """strategies and fallback of a job read one written copy of its records, and each
    form's plan is written as well, so that records meet it where they are."""
    from rosterlake.plans import fill as P
    from rosterlake.queries import forms as Q

    class Seen(Exception):
        pass

    asked = []

    def look(records, *rest, **named):
        asked.append((records.inputFiles(), named))
        raise Seen

    monkeypatch.setattr(RO, "plan_fill", look)
    with pytest.raises(Seen):
        Q.run_fill(Tables(spark, SF))
    assert all("/step-" in f for f in asked[0][0]) and asked[0][1] == {"written": True}
    cols = spark.createDataFrame([("t", 0, "r", 1, "A", "h", "s", 2, 1, 1)], "template_id string, sheet_idx int, region_id string, col_index int, col_letter string, header_path string, sheet string, data_row int, first_row int, first_col int")
    placed = spark.createDataFrame([("t", 1, {"k": "v"})], "template_id string, pos long, rec map<string,string>")
    plan = spark.createDataFrame([("t", 1, "A", "k", None)], "template_id string, col_index int, col_letter string, key string, constant string")
    cells = P.plan_cells(placed, plan, cols)
    assert [(c.row, c.col_letter, c.value) for c in cells.collect()] == [(2, "A", "v")]
    assert any("/step-" in f for f in cells.inputFiles())


def test_steps_of_forms_hold_their_own_sorts(spark):
    """sheets are framed without a join, and a header's key is chosen from written pairs."""
    from rosterlake.plans import forms as FO
    from rosterlake.plans import matching as X

    cells = spark.createDataFrame([("t", 0, "s", "f", r, c, "x", "string") for r in (1, 2, 3) for c in (1, 2, 3)] + [(None, 0, "s", "f", 1, 1, "x", "string")], "template_id string, sheet_idx int, sheet string, filename string, row int, col int, raw string, raw_type string")
    frames = FO.sheet_frames(cells)
    assert [(f.template_id, f.header_row, f.max_row) for f in frames.collect()] == [("t", 1, 3)]
    assert "Join " not in frames._jdf.queryExecution().optimizedPlan().toString()
    cols = spark.createDataFrame([("t", "姓名", 1, "A")], "template_id string, header_path string, col_index int, col_letter string")
    got = X.synonym_match(cols, spark.createDataFrame([("t", "名字", 0)], "template_id string, key string, key_idx int"))
    assert [(r.header_path, r.key) for r in got.collect()] == [("姓名", "名字")] and all("/step-" in f for f in got.inputFiles())
