"""Small cases of the findings of round 3 on growth."""
from pyspark.sql import functions as F

from rosterlake.queries.registry import Tables

SF = "/root/testdata/sf0.001"


def test_forms_alike_share_records(spark, monkeypatch):
    """records are chosen once for forms that treat them alike, and names of keys are
    folded for lists of keys, not for records."""
    from rosterlake.operators import intent as I
    from rosterlake.plans import fill as P
    from rosterlake.plans import mapped as M
    from rosterlake.queries import mapped as Q

    asked, looked, signals = [], [], []
    own, auto, known = M.form_records, P.auto_fields, I.with_intents
    monkeypatch.setattr(M, "form_records", lambda r, d, *a: asked.append(d) or own(r, d, *a))
    monkeypatch.setattr(P, "auto_fields", lambda c, keys, *a: looked.append(keys) or auto(c, keys, *a))
    monkeypatch.setattr(I, "with_intents", lambda *a: signals.append(1) or known(*a))
    t = Tables(spark, SF)
    few = t.nation.filter("n_nationkey IN (0, 8, 16, 24, 3, 7)")
    monkeypatch.setattr(Tables, "nation", few, raising=False)
    cells = Q.mapped_fill(t).collect()
    got = {}
    for r in cells:
        got.setdefault(r.template_id, set()).add((r.row, r.col_letter, r.key, r.value))
    assert {r.template_id for r in asked[0].collect()} == {"t0", "t3", "t7"} and len(signals) == 1
    assert got["t0"] == got["t8"] == got["t16"] == got["t24"] and set(got) == {"t0", "t8", "t16", "t24", "t3", "t7"}
    assert "rec" not in looked[0]._jdf.queryExecution().optimizedPlan().toString()


def test_replies_are_parsed_once(spark):
    """a reply's members are parsed once for its columns, constants and filter, each part once."""
    from rosterlake.operators import replies as Q

    full = '{"column_mapping":{" a ":"x","b":" ","c":{"d":1}},"constant_values":{"k":"v","n":null},"record_filter":{"field":" f ","values":["1",null],"exclude":true}}'
    texts = [full, '{"a":"x","constant_values":7}', '{"column_mapping":[],"record_filter":{"field":"f","values":[]}}', "[1]", "7", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, json string")
    out = df.select("i", Q.mapping_parts("json").alias("p")).select("i", "p.*")
    plan = df.select("i", Q.mapping_parts("json").alias("p")).select("i", "p.columns", "p.constants", "p.record_filter.field", "p.record_filter.values")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 4
    rows = {r.i: r for r in out.collect()}
    assert rows[0].columns == {"a": "x"} and rows[0].constants == {"k": "v"} and tuple(rows[0].record_filter) == ("f", ["1"], True)
    assert rows[1].columns == {"a": "x"} and rows[1].constants == {} and rows[1].record_filter is None
    for i in (2, 3, 4, 5, 6):
        assert rows[i].columns is None and rows[i].constants == {} and rows[i].record_filter is None
    one = df.select("i", Q.column_mapping("json").alias("columns"), Q.constant_values("json").alias("constants"), Q.record_filter("json").alias("record_filter"))
    assert {r.i: r for r in one.collect()} == rows
    assert one.select("record_filter")._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 2


def test_modes_share_the_reading(spark, monkeypatch):
    """sheets are laid out, named and read once for all modes, and each mode takes what it
    takes alone."""
    from rosterlake.operators import sheets as C
    from rosterlake.plans import intake as N
    from rosterlake.queries import sheets as Q
    from rosterlake.queries.derive import sheet_cells

    called = []
    for name in ("sheet_layout", "records_from_cells", "rank_sheets"):
        own = getattr(C, name)
        monkeypatch.setattr(C, name, lambda *a, _n=name, _f=own, **k: called.append(_n) or _f(*a, **k))
    t = Tables(spark, SF)
    got = {r.mode: r.n for r in Q.sheet_modes(t).collect()}
    assert sorted(called) == ["rank_sheets", "records_from_cells", "sheet_layout"]
    assert got == {m: N.sheet_records(sheet_cells(t), mode=m).count() for m in ("single", "auto")}
