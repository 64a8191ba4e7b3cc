"""Conversation repair, filter audit and sequential near-dedup against plain Python."""
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from rosterlake.llm import bayes, interactions, queries, repair
from tests.llm.test_duplicates import near_copies
from tests.llm.test_scans import AWKWARD, lower, table

SF = "/root/testdata/sf0.001"


def cheapest(rows):
    """(cost, audit, repaired) of (initial, must go, cut, role, text) rows: every path, by dynamic programming."""
    best = {(0, 0): (0, "", ())}

    def offer(key, cost, audit, said):
        if key not in best or (cost, audit) < best[key][:2]:
            best[key] = (cost, audit, said)

    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for q in range(4):
                if (i, q) in best:
                    cost, audit, said = best[i, q]
                    offer((i, 3 if q == 2 else 2), cost + 2, audit + "I", (*said, ("assistant" if q == 2 else "user") + ":"))
        if i == len(rows):
            break
        z, gone, cut, role, text = rows[i]
        for q in range(4):
            if (i, q) not in best:
                continue
            cost, audit, said = best[i, q]
            offer((i + 1, q), cost + 3, audit + "D", said)
            if gone:
                continue
            to = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(z)
            if to is not None:
                offer((i + 1, to), cost + cut, audit + "K", (*said, f"{role}:{text}"))
            offer((i + 1, 3 if q == 2 else 2), cost + 2 + cut, audit + "R", (*said, ("assistant" if q == 2 else "user") + ":" + text))
    return min(best[len(rows), q] for q in (0, 3) if (len(rows), q) in best)


def brute_repairs(rows, damaged=True):
    """What op11 returns for (conv_id, turn, role, text) rows."""
    out = {}
    after = {}
    for conv, turn, role, text in rows:
        after.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20 if damaged else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, got in after.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        turns = {t for t, _, _ in got if t is not None}
        seen, coded, faults = set(), [], Counter()
        for _, role, text in got:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", role, text))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        cost, audit, said = cheapest(coded)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def conversation_table(spark, rows):
    extra = "row string, place string, digest string, audit string, edit string, code string"
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], f"conv_id long, turn long, role string, text string, {extra}")


def chatter(seed, conversations):
    rng = random.Random(seed)
    for conv in range(conversations):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 40])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", " ", None, "Assistant"])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \n", None, "why?  \n", f"text {rng.randint(0, 9)}.", "é\x85"])
            for _ in range(rng.choice([1, 1, 1, 1, 2])):
                yield conv if conv else None, rng.choice([turn, turn, turn, None, turn * 2]), role, text


def test_conversation_repair(spark):
    rows = list(chatter(1, 120))
    data = conversation_table(spark, rows).repartition(5)
    got = repair.audited(repair.damage(data), data)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_repairs(rows).values())


def test_repairs_without_damage_and_their_rows(spark):
    rows = list(chatter(2, 40))
    data = conversation_table(spark, rows)
    plans = repair.plan_repairs(data)
    want = brute_repairs(rows, damaged=False)
    assert {r.conv_id: (r.cost, r.audit) for r in plans.collect()} == {k: v[6:8] for k, v in want.items()}
    said = {}
    for r in repair.repaired(data, plans).orderBy("conv_id", "place").collect():
        said.setdefault(r.conv_id, []).append(r)
    for conv, mine in said.items():
        assert [r.place for r in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == want[conv][8]


def test_no_conversations(spark):
    data = conversation_table(spark, [])
    assert repair.audited(repair.damage(data), data).collect() == []


def test_repair_of_conversations_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, queries.op11_conversation_repair(spark, SF).collect())) == Counter(brute_repairs(rows).values())


@pytest.mark.parametrize("piece", [1, 3, 16])
def test_plans_are_the_cheapest_and_least(monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(400):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(0, 9)))
        rows = [("suax"[c // 4], c % 4 > 1, c % 4 == 1, "", "") for c in codes]
        assert repair.plan(codes) == cheapest(rows)[:2], codes


def test_prices_are_distances_and_expose_all_cheapest_paths():
    rng = random.Random(3)
    for _ in range(60):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(0, 5)))
        lattice = repair.Lattice(codes, [0, None, None, 0], True)
        for origin in range(4):
            far = {lattice.end: 0}
            for _ in range(lattice.end + 1):  # Bellman and Ford
                for node, arcs in enumerate(lattice.arcs):
                    for _, cost, to in arcs:
                        if to in far and far[to] + cost < far.get(node, 1 << 30):
                            far[node] = far[to] + cost
            assert lattice.distance(origin) == far[origin]
            assert all(lattice.price[k] <= far[k] for k in far)


def test_a_long_conversation_costs_its_length(spark):
    codes = bytes(random.Random(1).choices([0, 4, 4, 5, 8, 8, 9, 6, 12], k=60_000))
    cost, audit = repair.plan(codes)
    assert len(audit) >= 60_000 and cost > 0
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(20_000)]
    got = repair.audited(conversation_table(spark, rows)).collect()
    assert [(r.cost, r.audit) for r in got] == [(0, "K" * 20_000)]


def brute_audit(docs, labels):
    """op12 for (doc_id, text, lang) and (doc_id, quality, toxic) rows."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = {}
    for i, t, lang in docs:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "".join(k for k, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and i > least[text])) if bad)
        mine = [r for r in labels if i is not None and r[0] == i]
        parts.setdefault(lang or "", []).append((fails, any(r[1] == 1 for r in mine), any(r[2] == 1 for r in mine)))
    out = Counter()
    for part, rows in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, k in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [r for r in rows if k in r[0] and not before & set(r[0])]
                out[part, order, step, sum(not (before | {k}) & set(f) for f, _, _ in rows), len(here), sum(k in f for f, _, _ in rows) - len(here), sum(f == k for f, _, _ in rows),
                    sum(g for _, g, _ in here), sum(x for _, _, x in here)] += 1
    return out


def test_filter_audit(spark, monkeypatch):
    monkeypatch.setattr(interactions, "RANGE", 7)
    rng = random.Random(2)
    docs = [(i, t, lang) for (i, t), lang in zip(AWKWARD, ["en", None, "", "de", "en", "en", "en", "fr", "en", "de", "en", "en"])]
    for i in range(100, 260):
        text = " ".join(rng.choice(["word", "Word", f"w{rng.randint(0, 300)}", "UP", "#"] if i % 3 else [f"w{k}" for k in range(600)]) for _ in range(rng.choice([0, 5, 210, 400])))
        docs.append((i, text, rng.choice(["en", "de", None])))
    docs += [(i + 500, t, "en") for i, t, _ in docs[30:60]] + [(None, docs[40][1], "fr"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(90, 700, 2)] + [(100, 1, 0), (100, 0, 1), (None, 1, 1)]
    extra = "part string, digest string, A string, good string, id string, fails string, place string, word string"
    data = spark.createDataFrame([(*r, *["x"] * 8) for r in docs], f"doc_id long, text string, lang string, {extra}").repartition(4)
    rows = interactions.labelled(interactions.text_filters(data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = interactions.interactions(rows, marks=("good", "toxic"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = got.collect()
    assert Counter(tuple(r)[:9] for r in found) == brute_audit(docs, labels)
    total = Counter()
    for r in found:
        total[r.part, r.filter_order[r.step - 1]] += r.removed
    assert all(r.shapley == total[r.part, r.filter_order[r.step - 1]] for r in found)


def test_filter_audit_of_no_rows_and_other_filters(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert interactions.interactions(interactions.labelled(interactions.text_filters(none), spark.createDataFrame([], "doc_id long, quality int, toxic int")), marks=("good", "toxic")).collect() == []
    rows = spark.createDataFrame([(1, None, True, None), (1, None, True, True), (None, None, False, True)], "doc_id long, part string, x boolean, y boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in interactions.interactions(rows, ("x", "y")).collect()}
    assert got == {("xy", 1): (1, 2, 0, 1, 3), ("xy", 2): (0, 1, 1, 1, 3), ("yx", 1): (1, 2, 0, 1, 3), ("yx", 2): (0, 1, 1, 1, 3)}
    with pytest.raises(ValueError):
        interactions.interactions(rows, ("x", "xx"))


def test_galloping_merges():
    rng = random.Random(4)
    for _ in range(400):
        sets = [set(rng.sample(range(60), rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        lists = [sorted(s) for s in sets]
        assert interactions.union(lists) == sorted(set().union(*sets))
        for a, b in itertools.combinations(range(len(sets)), 2):
            assert interactions.difference(lists[a], lists[b]) == sorted(sets[a] - sets[b])
            assert interactions.common(lists[a], lists[b]) == len(sets[a] & sets[b])


def brute_near(docs):
    """op13 for (doc_id, text) rows."""
    sets = {}
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[t or ""] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) or (frozenset([tuple(w)]) if w else frozenset())
    different = [s for s in set(sets.values()) if s]
    root = {s: s for s in different}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in itertools.combinations(different, 2):
        both = len(a & b)
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            root[find(a)] = find(b)
    least = {}
    for i, t in docs:
        s = sets[t or ""]
        if s and i is not None:
            least[find(s)] = min(least.get(find(s), i), i)
    out = Counter()
    for i, t in docs:
        s = sets[t or ""]
        mine = least.get(find(s)) if s else i
        out[i, len(s), mine, i == mine] += 1
    return out


@pytest.mark.parametrize("block", [512, 5])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(bayes, "BLOCK", block)
    docs = AWKWARD + near_copies(seed=7) + [(5000, "Same, row!"), (5001, "one two three"), (5002, "ONE two\tthree"), (5003, "one  two"), (5004, "\x0b"), (None, "nobody  else says that"), (None, near_copies(seed=7)[0][1])]
    got = bayes.near_duplicates(table(spark, docs).repartition(5))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == brute_near(docs)


def test_near_duplicates_on_no_and_null_rows(spark):
    assert bayes.near_duplicates(table(spark, [])).collect() == []
    assert [tuple(r) for r in bayes.near_duplicates(table(spark, [(None, None)])).collect()] == [(None, 0, None, True)]


def test_a_chain_that_stars_leave_apart(spark):
    """Texts of one bucket whose least is like none of them: the rest is compared in blocks."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(200)]
    docs = []
    for g in range(30):
        mine = [w if rng.random() < 0.9 else f"g{g}x{k}" for k, w in enumerate(base)]
        docs += [(10 * g + j, " ".join(mine[: 200 - 3 * j])) for j in range(4)]
    assert Counter(map(tuple, bayes.near_duplicates(table(spark, docs)).collect())) == brute_near(docs)


def test_pruning_bounds():
    """A pair stays where the posterior chance is not under the miss probability; a pair at the
    threshold is lost to all batches together with a chance of about that order."""
    from math import comb

    for percent, miss in ((80, 1e-6), (50, 1e-3)):
        need = bayes.needed(percent, miss)
        assert list(need) == sorted(need)
        p = percent / 100
        for k, least in enumerate(need):
            n = (k + 1) * bayes.BATCH
            lost = sum(comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(least))
            assert lost <= 3 * miss
    assert bayes.needed(80, 1e-6)[0] > 8


def test_recall_over_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op13_minhash_near_dedup(spark, SF).collect())) == brute_near(docs)
