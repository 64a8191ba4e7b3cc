"""Similarity join and substring removal against brute force; the pipeline."""
import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from rosterlake.llm import graph, jaccard, queries, substrings
from tests.llm.test_scans import AWKWARD, WORD, documents, lower, table


def brute_links(docs):
    """(doc_id, class_id, copy_of, n_links) of rows with an id."""
    texts = {}
    for i, t in docs:
        texts.setdefault(t or "", []).append(i)
    sets = {}
    for t in texts:
        w = WORD.findall(lower(t))
        sets[t] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root, n = {t: t for t in texts}, Counter()

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    names = list(texts)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    least = {}
    for t, ids in texts.items():
        least[find(t)] = min(least.get(find(t), 1 << 62), min(ids))
    return Counter((i, least[find(t or "")], min(texts[t or ""]), n[t or ""]) for i, t in docs)


def near_copies(seed=3, groups=6, size=25):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 90, 160]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 6])):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
            out.append(" ".join(w))
    return [(1000 + k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("block", [1024, 7])
def test_similar(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = [(i, t) for i, t in AWKWARD if i is not None] + near_copies() + [(5000, "Same, row!"), (5001, "one two three"), (5002, "one two THREE"), (5003, "one two"), (5004, "")]
    got = Counter(map(tuple, jaccard.similar(table(spark, docs).repartition(5)).collect()))
    assert got == brute_links(docs)
    assert sum(r[3] > 0 for r in got) > 60


def test_similar_on_no_and_null_rows(spark):
    assert jaccard.similar(table(spark, [])).collect() == []
    assert [tuple(r) for r in jaccard.similar(table(spark, [(None, "a b c d e f")])).collect()] == [(None, None, None, 0)]


def test_recall_over_documents(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert Counter(map(tuple, jaccard.similar(documents(spark)).collect())) == brute_links(docs)


def test_one_of_each_class_stays(spark):
    docs = near_copies(groups=2) + [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other text of the same id"), (2, "a b c d e f"), (3, None), (4, "")]
    kept = jaccard.representatives(table(spark, docs))
    assert kept.columns == table(spark, []).columns
    ids = sorted((r.doc_id, r.text) for r in kept.collect())
    classes = {c for i, c, _, _ in brute_links(docs)}
    assert {i for i, _ in ids} == classes
    assert [i for i in ids if i[0] == 1] == [(1, "a b c d e f"), (1, "other text of the same id")]


def test_prefixes_shorten_to_the_target():
    """The prefix is the longest that finds a pair as far apart as a text's size allows."""
    assert jaccard.recall(0.8, 5) > jaccard.recall(0.8, 8) > 0.99
    for percent in (50, 80, 93):
        for size in (1, 2, 3, 5, 9, 40, 99, 100, 5000):
            least = jaccard.own_threshold(size, percent)
            both = [100 * b / (size + m - b) for m in range(1, 2 * size + 2) for b in range(1, min(size, m) + 1)] if size < 100 else [percent]
            assert least == min((x for x in both if x >= percent), default=100)
            depth = jaccard.depth_for(least, 0.999)
            assert jaccard.recall(least / 100, depth) >= 0.999 and (depth == 8 or jaccard.recall(least / 100, depth + 1) < 0.999)


def signed(texts):
    """(prefixes of each tree, own prefix length) of each text."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64())] * 2 + [pa.array(texts)], ["key", "node", "text"])
    for out in jaccard._signatures(80, 0.999)([batch]):
        for signature, depth in zip(out.column(2).to_pylist(), out.column(3).to_pylist()):
            yield [signature[16 * t : 16 * t + 16] for t in range(jaccard.TREES)], depth


def test_sorted_tries_link_runs_over_all_ranges(spark):
    """Links against brute force over all pairs of texts that share a prefix, in one range and
    in many; equal prefixes fill several ranges."""
    rng = random.Random(2)
    base = [f"g{k}" for k in range(120)]
    texts = [" ".join([*base[: rng.choice([6, 9, 120])], *(f"e{rng.randint(0, 3)}" for _ in range(rng.randint(0, 2)))]) for _ in range(160)]
    texts = list(dict.fromkeys(texts)) + [" ".join([*base[:90], f"end{k}"]) for k in range(150)]
    rows = list(signed(texts))
    shared = lambda a, b: max(next((k for k in range(8) if x[2 * k : 2 * k + 2] != y[2 * k : 2 * k + 2]), 8) for x, y in zip(a, b))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, d) in enumerate(rows):
        for j, (b, _) in enumerate(rows):
            if i != j and shared(a, b) >= d:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    table_ = spark.createDataFrame([(i, b"".join(a), d) for i, (a, d) in enumerate(rows)], "node long, signature binary, depth int")
    for ranges in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        try:
            links = graph.components(jaccard._forest(table_.repartition(3), 7), "node", "head").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        got = {r.node: r.root for r in links}
        assert {i: got.get(i, i) for i in range(len(texts))} == {i: find(i) for i in range(len(texts))}


def test_found_only_by_a_shorter_prefix_and_out_of_the_forest_early(spark):
    """Pairs at the threshold that share seven values of a tree but never eight, among many
    near-equal texts, which decide nothing for them; short texts stop at eight."""
    rng = random.Random(4)
    texts = []
    for k in range(3000):
        w = [f"p{rng.randrange(10**9)}" for _ in range(13)]  # nine shingles, eight of ten in both
        texts += [" ".join(w), " ".join([*w[:12], "other"])]
    rows = list(signed(texts))
    assert {d for _, d in rows} == {7}
    met = {d: {k for k in range(0, len(texts), 2) if any(x[: 2 * d] == y[: 2 * d] for x, y in zip(rows[k][0], rows[k + 1][0]))} for d in (8, 7)}
    pairs = sorted(met[7] - met[8])
    assert pairs
    assert [d for _, d in signed(["a b c d e f", "a b c d e"])] == [8, 8]
    base = [f"g{k}" for k in range(300)]
    docs = [(k, " ".join([*base, f"end{k}"])) for k in range(80)] + [(1000 + j, texts[j]) for k in pairs for j in (k, k + 1)]
    links = {r.doc_id: r.n_links for r in jaccard.similar(table(spark, docs)).collect()}
    assert all(links[1000 + j] == 1 for k in pairs for j in (k, k + 1))
    assert all(links[k] == 79 for k in range(80))


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(6)
    for _ in range(60):
        runs = [sorted(bytes(rng.choices(b"ab", k=9)) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))]
        shared = lambda a, b: next((k for k in range(9) if a[k] != b[k]), 9)
        coded = [(bytes([0, *(shared(a, b) for a, b in zip(r, r[1:]))][: len(r)]), r) for r in runs]
        order, prefix = substrings.merge(coded)
        merged = [runs[r][k] for r, k in order]
        assert merged == sorted(x for r in runs for x in r)
        assert prefix[1:] == [shared(a, b) for a, b in zip(merged, merged[1:])]


def brute_repeats(docs, length=100):
    first = set()
    for i, t in sorted(set(docs), key=lambda d: d[0]):
        body = (t or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            w = body[p : p + length]
            if w in first:
                gone[p : p + length] = b"\1" * length
            first.add(w)
        kept = bytes(x for x, g in zip(body, gone) if not g)
        yield i, len(body), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


def test_repeated_strings(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh \n\0é") for _ in range(n))
    passages = [text(rng.randint(90, 260)) for _ in range(8)]
    docs = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 100), (4, "x" * 500), (5, "ab" * 300), (6, "x" * 101), (7, "word " * 5000)]
    for i in range(10, 150):
        body = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            body += p[rng.randint(0, 40) : len(p) - rng.randint(0, 40)] + text(rng.randint(0, 30))
        docs.append((i, body))
    docs += [(i + 500, t) for i, t in docs[20:40]]
    docs += docs[30:33]  # repeated rows are one document, returned as often
    want = {r[0]: r for r in brute_repeats(docs)}
    got = substrings.deduplicated(table(spark, docs).repartition(6)).drop("kept").collect()
    assert Counter(map(tuple, got)) == Counter(want[i] for i, _ in docs)
    assert sum(r[2] for r in want.values()) > 30_000


def test_repeated_strings_of_other_lengths(spark):
    docs = [(1, "abcdefghij" * 6), (2, "z" + "abcdefghij" * 6), (3, "klmno" * 9 + "!" * 50)]
    for length in (41, 60, 146):
        got = substrings.deduplicated(table(spark, docs), length).drop("kept").collect()
        assert Counter(map(tuple, got)) == Counter(brute_repeats(docs, length))
    with pytest.raises(ValueError):
        substrings.repeats(table(spark, docs), 30)


def test_repeated_strings_on_no_and_null_rows(spark):
    assert substrings.deduplicated(table(spark, [])).collect() == []
    got = substrings.deduplicated(table(spark, [(None, "y" * 200), (1, "y" * 200)])).collect()
    # the first hundred bytes of a run start earliest; from the second byte on they repeat
    assert {(r.doc_id, r.n_removed) for r in got} == {(None, 199), (1, 200)}


def test_substring_removal_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    got = queries.op8_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    assert Counter(map(tuple, got)) == Counter(brute_repeats(docs))


def test_pipeline(spark):
    sf, docs = "/root/testdata/sf0.001", None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, columns, seen = docs, docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        seen[name] = rows
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = spark.createDataFrame(rows, first.schema)
    toxic = {r.doc_id for r in queries.op6_toxicity(spark, sf).collect() if r.predicted}
    assert {r.doc_id for r in seen["toxicity"]} == {r.doc_id for r in first.collect()} - toxic
    stayed = seen["n-gram Jaccard join"]
    assert {r.doc_id for r in stayed} == {c for _, c, _, _ in brute_links([(r.doc_id, r.text) for r in seen["toxicity"]])}
    assert len(stayed) == len({r.doc_id for r in stayed})
    packed = {r.doc_id for r in seen["best-fit packing"]}
    assert packed == {r.doc_id for r in seen["secret scans"]} == {r.doc_id for r in seen["benchmark decontamination"]}
    assert Counter(map(tuple, ((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, sf).collect()))) == Counter((r.doc_id, r.piece, r.length) for r in seen["best-fit packing"])
