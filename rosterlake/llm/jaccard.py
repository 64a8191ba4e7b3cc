"""Similarity join of texts by the Jaccard index of their five-word shingles.

Candidates come from a MinHash LSH forest. Each tree is the list of all texts sorted by
their part of the signature: a prefix trie whose branches are runs of neighbours that
share a prefix. A text is matched at the longest prefix it shares, and prefixes are then
shortened, value by value, until the target recall is reached for the text: for the least
similarity that its number of shingles allows above the threshold. A run gives one link
from each text to its first one, so it costs its size, not its square; all texts of a
connected set of candidates are then compared exactly, in blocks of a bounded number of
texts, so texts that never shared a prefix are compared too."""
from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import checkpointed
from .arrays import as_bytes, chunks, lists, mix, small_batches, windows, words
from .graph import components

SHINGLE = 5
TREES = 32
#: Longest and shortest prefix of a tree's signature, in hash values.
DEPTHS = (8, 7, 6, 5, 4, 3, 2, 1)
#: Sets of so many shingles can come as close to the threshold as any.
MANY = 100
#: Texts of a block: two blocks are compared in one task.
BLOCK = 1024
_SALTS = np.random.default_rng(5).integers(1, 1 << 32, (TREES * DEPTHS[0], 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingles(w) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of shingles, text of each) of the words of some texts. A text of fewer
    than SHINGLE words, but not none, is one shingle."""
    text_of = np.repeat(np.arange(len(w.counts)), w.counts)
    all_ = windows(w.hash, SHINGLE)
    whole = text_of[: len(all_)] == text_of[SHINGLE - 1 :] if len(all_) else np.zeros(0, bool)
    values, owner = [all_[whole]], [text_of[: len(all_)][whole]]
    for t in np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE)).tolist():
        values.append(windows(w.hash[w.first[t] : w.first[t] + w.counts[t]], int(w.counts[t])))
        owner.append(np.array([t]))
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return values[order], owner[order]


def recall(similarity, depth: int, trees: int = TREES):
    """Chance that two texts share a prefix of `depth` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(percent: float, target: float) -> int:
    """Longest prefix at which two texts of a similarity are found with a chance of at least
    `target` (else the shortest). It does not depend on the table: many equal texts do not
    answer for a pair elsewhere."""
    return next((d for d in DEPTHS if recall(percent / 100, d) >= target), DEPTHS[-1])


def own_threshold(size: int, percent: int) -> float:
    """Least similarity, in hundredths, that is not under `percent` and that a set of `size`
    shingles can have with any other: few shingles leave few similarities."""
    if size >= MANY:
        return percent
    out = 100.0
    for other in range(1, 100 * size // percent + 1):
        both = -(-percent * (size + other) // (100 + percent))
        if both <= min(size, other):
            out = min(out, 100 * both / (size + other - both))
    return out


@cache
def _own_depth(size: int, percent: int, target: float) -> int:
    return depth_for(own_threshold(size, percent), target)


def _signatures(percent: int, target: float):
    """node, key, the sorted-list values of each tree (none for a text without words) and the
    prefix length that reaches the target for the text."""

    def run(batches):
        for batch in batches:
            out, depths = [], []
            for _, part in chunks(as_bytes(batch.column(2))):
                values, owner = shingles(words(part))
                cut = np.searchsorted(owner, np.arange(len(part) + 1))
                own = np.flatnonzero(np.diff(cut))
                signature = np.zeros((len(own), TREES * DEPTHS[0]), ">u2")
                if len(own):
                    x = (values >> np.uint64(32)).astype(np.uint32)
                    for k, (a, b) in enumerate(_SALTS):
                        v = (x ^ a) * b
                        v ^= v >> np.uint32(15)
                        v *= a
                        least = np.minimum.reduceat(v, cut[own])
                        signature[:, k] = (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)
                rows = iter(signature)
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    out.append(next(rows).tobytes() if b > a else None)
                    depths.append(_own_depth(len(np.unique(values[a:b])) if b - a < MANY else MANY, percent, target) if b > a else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(depths, pa.int32())], ["key", "node", "signature", "depth"])

    return run


def _neighbours(shortest: int):
    """Links (node, head) of a stretch of the sorted lists, rows (place, node, depth): each to
    the first row of its run at the text's own prefix length, if that is another one. Then
    the stretch's edge: its first and last place, its first node and, for each prefix length
    from `shortest` on, the head of the run it ends in."""
    lengths = range(shortest, DEPTHS[0] + 1)

    def run(batches):
        first, last = None, None
        heads = dict.fromkeys(lengths, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column(0)
            rows = np.frombuffer(b"".join(places.to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            node, depth = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            tree, values = rows[:, 0], np.ascontiguousarray(rows[:, 1:]).view(">u2")
            before = np.vstack([values[:1] if last is None else last[1], values[:-1]])
            same = (values == before) & (tree == np.append(tree[0] if last is None else last[0], tree[:-1]))[:, None]
            shared = np.cumprod(same, axis=1).sum(axis=1)
            if last is None:
                shared[0], first = 0, (places[0].as_py(), int(node[0]))
            links = []
            for length in lengths:
                begins = shared < length
                at = np.maximum.accumulate(np.where(begins, np.arange(len(node)), -1))
                head = np.where(at >= 0, node[at], heads[length])
                heads[length] = int(head[-1])
                hit = (depth == length) & ~begins
                links.append((node[hit], head[hit]))
            last = (tree[-1], values[-1:].copy(), places[-1].as_py())
            a, b = (np.concatenate(x) for x in zip(*links))
            yield _stretch(a, b)
        if last is not None:
            none = np.zeros(0, np.int64)
            yield _stretch(none, none, (TaskContext.get().partitionId(), first[0], first[1], last[2], list(heads.values())))

    return run


_STRETCH = "node long, head long, part int, first_place binary, first_node long, last_place binary, heads array<long>"


def _stretch(node: np.ndarray, head: np.ndarray, edge: tuple | None = None) -> pa.RecordBatch:
    n = len(node) + (edge is not None)
    pad = [None] * len(node)
    part, first_place, first_node, last_place, heads = ([*pad, x] for x in edge) if edge else ([None] * n for _ in range(5))
    links = [pa.array([*x.tolist(), *([None] if edge else [])], pa.int64()) for x in (node, head)]
    return pa.RecordBatch.from_arrays(
        [*links, pa.array(part, pa.int32()), pa.array(first_place, pa.binary()), pa.array(first_node, pa.int64()), pa.array(last_place, pa.binary()), pa.array(heads, pa.list_(pa.int64()))],
        ["node", "head", "part", "first_place", "first_node", "last_place", "heads"],
    )


def _forest(texts: DataFrame, shortest: int) -> DataFrame:
    """(node, head): links of texts that share a prefix of a tree, long enough for one of them.
    All trees are one list, sorted by (tree, values) in ranges; equal prefixes, however many,
    go over as many ranges as their rows fill, and the ranges' edges join their runs."""
    size = 2 * DEPTHS[0]
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    place = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.substring("signature", F.col("tree") * size + 1, F.lit(size)))
    rows = texts.filter("signature IS NOT NULL").select("node", "depth", "signature", trees).select(place.alias("place"), "node", "depth")
    found = checkpointed(rows.repartitionByRange("place", "node").sortWithinPartitions("place", "node").mapInArrow(_neighbours(shortest), _STRETCH))
    # a row a range: as many as there are tasks
    before = Window.orderBy("part")
    edges = found.filter("part IS NOT NULL").select("part", "first_place", "first_node", F.lag("last_place").over(before).alias("last"), F.lag("heads").over(before).alias("heads"))
    runs = edges.select("first_place", "first_node", "last", F.posexplode("heads").alias("k", "head"))
    wide = 1 + 2 * (F.col("k") + shortest)
    on = runs.filter(F.substring("first_place", F.lit(1), wide) == F.substring("last", F.lit(1), wide)).select(F.col("first_node").alias("node"), "head")
    return found.filter("part IS NULL").select("node", "head").unionByName(on).filter("node <> head").distinct()


def _shingled(batches):
    """The distinct shingles of each text, sorted, as packed 64-bit values."""
    for batch in batches:
        out = []
        for _, part in chunks(as_bytes(batch.column(2))):
            values, owner = shingles(words(part))
            cut = np.searchsorted(owner, np.arange(len(part) + 1))
            out += [np.unique(values[a:b]).tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["node", "root", "shingles"])


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the texts of `left` and `right` (indexes into sets; the
    same array: each pair once) whose Jaccard index is at least `percent` hundredths.
    Shingles of the right side are listed with their texts; each left text counts what
    it meets there."""
    size = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate([sets[j] for j in right]) if len(right) else np.zeros(0, np.uint64)
    texts = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(values, kind="stable")
    values, texts = values[order], texts[order]
    out = []
    for n, i in enumerate(left.tolist()):
        a, b = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        many = b - a
        total = int(many.sum())
        if not total:
            continue
        at = np.repeat(a - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total)
        both = np.bincount(texts[at], minlength=len(right))
        either = size[i] + size[right] - both
        hit = np.flatnonzero((100 * both >= percent * either) & (both > 0))
        hit = hit[hit > n] if left is right else hit
        out.append((np.full(len(hit), i), right[hit], both[hit] / either[hit]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def _verify(percent: int):
    """Of two blocks of texts: how many links each text has (a = text, n), and links that
    connect the same texts as all of them do (a, b)."""

    def run(part: pa.Table) -> pa.Table:
        nodes = part.column("node").to_numpy()
        block = part.column("block").to_numpy()
        first, second = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()]
        left = np.flatnonzero(block == first)
        right = left if first == second else np.flatnonzero(block == second)
        i, j, _ = linked(sets, left, right, percent)
        count = np.bincount(np.concatenate([i, j]), minlength=len(nodes))
        parent = np.arange(len(nodes))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        tree = []
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                tree.append((int(nodes[x]), int(nodes[y])))
        seen = np.flatnonzero(count)
        a = [*nodes[seen].tolist(), *(t[0] for t in tree)]
        b = [*[None] * len(seen), *(t[1] for t in tree)]
        n = [*count[seen].tolist(), *[0] * len(tree)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _round(rows: DataFrame, percent: int, target: float) -> tuple[DataFrame, DataFrame]:
    """(texts: node and its least key; the links that verification found)."""
    signed = rows.mapInArrow(_signatures(percent, target), "key long, node long, signature binary, depth int")
    texts = checkpointed(signed.groupBy("node").agg(F.min("key").alias("rep"), F.first("signature").alias("signature"), F.first("depth").alias("depth")))
    sets = checkpointed(components(_forest(texts, depth_for(percent, target)), "node", "head"))
    blocks = sets.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = sets.join(texts.select("node", F.col("rep").alias("key")), "node")
    bodies = rows.join(members, ["node", "key"]).select("node", "root", "text").mapInArrow(_shingled, "node long, root long, shingles binary").dropDuplicates(["node"])
    placed = bodies.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "shingles")
    found = pairs.groupBy("root", "i", "j").applyInArrow(_verify(percent), "a long, b long, n long")
    return texts, checkpointed(found)


def similar(docs: DataFrame, percent: int = 80, target: float = 0.999, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, copy_of and n_links of each row.

    Texts are linked if their sets of five-word shingles (words of letters and digits,
    A-Z lower-cased) have a Jaccard index of at least `percent` hundredths. `n_links`
    counts the different texts a row's text is linked with, `copy_of` is the least
    doc_id with the very same text, `class_id` the least doc_id connected with the row
    by links and copies.

    A null text is empty. Texts without words are linked with none and are copies only
    of equal texts. A null doc_id counts as the smallest (and is null in the result);
    rows with one doc_id and different texts are judged each; repeated rows are copies;
    other columns are left out. Equal texts are told by a 64-bit hash."""
    rows = keyed(docs, doc_id, text)
    named = _classes(rows, percent, target)
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = rows.select("key", "node").join(named, "node")
    return out.select(given("key").alias("doc_id"), given("class").alias("class_id"), given("rep").alias("copy_of"), "n_links")


def _classes(rows: DataFrame, percent: int, target: float) -> DataFrame:
    """node, rep (its least key), class and own (the class is named after this text),
    n_links of each text."""
    texts, found = _round(rows, percent, target)
    links = found.filter("b is null and n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    classes = components(found.filter("b is not null"), "a", "b")
    named = texts.select("node", "rep").join(classes, "node", "left").join(links, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("first"))
    named = named.join(least, "root")
    return checkpointed(named.select("node", "rep", F.col("first.rep").alias("class"), (F.col("first.node") == F.col("node")).alias("own"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))


def representatives(docs: DataFrame, percent: int = 80, target: float = 0.999, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs`, all columns, with one row of each class that `similar` finds: that of its
    least doc_id (of repeated rows one, by the least hash of the whole row)."""
    rows = keyed(docs, doc_id, text).select("key", "node")
    chosen = _classes(keyed(docs, doc_id, text), percent, target).filter("own").select("node", F.col("rep").alias("key"))
    kept = rows.join(chosen, ["key", "node"]).groupBy("key", "node").agg(F.count(F.lit(1)).alias("_n"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    mine = docs.withColumn("_key", F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))).withColumn("_node", F.xxhash64(body))
    out = mine.join(kept.withColumnsRenamed({"key": "_key", "node": "_node"}), ["_key", "_node"])
    once, more = out.filter("_n = 1"), out.filter("_n > 1")
    first = more.groupBy("_key", "_node").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return once.select(*docs.columns).unionByName(first)


NO_ID = -(1 << 63)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key, node (hash of the text) and text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return small_batches(docs).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(body).alias("node"), body.alias("text"))
