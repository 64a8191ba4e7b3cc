"""Near duplicates: banded MinHash candidates, verified sequentially.

Texts meet in the buckets of their bands. A pair is told apart on signatures a batch of
values at a time: under a uniform prior, the agreements seen so far give the posterior
of the similarity, and the pair goes as soon as the chance that it reaches the threshold
is under the chosen miss probability. What is left after the last batch is compared on
the full shingle sets.

A bucket costs its size, not its square. Each member is compared with the bucket's least
one; only members that this leaves unconnected are then compared with the rest, in
blocks of a bounded number of texts, and blocks give links that connect the same texts,
not all links. The exact step works alike on sets of texts that pruned pairs connect."""
from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed
from .arrays import as_bytes, chunks, lists, mix, windows, words
from .graph import components

SHINGLE = 4
BANDS, ROWS = 32, 5
VALUES = BANDS * ROWS
#: Signature values compared at a time.
BATCH = 32
#: Texts of a block; pairs compared at a time.
BLOCK, PAIRS = 512, 1 << 17
#: Bytes of words: all but the space and \\x09 to \\x0D.
_WORD_BYTES = np.ones(256, bool)
_WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False
_SALTS = np.random.default_rng(13).integers(1, 1 << 32, (VALUES, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


@cache
def needed(percent: int, miss: float) -> tuple[int, ...]:
    """Least agreements after each batch of values at which a pair stays: the posterior
    chance of a similarity of `percent` hundredths, under a uniform prior, is not under
    `miss`. With m of n agreements it is the chance of at most m hits in n + 1 draws."""
    out = []
    for n in range(BATCH, VALUES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * (percent / 100) ** m * (1 - percent / 100) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def agreeing(a: np.ndarray, b: np.ndarray, need: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(rows that no batch prunes, their agreements) of two arrays of signatures, row by row."""
    alive, seen = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(need):
        part = slice(k * BATCH, (k + 1) * BATCH)
        seen = seen + (a[alive, part] == b[alive, part]).sum(1, dtype=np.int32)
        stay = seen >= least
        alive, seen = alive[stay], seen[stay]
    return alive, seen


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard index of at least `percent` hundredths."""
    if len(b) < len(a):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def sets_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's distinct shingles. Fewer words than a shingle's, but
    not none, are one shingle."""
    for _, part in chunks(texts):
        w = words(part, _WORD_BYTES)
        all_ = windows(w.hash, SHINGLE)
        for first, n in zip(w.first.tolist(), w.counts.tolist()):
            if n >= SHINGLE:
                yield np.unique(all_[first : first + n - SHINGLE + 1])
            else:
                yield windows(w.hash[first : first + n], n) if n else np.zeros(0, np.uint64)


def name_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets."""
    return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, body, node (name of the set), n_shingles, signature and bands of (key, body, text)."""
    for batch in batches:
        nodes, sizes, signatures, bands, counts = [], [], [], [], []
        texts = as_bytes(batch.column(2))
        for at, part in chunks(texts):
            sets = list(sets_of(part))
            n = np.array([len(s) for s in sets], np.int64)
            sizes.append(n)
            counts.append(np.where(n > 0, BANDS, 0))
            nodes += [name_of(s) if len(s) else None for s in sets]
            own = np.flatnonzero(n)
            if not len(own):
                signatures += [None] * len(sets)
                continue
            x = (np.concatenate([sets[i] for i in own]) >> np.uint64(32)).astype(np.uint32)
            first = np.concatenate([[0], np.cumsum(n[own])[:-1]])
            least = np.empty((len(own), VALUES), np.uint32)
            for k, (a, b) in enumerate(_SALTS):
                v = (x ^ a) * b
                v ^= v >> np.uint32(15)
                v *= a
                least[:, k] = np.minimum.reduceat(v, first)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(own), BANDS)).copy()
            for row in range(ROWS):
                key = mix(key ^ least[:, row::ROWS])
            bands.append(key.ravel().view(np.int64))
            short = (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)
            found = iter(short)
            signatures += [next(found).tobytes() if size else None for size in n.tolist()]
        flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(signatures, pa.binary()), lists(flat, np.concatenate(counts) if counts else np.zeros(0, np.int64))],
            ["key", "body", "node", "n_shingles", "signature", "bands"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def _stars(percent: int, miss: float):
    """a, b and agreements of the pairs that no batch prunes."""

    def run(batches):
        for batch in batches:
            alive, seen = agreeing(_matrix(batch.column(2)), _matrix(batch.column(3)), needed(percent, miss))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive)), pa.array(seen, pa.int32())], ["a", "b", "agreements"])

    return run


def _confirmed(percent: int):
    """a, b of the pairs whose sets are alike."""

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3))
            good = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in pairs]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by their first three columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        cut = int(np.flatnonzero(_edges(table))[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def _edges(table: pa.Table) -> np.ndarray:
    """True at the first row of each group."""
    new = np.zeros(table.num_rows, bool)
    for k in range(3):
        values = table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    new[0] = True
    return new


def _pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) rows of each group's left and right side, with different labels, each
    pair once, some at a time. Of a group's rows those of the right side come first."""
    left_side, node, label, rest = (table.column(c).to_numpy() for c in ("left", "node", "label", "rest"))
    start = np.flatnonzero(_edges(table))
    group = np.cumsum(_edges(table)) - 1
    rights = np.bincount(group[left_side == 0], minlength=len(start))
    left = np.flatnonzero(left_side)
    total = np.cumsum(rights[group[left]])
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        some = left[at:end]
        many = rights[group[some]]
        a = np.repeat(some, many)
        b = np.repeat(start[group[some]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        keep = (label[a] != label[b]) & ~((rest[b] != 0) & (node[b] >= node[a]))
        yield a[keep], b[keep]
        at = end


class _Union:
    """Labels that links have connected so far."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, a: int, b: int) -> None:
        self.parent[max(a, b)] = min(a, b)


def _compared(percent: int, miss: float, exact: bool):
    """Links between labels that connect the same labels as all links of the blocks do:
    of pairs that no batch prunes, or (`exact`) of those whose sets are alike."""

    def run(batches):
        need = needed(percent, miss)
        for table in _whole_groups(batches):
            label = table.column("label").to_numpy()
            signature = _matrix(table.column("signature"))
            sets = table.column("shingles") if exact else None
            known, links = _Union(), []
            for a, b in _pairs(table):
                alive, seen = agreeing(signature[a], signature[b], need)
                alive = alive[np.argsort(-seen, kind="stable")]  # the likeliest first: they spare others
                for i, j in zip(a[alive].tolist(), b[alive].tolist()):
                    x, y = known.find(int(label[i])), known.find(int(label[j]))
                    if x != y and (not exact or alike(*(np.frombuffer(sets[k].as_buffer(), np.uint64) for k in (i, j)), percent)):
                        known.join(x, y)
                        links.append((int(label[i]), int(label[j])))
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _blocks(members: DataFrame, bodies: DataFrame, percent: int, miss: float, exact: bool) -> DataFrame:
    """Links (a, b) between labels of one bucket. `members` is (bucket, node, label), `bodies`
    has the node's signature and, for exact links, shingles.

    The rows with the bucket's most common label need no comparison with each other. All
    others, in blocks, meet all rows, in blocks: a few strangers in a bucket of copies cost
    its size times their blocks."""
    held = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    split = held.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("n").alias("total"), F.max("n").alias("most"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    parts = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    split = split.select("bucket", "major", parts(F.col("total")).alias("rights"), parts(F.col("total") - F.col("most")).alias("lefts"))
    rows = members.join(split, "bucket").withColumn("rest", (F.col("label") != F.col("major")).cast("int"))
    place = lambda i, j, left: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(left).alias("left"))
    mine = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: place(i, mine(1, "rights"), 0))
    left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: place(mine(2, "lefts"), j, 1))
    rows = rows.withColumn("at", F.explode(F.when(F.col("rest") == 1, F.concat(right, left)).otherwise(right)))
    payload = ["signature", "shingles"] if exact else ["signature"]
    rows = rows.select("bucket", "at.i", "at.j", "at.left", "node", "label", "rest").join(bodies.select("node", *payload), "node")
    rows = rows.select("bucket", "i", "j", "left", "node", "label", "rest", *payload).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "left")
    return checkpointed(rows.mapInArrow(_compared(percent, miss, exact), "a long, b long").distinct())


def _labelled(nodes: DataFrame, connected: DataFrame) -> DataFrame:
    """`nodes` with the label that (node, root) rows give them, else their own."""
    return nodes.join(connected.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _extended(connected: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) rows after more links between roots (or nodes not connected so far). Only
    what the links touch is searched again."""
    if links.isEmpty():
        return connected
    tops = components(links, "a", "b")
    moved = connected.join(tops.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return checkpointed(moved.unionByName(tops.join(connected.select("node"), "node", "left_anti")))


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and its shingles, of texts (text, node, signature) that are the node's."""
    for batch in batches:
        node = batch.column(1).to_pylist()
        out = [x.tobytes() if len(x) and name_of(x) == node[k] else None for k, x in enumerate(sets_of(as_bytes(batch.column(0))))]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["node", "signature", "shingles"])


def near_duplicates(docs: DataFrame, percent: int = 80, miss: float = 1e-6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    A text's set has its different runs of four words (what stands between spaces and
    \\x09 to \\x0D, A-Z lower-cased); fewer words, but not none, are one run. Texts are
    linked if their sets have a Jaccard index of at least `percent` hundredths;
    `component_id` is the least doc_id that links connect with the row, and `kept` says
    that it is the row's own. At the threshold itself a link is found with a chance of
    1 - 3e-6 by the bands (of 0.8) and 1 - 5 `miss` by the batches, above it more surely;
    no pair under it is ever linked.

    A null text is empty; texts without words are linked with none, also not with each
    other. A null doc_id is never another row's component_id; such a row has the least of
    its links (null without one, and is then kept). Rows of one doc_id and different texts
    are judged each; repeated rows are alike; other columns are left out. Words, runs and
    equal sets are told by 64-bit hashes."""
    kind = docs.schema[doc_id].dataType.simpleString()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("key"), F.xxhash64(body).alias("body"), body.alias("text"))
    signed = checkpointed(rows.mapInArrow(_signed, f"key {kind}, body long, node long, n_shingles long, signature binary, bands array<long>"))
    nodes = checkpointed(signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("key", "body")).alias("of"), F.min("key").alias("least"), F.first("signature").alias("signature"), F.first("bands").alias("bands")))

    # buckets: everyone against the least of each of its buckets
    met = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    candidates = checkpointed(met.join(shared, "bucket"))
    signatures = nodes.select("node", "signature")
    pairs = candidates.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    pairs = pairs.join(signatures.toDF("a", "left"), "a").join(signatures.toDF("b", "right"), "b").select("a", "b", "left", "right")
    likely = checkpointed(pairs.mapInArrow(_stars(percent, miss), "a long, b long, agreements int"))

    # what that leaves apart in buckets of three and more, against the rest of the bucket
    met = likely.select(F.col("a").alias("node"), F.col("b").alias("first"), F.lit(True).alias("hit"))
    members = candidates.filter("n > 2").join(met, ["node", "first"], "left").select("bucket", "node", F.when(F.col("hit"), F.col("first")).otherwise(F.col("node")).alias("label"))
    more = _blocks(members, signatures, percent, miss, exact=False)
    linked = checkpointed(components(likely.select("a", "b").unionByName(more), "a", "b"))

    # exact: each text against its likeliest partner, then what that leaves apart
    wanted = linked.join(nodes.select("node", "of", "signature"), "node").select("node", F.col("of.key").alias("k"), F.col("of.body").alias("b"), "signature")
    texts = rows.join(wanted, rows["key"].eqNullSafe(wanted["k"]) & (rows["body"] == wanted["b"]))
    bodies = checkpointed(texts.select("text", "node", "signature").mapInArrow(_bodies, "node long, signature binary, shingles binary").filter("shingles is not null").dropDuplicates(["node"]))
    best = likely.groupBy("a").agg(F.max_by("b", F.struct("agreements", "b")).alias("b"))
    shingles = bodies.select("node", "shingles")
    stars = best.join(shingles.toDF("a", "left"), "a").join(shingles.toDF("b", "right"), "b").select("a", "b", "left", "right")
    sure = checkpointed(stars.mapInArrow(_confirmed(percent), "a long, b long"))
    connected = components(sure, "a", "b")
    apart = _labelled(linked.select("node", F.col("root").alias("bucket")), connected)
    connected = _extended(connected, _blocks(apart, bodies, percent, miss, exact=True))

    named = _labelled(nodes.select("node", "least"), connected)
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    named = named.join(least, "label").select("node", "component")
    out = signed.select("key", "node", "n_shingles").join(named, "node", "left")
    component: Column = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component"))
    return out.select(F.col("key").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
