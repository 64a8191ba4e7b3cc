"""How filters overlap: what each removes in every order in which they could be applied.

Every filter keeps a sorted list of the rows that fail it, part by part and id range
by id range. Unions of the lists are k-way merges that gallop: the list whose head is
least runs on, by doubling steps, as far as the next head of another list. What a filter
removes after others is the difference of its list and their union, told in the same
way. A range gives sizes only, and sizes of ranges add up, so a part may be of any size
and no list outgrows an Arrow batch."""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed
from ..functions.text import let

FILTERS = ("A", "B", "C", "D", "E")
#: Rows of a range: what one set of lists holds.
RANGE = 1 << 15
_SPACE = r"[\x20\x09-\x0D]+"


def gallop(ids: list[int], x: int, start: int) -> int:
    """First place from `start` on whose id is not under x: doubling steps, then halving."""
    step, n = 1, len(ids)
    while start + step < n and ids[start + step] < x:
        step <<= 1
    return bisect_left(ids, x, start + (step >> 1), min(start + step, n))


def union(lists: list[list[int]]) -> list[int]:
    """Sorted union of sorted lists of distinct ids."""
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapify(heads)
    out: list[int] = []
    while len(heads) > 1:
        x, k, at = heads[0]
        ids, other = lists[k], min(h[0] for h in heads[1:3])
        end = gallop(ids, other, at) if other > x else at
        out += ids[at:end]
        if end < len(ids) and ids[end] == other:  # two lists hold it: the other one gives it
            end += 1
        if end < len(ids):
            heapreplace(heads, (ids[end], k, end))
        else:
            heappop(heads)
    if heads:
        _, k, at = heads[0]
        out += lists[k][at:]
    return out


def difference(ids: list[int], other: list[int]) -> list[int]:
    """The ids that are not in `other`; runs between two of its ids are taken whole."""
    out: list[int] = []
    at = there = 0
    while at < len(ids) and there < len(other):
        there = gallop(other, ids[at], there)
        if there == len(other):
            break
        end = gallop(ids, other[there], at) if ids[at] != other[there] else at
        out += ids[at:end]
        at = end + (end < len(ids) and ids[end] == other[there])
    out += ids[at:]
    return out


def common(ids: list[int], other: list[int]) -> int:
    """How many ids are in both."""
    if len(other) < len(ids):
        ids, other = other, ids
    n = at = 0
    for x in ids:
        at = gallop(other, x, at)
        if at == len(other):
            break
        n += other[at] == x
    return n


def _sizes(failing: list[list[int]], marked: list[list[int]]) -> np.ndarray:
    """[set, filter, measure]: for each set of filters (bits) and each filter not in it, the
    rows that fail the filter and none of the set: all, and of each marked list."""
    n = len(failing)
    out = np.zeros((1 << n, n, 1 + len(marked)), np.int64)
    for chosen in range(1 << n):
        gone = union([failing[k] for k in range(n) if chosen >> k & 1])
        for k in range(n):
            if not chosen >> k & 1:
                left = difference(failing[k], gone)
                out[chosen, k] = [len(left), *(common(m, left) for m in marked)]
    return out


def _measure(n_filters: int, n_marks: int):
    """part, rows of it and the sizes of its lists, from rows sorted by part and id."""
    schema = pa.schema([("part", pa.string()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = None, 0, None
        done: list[tuple] = []
        for batch in batches:
            names = batch.column(0)
            fails = batch.column(1).to_numpy(zero_copy_only=False)
            marks = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(names.dictionary_encode().indices.to_numpy(), prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(names)]):
                name = names[a].as_py()
                if total is not None and name != part:
                    done.append((part, n, total))
                    n, total = 0, None
                part = name
                for low in range(a, b, RANGE):
                    bits, flags = fails[low : min(b, low + RANGE)], marks[low : min(b, low + RANGE)]
                    lists = [np.flatnonzero(bits >> k & 1).tolist() for k in range(n_filters)]
                    sizes = _sizes(lists, [np.flatnonzero(flags >> k & 1).tolist() for k in range(n_marks)])
                    total, n = sizes if total is None else total + sizes, n + len(bits)
            if len(done) >= 256:
                yield _table(done, schema)
                done = []
        if total is not None:
            done.append((part, n, total))
        if done:
            yield _table(done, schema)

    return run


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    part, n, sizes = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(n, pa.int64()), pa.array([s.ravel().tolist() for s in sizes], pa.list_(pa.int64()))], schema=schema)


def _orders(filters: tuple[str, ...], marks: tuple[str, ...]):
    """Every order and step of each part, from the sums of its sizes."""
    n, whole = len(filters), (1 << len(filters)) - 1
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{m}_lost" for m in marks), "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows, flat in zip(*(c.to_pylist() for c in batch.columns)):
                sizes = np.array(flat, np.int64).reshape(1 << n, n, 1 + len(marks))
                shapley = [sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * int(sizes[s, k, 0]) for s in range(1 << n) if not s >> k & 1) for k in range(n)]
                out = []
                for order in permutations(range(n)):
                    gone, kept = 0, rows
                    for step, k in enumerate(order, 1):
                        removed, *lost = sizes[gone, k].tolist()
                        kept -= removed
                        unique = int(sizes[whole & ~(1 << k), k, 0])
                        out.append((part, "".join(filters[j] for j in order), step, kept, removed, int(sizes[0, k, 0]) - removed, unique, *lost, shapley[k]))
                        gone |= 1 << k
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names).cast(pa.schema([(c, pa.string() if c in names[:2] else pa.int32() if c == "step" else pa.int64()) for c in names]))

    return run


def interactions(rows: DataFrame, filters: tuple[str, ...] = FILTERS, marks: tuple[str, ...] = (), part: str = "part", row_id: str = "doc_id") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, `<mark>_lost` of each
    mark, and shapley, for every part, order of the filters and step of the order.

    `rows` has a boolean column for each filter (true: the row fails it; null: it does not)
    and for each mark (rows whose loss is counted apart). Filters are told by one letter
    each and are at most eight. Every row counts, also with a null or repeated id; a null
    part is the part ''; other columns are left out; no rows give no rows. `shapley` is what
    the step's filter removes, summed over all orders."""
    if not 0 < len(filters) <= 8 or len(set("".join(filters))) != sum(map(len, filters)) != len(filters):
        raise ValueError("one to eight filters of one letter each")
    bits = lambda names: sum((F.when(F.col(c), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(names)), F.lit(0)).cast("int")
    slim = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(row_id).alias("id"), bits(filters).alias("fails"), bits(marks).alias("marks"))
    slim = checkpointed(slim).withColumn("place", F.monotonically_increasing_id())  # rows of one id can lie in several ranges
    dealt = slim.repartitionByRange("part", "id", "place").sortWithinPartitions("part", "id", "place")
    sizes = dealt.select("part", "fails", "marks").mapInArrow(_measure(len(filters), len(marks)), "part string, n long, sizes array<long>")
    each = sizes.select("part", "n", F.posexplode("sizes").alias("at", "size")).groupBy("part", "at").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    whole = each.groupBy("part").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "size"))), lambda x: x["size"]).alias("sizes"))
    counts = ", ".join(f"{c} long" for c in ["kept", "removed", "redundant", "unique_fails", *(f"{m}_lost" for m in marks), "shapley"])
    return whole.select("part", "n", "sizes").mapInArrow(_orders(filters, marks), f"part string, filter_order string, step int, {counts}")


def text_filters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part and the verdicts A to E of each row (true: it fails).

    A: under 200 words; B: under half of the words are different; C: over 3 in 100
    characters are A to Z; D: holds one of `#$%&*|`; E: the text of a smaller doc_id
    anywhere in the table. Words are what stands between spaces and \\x09 to \\x0D. A null
    text is empty; rows of one doc_id are judged each; a row without doc_id is nobody's copy
    and nobody's original."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(body, _SPACE), lambda w: w != "")
    upper = F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    facts = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.md5(body.cast("binary"))).alias("digest"), F.length(body).alias("chars"), upper.alias("upper"),
        body.rlike(r"[#$%&*|]").alias("D"), let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different"))).alias("words"),
    )
    facts = checkpointed(facts.select(
        "doc_id", "part", "digest", (F.col("words.n") < 200).alias("A"), (100 * F.col("words.different") < 50 * F.col("words.n")).alias("B"), (100 * F.col("upper") > 3 * F.col("chars")).alias("C"), "D",
    ))
    # one key a text and id, not one a text: however many copies a text has, its rows spread
    first = facts.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    return facts.join(first, ["digest", "doc_id"], "left").withColumn("E", F.col("first").isNull() & F.col("doc_id").isNotNull()).drop("digest", "first")


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`rows` with good and toxic: a label row of the same doc_id has quality 1, toxic 1.
    Several labels of a document count together; without doc_id or label it is neither."""
    told = labels.groupBy(F.col("doc_id").alias(doc_id)).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.drop("good", "toxic").join(told, doc_id, "left").fillna(False, ["good", "toxic"])
