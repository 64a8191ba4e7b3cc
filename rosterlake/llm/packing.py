"""Best-fit packing of token pieces into sequences of a fixed length.

Hierarchical residual packing: every partition packs its own pieces best-fit and
emits the bins that are nearly full; bins that are not go on as items to a round
with an eighth of the partitions, where they are packed again, until one
partition is left or a round no longer brings bins together. Only lengths move;
texts are read once, where they lie."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed
from . import bpe
from .arrays import small_batches

MEMBER = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint>"
BIN = f"used int, members array<{MEMBER}>"
#: Items that a task packs at once; a larger partition is packed in such groups.
GROUP = 200_000
#: Partitions that one partition of the next round takes over.
FAN_IN = 8


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items by falling size, each into the bin with the least room that still
    takes it. `open_` has the bins by room, `rooms` a bit for each room there is."""
    open_: dict[int, list[list[int]]] = {}
    rooms, bins = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            into = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            room, into = capacity, []
            bins.append(into)
        into.append(i)
        left = room - size
        if left:
            open_.setdefault(left, []).append(into)
            rooms |= 1 << left
    return bins


def _table(members: dict[str, np.ndarray], offsets: np.ndarray, capacity: int) -> pa.RecordBatch:
    """Items (lists of members) packed into bins, as one batch."""
    sizes = np.add.reduceat(members["length"], offsets[:-1]) if len(offsets) > 1 else np.zeros(0, np.int64)
    bins = best_fit(sizes, capacity)
    order = [np.arange(offsets[i], offsets[i + 1]) for b in bins for i in b]
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    counts = np.array([sum(int(offsets[i + 1] - offsets[i]) for i in b) for b in bins], np.int64)
    used = np.array([int(sizes[b].sum()) for b in bins], np.int32)
    fields = [pa.array(members["doc_id"][order], pa.int64(), mask=members["no_id"][order]), pa.array(members["piece"][order], pa.int32())]
    fields += [pa.array(members[c][order], pa.int64()) for c in ("start", "length", "ids_crc32")]
    flat = pa.StructArray.from_arrays(fields, ["doc_id", "piece", "start", "length", "ids_crc32"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat)
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), lists], ["used", "members"])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[dict[str, np.ndarray]]:
    """Pieces of the documents, in groups: ids, then id 0, cut into `capacity`."""
    encoder = bpe.encoder(path)
    rows: list[tuple] = []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encoder.ids(text.as_py() or "") + b"\0\0\0\0"
            n, start = len(ids) // 4, 0
            for piece in range(-(-n // capacity)):
                size = (n - start) % capacity or capacity
                rows.append((doc or 0, doc is None, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                start += size
        if len(rows) >= GROUP:
            yield _columns(rows)
            rows = []
    if rows:
        yield _columns(rows)


def _columns(rows: list[tuple]) -> dict[str, np.ndarray]:
    doc, no_id, piece, start, length, crc = zip(*rows)
    return {"doc_id": np.array(doc, np.int64), "no_id": np.array(no_id, bool), "piece": np.array(piece, np.int32), "start": np.array(start, np.int64), "length": np.array(length, np.int64), "ids_crc32": np.array(crc, np.int64)}


def _first_round(path: str, capacity: int):
    def run(batches):
        try:
            for members in _pieces(batches, path, capacity):
                yield _table(members, np.arange(len(members["length"]) + 1), capacity)
        finally:  # the worker goes on to other tasks
            bpe.encoder(path).forget()

    return run


def _next_round(capacity: int):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= GROUP:
                yield repack(held)
                held, n = [], 0
        if held:
            yield repack(held)

    def repack(held):
        column = pa.Table.from_batches(held).column("members").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        flat, offsets = column.flatten(), column.offsets.to_numpy()
        get = lambda c: flat.field(c)
        members = {c: get(c).to_numpy(zero_copy_only=False) for c in ("piece", "start", "length", "ids_crc32")}
        members |= {"doc_id": get("doc_id").fill_null(0).to_numpy(), "no_id": get("doc_id").is_null().to_numpy(zero_copy_only=False)}
        return _table(members, offsets - offsets[0], capacity)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, slack: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of each row of `docs`: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    A document is its ids (`tokenizer`: a byte-level BPE .json), then id 0; a longer
    one than `capacity` is cut, the first piece taking what does not fill a whole one.
    Bins with at most `slack` free places are emitted at once. A null text is empty
    (one piece of one id); a null doc_id stays null; repeated rows are packed each
    for itself; other columns are left out; no rows give no rows."""
    items = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    bins = checkpointed(items.mapInArrow(_first_round(tokenizer, capacity), BIN))
    parts = max(1, items.rdd.getNumPartitions())
    emitted, open_ = [bins.filter(F.col("used") >= capacity - slack)], bins.filter(F.col("used") < capacity - slack)
    before = open_.count()
    while before > 1 and parts > 1:
        least = -(-before // GROUP)
        parts = max(-(-parts // FAN_IN), least)
        bins = checkpointed(open_.repartition(parts).mapInArrow(_next_round(capacity), BIN))
        open_ = bins.filter(F.col("used") < capacity - slack)
        after = open_.count()
        emitted.append(bins.filter(F.col("used") >= capacity - slack))
        stuck = parts == least and 50 * (before - after) < after
        before = after
        if stuck:  # more than a task takes, and nothing much fits together any more
            break
    out = open_
    for part in emitted:
        out = out.unionByName(part)
    placed = out.select(F.monotonically_increasing_id().alias("sequence_id"), F.expr("""
        transform(members, (m, i) -> struct(m AS m, aggregate(slice(members, 1, i), 0L, (a, x) -> a + x.length) AS offset))""").alias("p"))
    return placed.select("sequence_id", F.explode("p").alias("p")).select("p.m.*", "sequence_id", F.col("p.offset").alias("offset"))
