"""Exact removal of byte strings that occur earlier, by sorted suffixes.

Suffixes are sorted where they can matter: every `length` bytes in a row hold an
anchor, the leftmost smallest `SEED`-byte hash among them, and equal strings hold it
at the same place. Anchors whose seed occurs once are left out. The suffixes at the
others are sorted in each task, front-coded (only what a suffix does not share with
the one before it is sent), and merged by loser trees that carry the length of the
common prefix with the last output, so that known prefixes are never compared again.
In the merged order the suffixes that share 100-x bytes stand together; with the x
bytes before the anchor equal too, they are the same string, and all but the earliest
are removed. Anchors with the same surroundings in one task are one suffix (the
earliest), so a group of copies of any size costs one suffix a task."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _VALUE, as_bytes, chunks, joined, mix, powers, prefix_hash, small_batches

SEED = 40
#: Suffixes that a task sorts at once.
RUN = 200_000
_NO_ID = -(1 << 63)


def anchors(data: np.ndarray, offset: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, seed hashes) of the anchors of joined texts."""
    n = len(data) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hash(data)
    seed = mix((prefix[SEED:] - prefix[:-SEED]) * powers(len(data) + 1)[1][:n])
    width = length - SEED + 1
    bits = np.uint64(max(20, int(n).bit_length()))
    least = (seed >> bits << bits) | np.arange(n, dtype=np.uint64)
    reach = 1  # smallest of `reach` in a row, doubled up to the window
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:]) if len(least) > reach else least[:0]
        reach *= 2
    if reach < width:
        step = width - reach
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
    whole = np.zeros(len(data) + 1, np.int32)  # windows that lie in one text
    ok = sizes >= length
    np.add.at(whole, offset[ok], 1)
    np.add.at(whole, offset[ok] + sizes[ok] - length + 1, -1)
    inside = np.cumsum(whole[: len(least)]) > 0
    mark = np.zeros(n, bool)
    mark[(least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    places = np.flatnonzero(mark)
    return places, seed[places]


def _packed(**arrays: np.ndarray) -> dict[str, bytes]:
    """Arrays as compressed bytes (the general codec of the shuffle is faster, but
    leaves these half as large again)."""
    codec = zstandard.ZstdCompressor(level=3)
    return {k: codec.compress(np.ascontiguousarray(v).tobytes()) for k, v in arrays.items()}


def _unpacked(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _rows(tag: str, names: tuple[str, ...], rows: list[tuple[int, dict[str, bytes]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), *[pa.array([x[n] for _, x in rows], pa.binary()) for n in names]], [tag, *names])


_ANCHORS = ("ids", "hashes", "doc", "pos", "seed")
_PLACES = ("ids", "hashes", "count", "pos")


def _anchor_blobs(length: int, buckets: int):
    """(bucket, anchors of a chunk of texts that fall in it), packed. Six bytes of a
    seed's hash travel; the bucket holds the rest of what tells seeds apart."""

    def run(batches):
        for batch in batches:
            key, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, part in chunks(as_bytes(batch.column(2)), 1 << 22):
                data, offset = joined(part)
                sizes = np.fromiter(map(len, part), np.int64, len(part))
                places, seeds = anchors(data, offset, sizes, length)
                doc = np.searchsorted(offset, places, side="right") - 1
                pos = places - offset[doc]
                bucket = (seeds % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.diff(bucket[order])) + 1
                rows = []
                for own in np.split(order, cut) if len(order) else ():
                    docs, local = np.unique(doc[own], return_inverse=True)
                    short = seeds[own].view(np.uint8).reshape(-1, 8)[:, 2:]
                    rows.append((int(bucket[own[0]]), _packed(ids=key[at + docs], hashes=h[at + docs], doc=np.diff(local, prepend=0).astype(np.uint32), pos=np.diff(pos[own], prepend=0).astype(np.int32), seed=short)))
                yield _rows("bucket", _ANCHORS, rows)

    return run


def _repeated(buckets: int):
    """Anchors whose seed occurs at two places, packed by the slot their document is in."""

    def run(batches):
        held = {n: [] for n in ("key", "h", "pos", "seed")}
        for batch in batches:
            tags = batch.column(0).to_numpy()
            for tag, ids, hashes, doc, pos, seed in zip(tags, *(batch.column(k).to_pylist() for k in range(1, 6))):
                doc = np.cumsum(_unpacked(doc, np.uint32))
                held["key"].append(_unpacked(ids, np.int64)[doc])
                held["h"].append(_unpacked(hashes, np.int64)[doc])
                held["pos"].append(np.cumsum(_unpacked(pos, np.int32)).astype(np.uint32))
                six = np.zeros((len(doc), 8), np.uint8)
                six[:, 2:] = _unpacked(seed, np.uint8).reshape(-1, 6)
                held["seed"].append(six.view(np.uint64).ravel() ^ np.uint64(int(tag) & 0xFFFF))
        if not held["key"]:
            return
        key, h, pos, seed = (np.concatenate(held.pop(n)) for n in ("key", "h", "pos", "seed"))
        order = np.argsort(seed, kind="stable")
        same = np.diff(seed[order]) == 0
        order = order[np.append(same, False) | np.append(False, same)]
        key, h, pos, seed = key[order], h[order], pos[order], seed[order]
        order = np.lexsort((pos, h, key, seed))
        key, h, pos, seed = key[order], h[order], pos[order], seed[order]
        # repeated rows of the table are one document and repeat nothing
        new = np.append(True, (np.diff(seed) != 0) | (np.diff(key) != 0) | (np.diff(h) != 0) | (np.diff(pos) != 0))[: len(key)]
        key, h, pos, seed = key[new], h[new], pos[new], seed[new]
        same = np.diff(seed) == 0
        twice = (np.append(same, False) | np.append(False, same))[: len(key)]
        key, h, pos = key[twice], h[twice], pos[twice]
        slot = (mix(key.view(np.uint64) ^ h.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((pos, h, key, slot))
        cut = np.flatnonzero(np.diff(slot[order])) + 1
        rows = []
        for own in np.split(order, cut) if len(order) else ():
            first = np.flatnonzero(np.append(True, (np.diff(key[own]) != 0) | (np.diff(h[own]) != 0)))
            rows.append((int(slot[own[0]]), _packed(ids=key[own[first]], hashes=h[own[first]], count=np.diff(np.append(first, len(own))), pos=pos[own])))
        yield _rows("slot", _PLACES, rows)

    return run


def _gathered(batches):
    """(key, h, places) of a slot's documents."""
    held = {n: [] for n in ("key", "h", "pos")}
    for batch in batches:
        for ids, hashes, count, pos in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
            count = _unpacked(count, np.int64)
            held["key"].append(np.repeat(_unpacked(ids, np.int64), count))
            held["h"].append(np.repeat(_unpacked(hashes, np.int64), count))
            held["pos"].append(_unpacked(pos, np.uint32))
    if not held["key"]:
        return
    key, h, pos = (np.concatenate(held.pop(n)) for n in ("key", "h", "pos"))
    order = np.lexsort((pos, h, key))
    key, h, pos = key[order], h[order], pos[order]
    first = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(h) != 0))[: len(key)])
    ends = np.append(first[1:], len(key))
    for a in range(0, len(first), 5_000):
        part = slice(a, a + 5_000)
        blobs = [pos[x:y].tobytes() for x, y in zip(first[part].tolist(), ends[part].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(key[first[part]]), pa.array(h[first[part]]), pa.array(blobs, pa.binary())], ["key", "h", "pos"])


def surroundings(data: np.ndarray, pos: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """A row of bytes for each anchor: the `length` bytes from it on (zeros past the
    text's end), how many they are, the bytes before it, the last first, and how many."""
    left = length - SEED
    out = np.zeros((len(pos), length + left + 2), np.uint8)
    after, before = np.minimum(length, end - pos), np.minimum(left, pos - start)
    col = np.arange(length)
    at = np.minimum(pos[:, None] + col, len(data) - 1)
    out[:, :length] = np.where(col < after[:, None], data[at], 0)
    out[:, length] = after
    col = np.arange(left)
    at = np.maximum(pos[:, None] - 1 - col, 0)
    out[:, length + 1 : -1] = np.where(col < before[:, None], data[at], 0)
    out[:, -1] = before
    return out


def _sorted_runs(length: int, buckets: int):
    """Front-coded sorted runs of a task's suffixes by bucket (kind 0), and stretches
    that are known to occur earlier in the same run (kind 1)."""
    names = ("lcp", "tail", "ids", "hashes", "places")

    def flush(held):
        rows, seeds = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        key, h, pos = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
        width = rows.shape[1]
        bucket = (seeds % np.uint64(buckets)).astype(np.int64)
        text = np.ascontiguousarray(rows).view(f"S{width}").ravel()
        order = np.lexsort((pos, h, key))  # the earliest of equal ones comes first
        order = order[np.argsort(text[order], kind="stable")]
        order = order[np.argsort(bucket[order], kind="stable")]
        rows, bucket, key, h, pos = rows[order], bucket[order], key[order], h[order], pos[order]
        differ = rows[1:] != rows[:-1]
        fresh = np.append(True, differ.any(axis=1))
        place = np.arange(len(rows))
        first = np.maximum.accumulate(np.where(fresh, place, 0))
        gone = ~fresh & ((key != key[first]) | (h != h[first]) | (pos != pos[first]))  # a repeated row is no repeat
        none = np.zeros(0, np.uint8)
        out = [(-1, _packed(lcp=none, tail=none, ids=key[gone], hashes=h[gone], places=np.stack([pos[gone] - rows[gone, -1], pos[gone] + rows[gone, length]], 1).astype(np.int64)))] if gone.any() else []
        rows, bucket, key, h, pos = rows[fresh], bucket[fresh], key[fresh], h[fresh], pos[fresh]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = rows[a:b]
            differ = own[1:] != own[:-1]
            lcp = np.append(0, differ.argmax(axis=1)).astype(np.uint8)
            tail = own[np.arange(width) >= lcp[:, None]]
            out.append((int(bucket[a]), _packed(lcp=lcp, tail=tail, ids=key[a:b], hashes=h[a:b], places=pos[a:b].astype(np.int64))))
        return _rows("bucket", names, out)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            key, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = [np.frombuffer(p, np.uint32).astype(np.int64) for p in batch.column(3).to_pylist()]
            for at, part in chunks(as_bytes(batch.column(2))):
                data, offset = joined(part)
                sizes = np.fromiter(map(len, part), np.int64, len(part))
                own = found[at : at + len(part)]
                doc = np.repeat(np.arange(len(part)), [len(x) for x in own])
                place = np.concatenate(own) + offset[doc]
                prefix = prefix_hash(data)
                seed = mix((prefix[place + SEED] - prefix[place]) * powers(len(data) + 1)[1][place])
                for a in range(0, len(place), RUN):
                    d, p = doc[a : a + RUN], place[a : a + RUN]
                    held.append((surroundings(data, p, offset[d], offset[d] + sizes[d], length), seed[a : a + RUN], key[at + d], h[at + d], p - offset[d]))
                    n += len(p)
                    if n >= RUN:
                        yield flush(held)
                        held, n = [], 0
        if held:
            yield flush(held)

    return run


def _decoded(lcp: bytes, tail: bytes, width: int) -> list[bytes]:
    out, at, last = [], 0, b""
    for shared in lcp:
        end = at + width - shared
        last = last[:shared] + tail[at:end]
        out.append(last)
        at = end
    return out


def merge(runs: list[tuple[bytes, list[bytes]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Order of all strings as (run, place in it), and the length of the prefix each
    shares with the one before, by a loser tree over the runs' heads. Strings are of
    one width; `runs` gives for each the shared prefixes with its own predecessor.

    An inner node keeps the loser of its match and the prefix it shares with the
    winner. Both sides of a later match know what they share with the last output: the
    one that shares more is smaller, and only at equality are bytes compared, from
    there on."""
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    size = [len(x[1]) for x in runs] + [0] * (k - len(runs))
    head = [runs[r][1][0] if r < len(runs) and size[r] else None for r in range(k)]
    shared = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix becomes that with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        i, j = shared[a], shared[b]
        if i > j:
            return a, b
        if j > i:
            return b, a
        p, q = x[i:], y[i:]
        if p == q:
            win, lose, same = (a, b, len(x)) if a < b else (b, a, len(x))
        else:
            same = i + (8 * len(p) - (int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_length()) // 8
            win, lose = (a, b) if p < q else (b, a)
        shared[lose] = same
        return win, lose

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, loser[node] = play(build(2 * node), build(2 * node + 1))
        return win

    order, prefix = [], []
    best = build(1) if k > 1 else 0
    while head[best] is not None:
        order.append((best, at[best]))
        prefix.append(shared[best])
        at[best] += 1
        n = at[best]
        if n < size[best]:
            head[best], shared[best] = runs[best][1][n], runs[best][0][n]
        else:
            head[best] = None
        node = (best + k) // 2
        while node:
            best, loser[node] = play(best, loser[node])
            node //= 2
    return order, prefix


def _earlier(length: int):
    """Stretches of a bucket's suffixes that occur earlier: key, h, start, end."""
    left = length - SEED
    width = length + left + 2

    def done(key, h, start, end):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(h, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["key", "h", "start", "end"])

    def of(runs):
        kinds = {"lcp": np.uint8, "tail": np.uint8, "ids": np.int64, "hashes": np.int64, "places": np.int64}
        runs = [{n: _unpacked(x[n], kind) for n, kind in kinds.items()} for x in runs]
        runs = [x | {"strings": _decoded(x["lcp"].tobytes(), x["tail"].tobytes(), width)} for x in runs]
        order, lcp = merge([(x["lcp"].tolist(), x["strings"]) for x in runs])
        base = np.concatenate([[0], np.cumsum([len(x["lcp"]) for x in runs])])
        at = np.array([base[r] + i for r, i in order], np.int64)
        key, h, pos = (np.concatenate([x[n] for x in runs])[at] for n in ("ids", "hashes", "places"))
        text = np.frombuffer(b"".join(b"".join(x["strings"]) for x in runs), np.uint8).reshape(-1, width)
        after, before = text[at, length].astype(np.int64), text[at, width - 1].astype(np.int64)
        lcp = np.minimum(np.array(lcp, np.int64), length)
        lcp[1:] = np.minimum(lcp[1:], np.minimum(after[1:], after[:-1]))
        lcp[0] = 0
        # alone with its seed: nothing to compare
        near = np.append(lcp[1:] >= SEED, False) | (lcp >= SEED)
        keep = np.flatnonzero(near)
        if not len(keep):
            return None
        key, h, pos, after, before, at, lcp = key[keep], h[keep], pos[keep], after[keep], before[keep], at[keep], lcp[keep]
        order = np.lexsort((pos, h, key))
        moved = (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1]) | (pos[order][1:] != pos[order][:-1])
        rank = np.empty(len(keep), np.int64)  # places in the corpus; a repeated row has the same
        rank[order] = np.concatenate([[0], np.cumsum(moved)])
        most, least = np.full(len(keep), -1), np.full(len(keep), length)
        back = np.zeros(len(keep), np.uint64)
        for x in range(left + 1):
            if x:  # hash of the x bytes before the anchor
                back = mix(back + _VALUE[text[at, length + x]])
            fit = np.flatnonzero((before >= x) & (after >= length - x))
            if not len(fit):
                continue
            group = np.cumsum(lcp < length - x).astype(np.uint64)[fit]
            same = mix(back[fit] ^ mix(group))
            order = np.lexsort((rank[fit], same))
            again = np.append(False, same[order][1:] == same[order][:-1])
            ranks = rank[fit[order]]
            later = ranks > ranks[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
            hit = fit[order[later]]
            most[hit] = x
            least[hit] = np.minimum(least[hit], x)
        hit = most >= 0
        return done(key[hit], h[hit], pos[hit] - most[hit], pos[hit] - least[hit] + length)

    def run(batches):
        runs: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    span = _unpacked(row["places"], np.int64).reshape(-1, 2)
                    yield done(_unpacked(row["ids"], np.int64), _unpacked(row["hashes"], np.int64), span[:, 0], span[:, 1])
                else:
                    runs.setdefault(row["bucket"], []).append(row)
        for bucket in sorted(runs):
            if (out := of(runs.pop(bucket))) is not None:
                yield out

    return run


def _rest(text: bytes, spans) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs of them, what is left)."""
    merged: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    cuts = [0, *(x for run in merged for x in run), len(text)]
    return sum(b - a for a, b in merged), len(merged), b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def repeats(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and spans (start, end in UTF-8 bytes; they may overlap) of the bytes
    that a `length`-byte string covers which also starts earlier: in a smaller doc_id,
    or in the same document before.

    A null text is empty; a null doc_id counts as the smallest; rows with the same
    doc_id and text are one document (both rows are returned, neither removes the
    other), rows with the same doc_id and different texts go by the text's hash; other
    columns are left out; doc_id must be an integer."""
    if not SEED < length <= (253 + SEED) // 2:
        raise ValueError(f"length {length}: one byte holds a shared prefix, and a seed has {SEED} bytes")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = small_batches(docs).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("key"), F.xxhash64(body).alias("h"), body.alias("text"))
    blobs = lambda names: ", ".join(f"{n} binary" for n in names)
    found = rows.mapInArrow(_anchor_blobs(length, buckets), f"bucket int, {blobs(_ANCHORS)}").repartition(buckets, "bucket")
    twice = found.mapInArrow(_repeated(buckets), f"slot int, {blobs(_PLACES)}").repartition(buckets, "slot").mapInArrow(_gathered, "key long, h long, pos binary")
    runs = rows.join(twice.hint("shuffle_hash"), ["key", "h"]).select("key", "h", "text", "pos").mapInArrow(_sorted_runs(length, buckets), "bucket int, lcp binary, tail binary, ids binary, hashes binary, places binary")
    gone = runs.repartition(buckets, "bucket").mapInArrow(_earlier(length), "key long, h long, start long, end long")
    spans = gone.groupBy("key", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    out = rows.join(spans.hint("shuffle_hash"), ["key", "h"], "left")
    return out.select(F.when(F.col("key") != _NO_ID, F.col("key")).alias("doc_id"), "text", "spans")


def deduplicated(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that
    remain) and kept_sha256 of each row; see `repeats`."""

    def run(batches):
        for batch in batches:
            out = []
            for t, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                removed, n, kept = _rest(t, spans)
                out.append((len(t), removed, n, kept, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return repeats(docs, length, doc_id, text).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
