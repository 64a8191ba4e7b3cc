"""Benchmark decontamination with a generalised suffix automaton.

The automaton reads the test items' words; training words then stream through it,
and at each word it knows the longest stretch ending there that some item holds.
Items are taken in blocks of a bounded number of words, one automaton a block. A task
opens one block after another, so what a worker holds does not grow with the
benchmark; each block sees all rows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import as_bytes, chunks, small_batches, words

WINDOW = 10
#: Item words of one automaton (some 100 MB in a Python worker).
BLOCK_WORDS = 200_000
#: Bytes of texts that one block after another reads, where there are several.
TURN = 1 << 25


class Automaton:
    """Generalised suffix automaton over word ids.

    `go`, `link` and `length` are the usual ones. `items_at[v]` has the items of
    whose windows state v is the longest match: found by walking each item once."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, ids in items:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.items_at: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, ids in items:
            for _, v in self._windows(ids):
                self.items_at.setdefault(v, set()).add(item)
            if 0 < len(ids) < window:
                v = 0
                for c in ids:
                    v = self.go[v][c]
                self.short.setdefault(v, []).append((len(ids), item))
        # a state's own short items and those of the shorter matches below it
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if below := self.short.get(self.link[v]):
                self.short[v] = self.short.get(v, []) + below

    def _extend(self, last: int, c: int) -> int:
        go, link, length = self.go, self.link, self.length
        if c in go[last]:
            q = go[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.go)
        self.go.append(dict(self.go[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = new
            p = self.link[p]
        return new

    def _windows(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(place, state of the window ending there) of a stretch the items hold."""
        for k, v, n in self.stream(ids):
            if n >= self.window:
                yield k, v

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, longest matching length), the state being cut down to the
        one that holds the last `window` words once the match is longer."""
        go, link, length, window = self.go, self.link, self.length, self.window
        v, n = 0, 0
        for k, c in enumerate(ids):
            while v and c not in go[v]:
                v = link[v]
                n = length[v]
            if c in go[v]:
                v = go[v][c]
                n += 1
            while link[v] >= 0 and length[link[v]] >= window:
                v = link[v]
                n = min(n, length[v])
            yield k, v, n


class Matcher:
    """Finds item windows in texts: word ids by hash, then only stretches whose
    words and neighbours all occur in items are streamed through the automaton (the
    matching length is under two words everywhere else)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        w = words([t for _, t in items])
        self.vocabulary, ids = np.unique(w.hash, return_inverse=True)
        lists = [ids[a : a + n].tolist() for a, n in zip(w.first, w.counts)]
        self.least = min([len(x) for x in lists if x] + [window])
        self.automaton = Automaton([(i, x) for (i, _), x in zip(items, lists)], window)
        pairs = [np.array(x[:-1], np.int64) * len(self.vocabulary) + np.array(x[1:], np.int64) for x in lists if len(x) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def hits(self, w) -> list[tuple[np.ndarray, set[str]]]:
        """For each text: (mask of its hit words or None, items that occur)."""
        out = [(None, set()) for _ in w.counts]
        if not len(self.vocabulary) or not len(w.hash):
            return out
        at = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == w.hash
        joint = known[:-1] & known[1:]
        if len(self.pairs):
            pair = at[:-1] * len(self.vocabulary) + at[1:]
            near = np.flatnonzero(joint)
            found = np.minimum(np.searchsorted(self.pairs, pair[near]), len(self.pairs) - 1)
            joint[near] = self.pairs[found] == pair[near]
        else:
            joint[:] = False
        joint[w.first[w.counts > 0][1:] - 1] = False  # no stretch goes across texts
        # stretches: maximal runs of known words with known neighbours
        begin = known.copy()
        begin[1:] &= ~joint
        end = known.copy()
        end[:-1] &= ~joint
        a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long_enough = b - a >= self.least
        a, b = a[long_enough], b[long_enough]
        text_of = np.searchsorted(w.first, a, side="right") - 1
        # texts without words share a first word with the next one: the last of them holds it
        for x, y, t in zip(a.tolist(), b.tolist(), text_of.tolist()):
            self._stretch(at[x:y].tolist(), x - int(w.first[t]), t, int(w.counts[t]), out)
        return out

    def _stretch(self, ids, shift, t, n_words, out):
        auto, window = self.automaton, self.automaton.window
        for k, v, n in auto.stream(ids):
            reach, found = 0, ()
            if n >= window:
                reach, found = window, auto.items_at.get(v, ())
            for size, item in auto.short.get(v, ()):
                if size <= n:
                    reach, found = max(reach, size), (*found, item)
            if reach:
                mask, items = out[t]
                if mask is None:
                    mask = np.zeros(n_words, bool)
                    out[t] = (mask, items)
                mask[shift + k + 1 - reach : shift + k + 1] = True
                items.update(found)


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`doc_id`, `text` and what of it is in test items: n_words, hit_spans (start and
    end word of each run of hit words) and items (sorted ids as strings).

    A word is hit inside any `window` item words in a row, or inside a whole shorter
    item. Null texts and items have no words; a null item id reads "null"; equal items
    count each under its own id; a null doc_id stays null; repeated rows are matched
    each; other columns are left out. The items are a stated query set: they are read
    in blocks of BLOCK_WORDS words."""
    rows = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    shape = rows.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("hit_spans"), F.array().cast("array<string>").alias("items")).schema
    blocks = _sent(items, item_id, item_text)

    def run(batches):
        for batch, found in _found(batches, blocks, window):
            counts, spans, names = zip(*((n, [{"start": a, "end": b} for a, b in runs], sorted(items)) for n, runs, items in found)) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "hit_spans", "items"])

    return rows.mapInArrow(run, shape)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _sent(items: DataFrame, item_id: str, item_text: str) -> list:
    """The items as broadcasts of at most BLOCK_WORDS words (or one item) each. The driver
    reads one partition of them at a time and holds one block."""
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(item_text).cast("string").alias("t"))
    out, block, size = [], [], 0
    for row in named.orderBy("i", "t").toLocalIterator():
        text = (row.t or "").encode()
        n = int(words([text]).counts[0])
        if size and size + n > BLOCK_WORDS:
            out.append(items.sparkSession.sparkContext.broadcast(block))
            block, size = [], 0
        block.append((row.i, text))
        size += n
    return [*out, items.sparkSession.sparkContext.broadcast(block)]


def _found(batches: Iterator[pa.RecordBatch], blocks: list, window: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch (text in its last column) with (n_words, hit runs, items) of its rows. One
    block of items is open at a time: with several, each in turn reads some TURN bytes of texts."""
    matcher = Matcher(blocks[0].value, window) if len(blocks) == 1 else None
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if matcher or sum(b.nbytes for b in held) >= TURN:
            yield from _turn(held, blocks, window, matcher)
            held = []
    if held:
        yield from _turn(held, blocks, window, matcher)


def _turn(held: list[pa.RecordBatch], blocks: list, window: int, matcher: Matcher | None) -> Iterator[tuple[pa.RecordBatch, list]]:
    rows = [[(0, None, set())] * b.num_rows for b in held]
    for block in blocks:
        found = matcher or Matcher(block.value, window)
        for batch, out in zip(held, rows):
            for at, part in chunks(as_bytes(batch.column(batch.num_columns - 1))):
                w = words(part)
                for k, (n, (mask, names)) in enumerate(zip(w.counts.tolist(), found.hits(w)), at):
                    _, before, others = out[k]
                    both = before if mask is None else mask if before is None else before | mask
                    out[k] = (n, both, others | names if names else others)
        if not matcher:
            del block._value  # the worker reads its copy from disk again next time
    for batch, out in zip(held, rows):
        yield batch, [(n, _runs(mask), names) for n, mask, names in out]


def _runs(mask: np.ndarray | None) -> list[tuple[int, int]]:
    """(first, end) of the stretches of a mask."""
    if mask is None:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()
    return list(zip(edge[::2], edge[1::2]))


def report(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row."""
    out = matched(docs, items, **names)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the words of the runs and what stands between them."""
    w = words([text])
    out, at = [], 0
    for first, end in runs:
        out.append(text[at : int(w.start[first])])
        at = int(w.end[end - 1])
    return b"".join([*out, text[at:]])


def cleaned(docs: DataFrame, items: DataFrame, max_span: int = 0, max_coverage: float = 0.5, text: str = "text", window: int = WINDOW, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs`, all columns, with hit spans of more than `max_span` words cut out of
    `text`; rows of which more than `max_coverage` of the words is hit are left out.
    A null text stays null. Texts are matched and cut in one go."""
    rest = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"_{c}") for c in docs.columns if c != text])
    rows = small_batches(docs).select(rest.alias("row"), F.col(text).cast("string").alias("text"))
    blocks = _sent(items, item_id, item_text)

    def run(batches):
        for batch, found in _found(batches, blocks, window):
            kept = [k for k, (n, runs, _) in enumerate(found) if sum(b - a for a, b in runs) <= max_coverage * n]
            texts = batch.column(1).take(pa.array(kept, pa.int64())).to_pylist()
            for at, k in enumerate(kept):
                if cut := [(a, b) for a, b in found[k][1] if b - a > max_span]:
                    texts[at] = _without(texts[at].encode(), cut).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(texts, pa.string())], ["row", "text"])

    done = rows.mapInArrow(run, rows.schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col("row")[f"_{c}"].alias(c) for c in docs.columns])
