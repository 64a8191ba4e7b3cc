"""Conversations made to read `(system? (user assistant)+)?` by the cheapest edits.

The edits of a conversation are paths through a lattice: a node is (rows read, state), an
arc an edit with a whole-number cost. Shortest paths come from an auction: a path grows
from the origin along an arc that its last node's price allows, or the price of that
node goes up to its best offer and the path gives the node up, until the path reaches the
end. The prices never exceed true distances and the origin's is one, so exactly the arcs
of shortest paths are tight, and the least audit in ASCII order is the first that a
search along tight arcs brings to the end.

A long conversation is priced in pieces, the last one first: the prices of the four
states where a piece begins are what the piece before it has to pay at its end. A task
reads a conversation as a stream: it holds a byte a row, never the texts."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import checkpointed

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
#: Costs of the edits: keep, rerole, delete, insert; and what a cut-off text adds where it stays.
RULES = {"K": 0, "R": 2, "D": 3, "I": 2}
CUT_OFF = 1
FAULTS = ("", "truncated", "blank", "duplicate")
#: Rows of a conversation that are priced at a time.
PIECE = 16
#: Texts of a batch of repaired rows; different short conversations whose plans a task remembers.
ROWS, REMEMBERED = 256, 1 << 14
_SPACES = " \t\n\x0b\x0c\r"


def _turned(state: int) -> int:
    """State after the turn that a conversation wants next (a user's, or an assistant's after it)."""
    return ASSISTANT if state == USER else USER


def _edits(code: int) -> list[list[tuple[str, int, int]]]:
    """(letter, cost, next state) of the edits that read a row, for each state."""
    initial, fault = divmod(code, len(FAULTS))
    out = []
    for state in range(4):
        arcs = [("D", RULES["D"], state)]
        if fault < 2:
            after = {0: SYSTEM if state == START else None, 1: USER if state != USER else None, 2: ASSISTANT if state == USER else None}.get(initial)
            if after is not None:
                arcs.append(("K", RULES["K"] + CUT_OFF * fault, after))
            arcs.append(("R", RULES["R"] + CUT_OFF * fault, _turned(state)))
        out.append(arcs)
    return out


_EDITS = [_edits(c) for c in range(4 * len(FAULTS))]


class Lattice:
    """The lattice of some rows, with what each state costs after them (None: no end)."""

    def __init__(self, codes: bytes, after: list[int | None], last: bool):
        n = len(codes)
        self.end = 4 * (n + 1)
        #: What every path pays at the end; prices start at nought and climb by what is above it.
        self.base = min(cost for cost in after if cost is not None)
        self.arcs: list[list[tuple[str, int, int]]] = []
        for i in range(n + 1):
            for state in range(4):
                arcs = [(letter, cost, 4 * (i + 1) + to) for letter, cost, to in _EDITS[codes[i]][state]] if i < n else []
                if i < n or last:
                    arcs.append(("I", RULES["I"], 4 * i + _turned(state)))
                if i == n and after[state] is not None:
                    arcs.append(("", after[state] - self.base, self.end))
                self.arcs.append(sorted(arcs))
        self.arcs.append([])
        self.price = [0] * (self.end + 1)

    def distance(self, origin: int) -> int:
        """Cost of the cheapest path from a node to the end, by auction. Prices stay for the next."""
        price, arcs, path = self.price, self.arcs, [origin]
        while path[-1] != self.end:
            node = path[-1]
            offer, to = min((cost + price[to], to) for _, cost, to in arcs[node])
            if price[node] < offer:  # contract: the node is dearer than it was
                price[node] = offer
                if len(path) > 1:
                    path.pop()
            else:  # extend
                path.append(to)
        return price[origin] + self.base

    def least(self, origin: int) -> tuple[str, int]:
        """(letters, state at the end) of the ASCII-least path of tight arcs from a node
        whose distance is known."""
        price, path, dead = self.price, [(origin, "", iter(self.arcs[origin]))], set()
        while path:
            node, _, left = path[-1]
            for letter, cost, to in left:
                if price[node] == cost + price[to] and to not in dead:
                    if to == self.end:
                        return "".join(p[1] for p in path), node & 3
                    path.append((to, letter, iter(self.arcs[to])))
                    break
            else:
                dead.add(node)
                path.pop()
        raise AssertionError("no tight path: the distance is not known")


def plan(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows given by their codes."""
    cuts = list(range(0, len(codes), PIECE)) or [0]
    after: list[int | None] = [0, None, None, 0]
    ends = [after]
    for a in reversed(cuts[1:]):
        lattice = Lattice(codes[a : a + PIECE], after, len(ends) == 1)
        after = [lattice.distance(state) for state in range(4)]
        ends.append(after)
    ends.reverse()
    cost, state, audit = None, START, []
    for a, after in zip(cuts, ends):
        lattice = Lattice(codes[a : a + PIECE], after, a == cuts[-1])
        price = lattice.distance(state)
        cost = price if cost is None else cost
        letters, state = lattice.least(state)
        audit.append(letters)
    return cost, "".join(audit)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role and text of the rows, one in four with a fault: by
    crc32(`conv_id:turn`) % 20, 0 drops a row, 1 empties its text, 2 takes `.!?` out of it, 3
    repeats the row and 4 makes it a user's. A null is one space, but for ids that stay null."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spelled(conv), F.lit(":"), spelled(turn)).cast("binary")) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spelled(text), "[.!?]", "")).otherwise(spelled(text))
    times = F.when(kind == 3, 2).otherwise(1)
    out = rows.filter(kind != 0).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(spelled(role)).alias("role"), body.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
    return out.drop("copy")


def _told(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text (nulls: a space) and digest, in whose order rows of one turn stand."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), body.alias("text"), F.md5(body.cast("binary")).alias("digest"))


def _plans(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of (conv_id, is a row, turn, code), sorted by these."""
    remembered: dict[bytes, tuple[int, str]] = {}
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = [kind, *[pa.int64()] * 6, pa.string()]
    out, conv, codes, first, last, different, begun = [], None, bytearray(), None, None, 0, False

    def closed():
        rows = bytes(codes)
        found = remembered.get(rows)
        if found is None:
            found = plan(rows)
            if len(rows) <= PIECE and len(remembered) < REMEMBERED:
                remembered[rows] = found
        faults = [rows.translate(_FAULT).count(k) for k in range(len(FAULTS))]
        initials = rows.translate(_INITIAL)
        legal = sum(1 for a, b in zip(initials, initials[1:]) if (a, b) in ((0, 1), (1, 2), (2, 1)))
        gaps = 0 if first is None else last - first + 1 - different
        return conv, gaps, faults[2], faults[3], faults[1], max(0, len(rows) - 1) - legal, *found

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for name, row, turn, code in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or name != conv:
                if begun:
                    out.append(closed())
                conv, codes, first, last, different, begun = name, bytearray(), None, None, 0, True
            if row:
                codes.append(code)
                if turn is not None:
                    different += turn != last
                    first, last = turn if first is None else first, turn
        if len(out) >= ROWS:
            yield table(out)
            out = []
    if begun:
        yield table([*out, closed()])


_FAULT = bytes(c % len(FAULTS) for c in range(256))
_INITIAL = bytes(c // len(FAULTS) for c in range(256))


def plan_repairs(rows: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation.

    Rows go by turn (nulls first), then role and a digest of the text. The first fault of a
    row counts: blank (only spaces and \\x09 to \\x0D), duplicate (role and text stood
    earlier), truncated (the last other character is none of `.!?`). `gaps` are the turns
    missing between the least and the greatest; `illegal` are neighbours whose roles'
    initials are not su, ua or au. The audit has a letter an edit (Keep, Rerole, Delete,
    Insert): of the cheapest the ASCII-least. Blank and duplicate rows must be deleted; a
    role with another initial (or none) cannot be kept.

    Nulls of role and text are one space; a null conv_id is a conversation of its own;
    repeated rows are duplicates; other columns are left out. Ids in `conversations`
    (column `conv`) without rows get zeros and an empty audit."""
    told = _told(rows, conv, turn, role, text)
    kind = told.schema["conv_id"].dataType
    earlier = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    end = F.rtrim(F.col("text"), F.lit(_SPACES))
    facts = told.select("conv_id", "turn", "role", "digest", (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    facts = facts.withColumn("again", F.row_number().over(earlier) > 1)
    fault = F.when(F.col("blank"), 2).when(F.col("again"), 3).when(F.col("cut"), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    coded = facts.select("conv_id", F.lit(1).alias("row"), "turn", "role", "digest", (letter * len(FAULTS) + fault).cast("int").alias("code"))
    if conversations is not None:
        named = conversations.select(F.col(conv).cast(kind).alias("conv_id")).distinct()
        coded = coded.unionByName(named.withColumn("row", F.lit(0)), allowMissingColumns=True)
    coded = coded.repartition("conv_id").sortWithinPartitions("conv_id", "row", F.col("turn").asc_nulls_first(), "role", "digest", "code")
    arrow = _arrow_type(told)
    out = coded.select("conv_id", "row", "turn", "code").mapInArrow(lambda b: _plans(b, arrow), f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return out


def _arrow_type(told: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(told.schema["conv_id"].dataType)


def _repaired(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows after repair, of plans (row = 0, with the audit) each followed by its rows."""
    types = [("conv_id", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    out, conv, audit, at, place, state = [], None, "", 0, 0, START

    def said(edit, role, text):
        nonlocal place, state
        wanted = _turned(state)
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]] if edit == "K" else wanted
        out.append((conv, place, edit, role if edit == "K" else ("user", "assistant")[wanted - USER], text))
        place += 1

    def inserted():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            said("I", "", "")
            at += 1

    def table():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), types)], [n for n, _ in types])

    for batch in batches:
        for name, row, plan_, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not row:
                inserted()
                conv, audit, at, place, state = name, plan_, 0, 0, START
                continue
            inserted()
            if audit[at] != "D":
                said(audit[at], role, text)
            at += 1
            if len(out) >= ROWS:
                yield table()
                out = []
    inserted()
    if out:
        yield table()


def repaired(rows: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 0), edit, role and text of the rows that conversations have after
    the repairs of `plans` (of the same rows). Inserted rows have an empty text."""
    told = _told(rows, conv, turn, role, text).withColumn("row", F.lit(1))
    heads = plans.select("conv_id", "audit").withColumn("row", F.lit(0))
    both = told.unionByName(heads, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "row", F.col("turn").asc_nulls_first(), "role", "digest")
    kind, arrow = told.schema["conv_id"].dataType.simpleString(), _arrow_type(told)
    return both.select("conv_id", "row", "audit", "role", "text").mapInArrow(lambda b: _repaired(b, arrow), f"conv_id {kind}, place long, edit string, role string, text string")


def _hashed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    out, conv, digest = [], None, None
    for batch in batches:
        for name, place, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if place == 0:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = name, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.string()))], ["conv_id", "repaired_sha256"])
            out = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])


def audited(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """`plan_repairs` with repaired_sha256, the digest of the repaired `role:text`, a line a row
    (of nothing where no row is left)."""
    plans = checkpointed(plan_repairs(rows, conversations))
    done = repaired(rows, plans)  # rows of a conversation follow each other, as they were sorted
    arrow = _arrow_type(done)
    digests = done.mapInArrow(lambda b: _hashed(b, arrow), f"conv_id {done.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
    out = plans.join(digests.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
