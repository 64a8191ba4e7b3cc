"""Search for short licence notices, exact and with a few edits.

A notice of n characters that occurs with at most k edits holds one of k+1 parts
of it unchanged (pigeonhole). The parts are looked up as plain strings; around each
hit the `regex` library matches the whole notice with bounded errors, which
verifies the edits and gives the span."""
from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, WORD_BYTES, as_bytes, small_batches

#: Fixed phrases and labels: every place where the words stand in a row counts.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Notice:
    """Words of a notice, its label, the edits (characters) it may hold, and a short word
    that tells the licence from others and so takes none."""

    words: str
    label: str
    edits: int
    exact: str = ""


NOTICES = (
    Notice("under the mit license", "mit", 2, "mit"),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    Notice("apache license version 2", "apache-2", 2, "2"),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 4),
    Notice("creative commons attribution sharealike", "cc-by-sa", 4),
    Notice("gnu general public license", "gpl", 3, "gnu"),
    Notice("gnu lesser general public license", "lgpl", 3, "gnu"),
    Notice("mozilla public license", "mpl", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 5),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 6),
)
_SPACED = np.where(WORD_BYTES, LOWER, ord(" ")).astype(np.uint8).tobytes()


@lru_cache(4)
def _compiled(notices: tuple[Notice, ...]):
    """(part of a notice, where it starts, notice) for all parts; patterns."""
    out = []
    for n in notices:
        cuts = [round(i * len(n.words) / (n.edits + 1)) for i in range(n.edits + 2)]
        # a squeezed text has a space at both ends: a word edge is a space that is seen
        pattern = regex.compile(rf"(?<= ){_worded(n)}(?= )", regex.BESTMATCH)
        out.append((n, [(n.words[a:b].encode(), a) for a, b in zip(cuts, cuts[1:])], pattern))
    return out


def _worded(n: Notice) -> str:
    """Pattern of a notice: edits anywhere but in its exact word, which no letter or digit
    of ASCII touches. What stands before and after it has the edits each; together they
    may not be more (`fuzzy` sees to that)."""
    signs = rf"([^ a-z0-9]{{0,{n.edits}}})"  # signs that touch a word at the notice's end are edits too
    some = lambda words: rf"(?:{regex.escape(words, literal_spaces=True)}){{e<={n.edits}}}" if words else signs
    if not n.exact:
        return some(n.words)
    before, after = n.words.split(n.exact, 1)
    return rf"{some(before)}(?<![a-z0-9]){n.exact}(?![a-z0-9]){some(after)}"


def squeezed(text: bytes) -> bytes:
    """Lower-cased words with one space before, between and after them."""
    return b" " + b" ".join(text.translate(_SPACED).split()) + b" "


def places(line: bytes, phrase: bytes) -> list[int]:
    """Where the phrase's words stand in a row, as byte places of its first word."""
    out, at, want = [], 0, b" " + phrase + b" "
    while (at := line.find(want, at)) >= 0:
        out.append(at + 1)
        at += 1
    return out


def _text(piece: bytes) -> str:
    """Bytes that are no UTF-8 count as one character each."""
    return piece.decode("utf-8", "surrogateescape")


def _bytes(piece: str) -> bytes:
    return piece.encode("utf-8", "surrogateescape")


def fuzzy(line: bytes, notices: tuple[Notice, ...] = NOTICES) -> list[tuple[int, int, str, float]]:
    """(start, end, label, score) of the notices in a squeezed text, in bytes; the
    score is the share of the notice's characters that needed no edit."""
    out = set()
    for n, parts, pattern in _compiled(notices):
        tried = set()
        for part, shift in parts:
            # In characters, as edits are: a match with this part unchanged starts at most
            # `shift + edits` before it; one more on each side shows the word edge.
            before, after = shift + n.edits + 1, len(n.words) - shift + n.edits + 1
            at = line.find(part)
            while at >= 0:
                left = _text(line[max(0, at - 4 * before) : at])[-before:]
                piece = left + _text(line[at : at + 4 * after])[:after]
                a = at - len(_bytes(left))
                if (a, piece) not in tried:  # else the same stretch, found by another part
                    tried.add((a, piece))
                    m = pattern.search(piece)
                    edits = sum(m.fuzzy_counts) + sum(map(len, m.groups())) if m else 0
                    if m and edits <= n.edits:
                        start = a + len(_bytes(piece[: m.start()]))
                        out.add((start, start + len(_bytes(m[0])), n.label, 1 - edits / len(n.words)))
                at = line.find(part, at + 1)
    return sorted(out)


def _scan(notices: tuple[Notice, ...], phrases):
    encoded = [(p.encode(), label) for p, label in phrases]

    def row(text: bytes):
        line = squeezed(text)
        starts, labels = [], set()
        for phrase, label in encoded:
            if found := places(line, phrase):
                starts += found
                labels.add(label)
        spans = fuzzy(line, notices)
        word = lambda at: line.count(b" ", 0, at) - 1
        base = sorted(map(word, starts))
        return (
            max(0, line.count(b" ") - 1) if len(line) > 2 else 0,
            len(base),
            base[0] if base else None,
            base[-1] if base else None,
            ",".join(sorted(labels)),
            ",".join(sorted(labels | {s[2] for s in spans})),
            1.0 if labels else max((s[3] for s in spans), default=0.0),
            [{"label": s[2], "first_word": word(s[0]), "last_word": word(s[1]), "score": s[3]} for s in spans],
        )

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())])))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")

    def run(batches):
        for batch in batches:
            rows = [row(t) for t in as_bytes(batch.column(1))]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return run


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, phrases=PHRASES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, n_words, n_base (places of the fixed phrases), first_word
    and last_word (their smallest and largest start), base_labels, labels, score (0 to
    1) and notices (label, first_word, last_word, score of each fuzzy match).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A
    null text is empty: no words, no labels, score 0. A null doc_id stays null, repeated
    rows are scanned each, other columns are left out."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(
        _scan(notices, phrases),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "notices array<struct<label: string, first_word: bigint, last_word: bigint, score: double>>",
    )
