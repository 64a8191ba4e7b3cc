"""Quality rules as a short-circuit cascade.

Every rule is timed and counted on a sample; rules then run in order of rejection
per cost, and a text that one rule rejects is not shown to the next. The order
changes the work, never the verdict: a text is kept if no rule rejects it."""
from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import as_bytes, small_batches

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
_NO_SYMBOLS = str.maketrans("", "", SYMBOLS)


class Text:
    """A text whose facts are worked out when first asked for."""

    def __init__(self, text: str):
        self.text = text

    def __getattr__(self, name: str):
        if name not in _FACTS:
            raise AttributeError(name)
        value = _FACTS[name](self)
        setattr(self, name, value)
        return value


def _dup_lines(t: Text) -> int:
    lines = [x for x in t.text.split("\n") if _WORD.search(x)]
    return len(lines) - len(set(lines))


def _repeat_words(t: Text) -> int:
    w = t.words
    seen = Counter(zip(w, w[1:], w[2:]))
    if len(seen) == max(0, len(w) - 2):
        return 0
    n, covered = 0, 0  # words before `covered` are counted
    for k, window in enumerate(zip(w, w[1:], w[2:])):
        if seen[window] > 1:
            n += k + 3 - max(covered, k)
            covered = k + 3
    return n


_FACTS: dict[str, Callable] = {
    "words": lambda t: _WORD.findall(t.text),
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: sum(map(len, t.words)),
    "n_symbols": lambda t: len(t.text) - len(t.text.translate(_NO_SYMBOLS)) if any(s in t.text for s in SYMBOLS) else 0,
    "n_lines": lambda t: sum(1 for x in t.text.split("\n") if _WORD.search(x)),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_upper": lambda t: sum(map(str.isupper, t.text)),
    "n_letters": lambda t: sum(map(str.isalpha, t.text)),
    "n_exclaimed": lambda t: t.text.count("!!"),
    "n_distinct": lambda t: len(set(t.words)),
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: `base_failed` of the contract is the first two rules.
BASE = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("shouting", lambda t: 2 * t.n_upper > t.n_letters),
    Rule("exclamation", lambda t: 5 * t.n_exclaimed > t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 25 * t.n_words),
    Rule("few_different_words", lambda t: t.n_words <= 1000 and 5 * t.n_distinct < t.n_words),
)
FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, rules: tuple[Rule, ...], rows: int, seed: int, text: str = "text") -> dict[str, tuple[float, float]]:
    """(seconds a text, share of texts rejected) of each rule, on about `rows` rows
    drawn evenly from the whole table; executors measure, a row a rule comes back."""
    total = docs.count()
    if not total:
        return {}
    sample = docs.select(F.col(text).cast("string").alias("text")).sample(min(1.0, rows / total), seed)

    def run(batches):
        spent, rejected, n = Counter(), Counter(), 0
        for batch in batches:
            for t in as_bytes(batch.column(0)):
                n += 1
                for rule in rules:
                    one, began = Text(t.decode()), time.perf_counter()
                    rejected[rule.name] += bool(rule.rejects(one))
                    spent[rule.name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "spent": [float(spent[r.name]) for r in rules], "rejected": [rejected[r.name] for r in rules], "n": [n] * len(rules)})

    got = sample.mapInArrow(run, "rule string, spent double, rejected long, n long").groupBy("rule").agg(F.sum("spent").alias("s"), F.sum("rejected").alias("r"), F.sum("n").alias("n")).collect()
    return {x.rule: (x.s / max(1, x.n), x.r / max(1, x.n)) for x in got}


def ordered(rules: tuple[Rule, ...], facts: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Rules by falling rejection per cost."""
    worth = lambda r: -facts.get(r.name, (1.0, 0.0))[1] / max(facts.get(r.name, (1.0, 0.0))[0], 1e-9)
    return tuple(sorted(rules, key=worth))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7, facts: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the asked `facts`, base_failed, kept and rejected_by (the first rule in
    the measured order that rejects, else null) of each row.

    `sample_rows` bounds what costs are measured on; every text is judged whole. A null
    text has no words; a null doc_id stays null; repeated rows are judged each; other
    columns are left out; an empty table gives no rows (rules keep their given order)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    order = ordered(rules, measured(docs, rules, sample_rows, seed, text))

    def run(batches):
        for batch in batches:
            out = []
            for t in as_bytes(batch.column(1)):
                one = Text(t.decode())
                by = next((r.name for r in order if r.rejects(one)), None)
                # without facts to report, only the verdict of the base rules is still to be told
                failed = any(r.name == by for r in BASE) or any(r.rejects(one) for r in BASE)
                out.append((*(getattr(one, f) for f in facts), failed, by is None and not failed, by))
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(len(facts))]
            columns += [pa.array([r[len(facts) + k] for r in out], kind) for k, kind in enumerate((pa.bool_(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *facts, "base_failed", "kept", "rejected_by"])

    shape = f"doc_id {kind}, " + "".join(f"{f} long, " for f in facts) + "base_failed boolean, kept boolean, rejected_by string"
    return small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, shape)
