"""Chat formatting with a grammar that reads back exactly.

    text     = turn*
    turn     = "<|turn|>" role "<|text|>" content "<|end|>"
    role, content = (character | "\\" character)*     no control string unescaped

Control strings of this and other templates are escaped inside texts by a
backslash, which a reader drops. Escaping goes up a level (nothing, backslashes
and control strings, each character a control string begins with, every
character) until the parser gives the source back."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Fixed: strings that chat templates give a meaning to.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>")
_ESCAPES = (None, regex.compile(r"\\|" + "|".join(map(regex.escape, CONTROL))), regex.compile(r"[\\<\[]"), regex.compile(r".", regex.DOTALL))
_TOKEN = regex.compile(r"\\(.)|(" + "|".join(map(regex.escape, CONTROL)) + ")", regex.DOTALL)


class Malformed(ValueError):
    """A text that the grammar does not derive."""


def escape(text: str, level: int) -> str:
    return text if not level else _ESCAPES[level].sub(lambda m: "\\" + m[0], text)


def _unescape(text: str) -> str:
    return _TOKEN.sub(lambda m: m[1] or m[2], text) if "\\" in text else text


def write(turns: list[tuple[str, str]], levels: list[int]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and, for each turn, where its content lies in it."""
    out, spans, at = [], [], 0
    for (role, text), level in zip(turns, levels):
        head = f"{TURN}{escape(role, level)}{TEXT}"
        body = escape(text, level)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """Turns of a formatted text, read once from left to right."""
    turns, want, at, mark, role = [], TURN, 0, 0, ""
    for m in _TOKEN.finditer(text):
        if m[2] is None:
            continue
        if m[2] != want or (want == TURN and m.start() != at):
            raise Malformed(f"{m[2]} at {m.start()}")
        part, at = text[mark : m.start()], m.end()
        if want == TURN:
            want = TEXT
        elif want == TEXT:
            role, want = _unescape(part), END
        else:
            turns.append((role, _unescape(part)))
            want = TURN
        mark = at
    if want != TURN or at != len(text):
        raise Malformed("ends too early")
    return turns


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The least escaped text that reads back as `turns`, and the content spans.
    A turn that does not read back alone is escaped one level more."""
    levels = [0] * len(turns)
    for k, turn in enumerate(turns):
        while levels[k] < len(_ESCAPES) - 1 and not _reads_back([turn], [levels[k]]):
            levels[k] += 1
    text, spans = write(turns, levels)
    if parse(text) != turns:
        raise Malformed("a rendered text does not read back")
    return text, spans


def _reads_back(turns, levels) -> bool:
    try:
        return parse(write(turns, levels)[0]) == turns
    except Malformed:
        return False


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = [], []
        for turns in batch.column(1).to_pylist():
            text, at = render([(t["role"], t["text"]) for t in turns])
            texts.append(text)
            spans.append([{"role": t["role"], "start": a, "end": b} for t, (a, b) in zip(turns, at)])
        kind = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "spans"])


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted and spans (role, start, end of each turn's escaped text,
    in code points) of each conversation.

    Rows go by turn (nulls first), then role and text, so equal turns and repeated
    rows have one defined order and all stay; null role or text is empty; a null
    conv_id is a conversation of its own; other columns are left out. A conversation
    is one training text and is written in one piece, so it must fit a task."""
    kind = rows.schema[conv].dataType.simpleString()
    part = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = rows.select(F.col(conv).alias("conv_id"), part.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    chats = chats.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("t"))
    return chats.mapInArrow(_rows, f"conv_id {kind}, formatted string, spans array<struct<role: string, start: bigint, end: bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them: n_turns, turns_sha256,
    and the text under the loss mask (the assistant's spans)."""

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(text)
                loss = "".join(_unescape(text[s["start"] : s["end"]]) for s in spans if s["role"] == "assistant")
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            n, whole, chars, loss, size = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(whole, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
