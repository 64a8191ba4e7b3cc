"""Byte-level byte-pair encodings from a tokenizer's .json file.

`Encoder` gives the ids the file's own library gives, from a bounded memory of
pieces between spaces; `Counter` counts tokens by merging, without ids."""
from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex

#: White space of Unicode; Python's own set has four controls more.
SPACE = "\t-\r \x85\xa0  -     　"
#: Fixed: how byte-level encodings cut a text before merging.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces that each memory of a Python worker holds before it is emptied (about 40 MB); a
#: task empties it when it ends.
REMEMBERED = 200_000


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand
    for themselves, the others for characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


@lru_cache(4)
def read(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """Vocabulary, merges in order and special strings of a byte-level .json."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or model.get("type") != "BPE" or spec.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens") or ()):
        raise ValueError(f"{path} has special strings with rules of their own")
    chars = byte_of_char()
    raw = lambda s: bytes(chars[c] for c in s)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {raw(t): i for t, i in model["vocab"].items() if t not in special}, [(raw(a), raw(b)) for a, b in merges], special


class Spaced(Exception):
    """A piece starts with white space: the text can't be cut at single spaces."""


class _Memory(dict):
    """What `make` gives for a piece (with a space before it), remembered."""

    def __init__(self, make, before: str):
        super().__init__()
        self.make, self.before = make, before

    def __missing__(self, piece: str):
        if self.before and (not piece or piece[0].isspace()):
            raise Spaced
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[piece] = self.make(self.before + piece)
        return out


class _Cutter:
    """A text is cut before each single space that a visible character follows,
    where no piece of the encoding can go across; parts are looked up."""

    def __init__(self, special: dict[str, int], make):
        self.make, self.special = make, special
        self.first, self.rest = _Memory(make, ""), _Memory(make, " ")
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def forget(self) -> None:
        """Empty the memory; the vocabulary stays."""
        self.first.clear()
        self.rest.clear()

    def parts(self, text: str) -> list:
        out: list = []
        if self.at_special and any(s in text for s in self.special):
            for k, part in enumerate(self.at_special.split(text)):
                out += [self.of_special(part)] if k % 2 else self.plain(part)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list:
        if not text:
            return []
        head, *tail = text.split(" ")
        try:
            return ([self.first[head]] if head else []) + list(map(self.rest.__getitem__, tail))
        except Spaced:
            return [self.make(text)]


class Encoder(_Cutter):
    """ids(text): the token ids as little-endian unsigned 32-bit values."""

    def __init__(self, path: str):
        import tiktoken

        vocabulary, _, special = read(path)
        core = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=vocabulary, special_tokens={})._core_bpe
        super().__init__(special, lambda t: core.encode_to_tiktoken_buffer(t, set()))

    def of_special(self, text: str) -> bytes:
        return self.special[text].to_bytes(4, "little")

    def ids(self, text: str) -> bytes:
        return b"".join(self.parts(text))


class Counter(_Cutter):
    """count(text): number of tokens by heap-and-linked-list merging."""

    def __init__(self, path: str):
        vocabulary, merges, special = read(path)
        self.symbol = [vocabulary[bytes([b])] for b in range(256)]
        self.rank = {(vocabulary[a], vocabulary[b]): (k, vocabulary[a + b]) for k, (a, b) in enumerate(merges)}
        self.cut, self.known = regex.compile(PIECES), {}
        super().__init__(special, self.pieces)

    def pieces(self, text: str) -> int:
        known, n = self.known, 0
        for piece in self.cut.findall(text):
            k = known.get(piece)
            if k is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                k = known[piece] = self.merged(piece.encode())
            n += k
        return n

    def merged(self, data: bytes) -> int:
        """Symbols of one piece left after all merges. The heap holds (rank, place
        of the left symbol); links skip symbols that were merged away, and an
        entry counts only while its pair still stands there."""
        n = len(data)
        if n == 1:
            return 1
        rank, symbol = self.rank, [self.symbol[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            k, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n or not (found := rank.get((symbol[i], symbol[j]))) or found[0] != k:
                continue
            symbol[i], symbol[j], merges = found[1], -1, merges + 1
            after[i] = right = after[j]
            if right < n:
                before[right] = i
                if r := rank.get((symbol[i], symbol[right])):
                    heapq.heappush(heap, (r[0], i))
            left = before[i]
            if left >= 0 and (r := rank.get((symbol[left], symbol[i]))):
                heapq.heappush(heap, (r[0], left))
        return n - merges

    def forget(self) -> None:
        super().forget()
        self.known.clear()

    def of_special(self, text: str) -> int:
        return 1

    def count(self, text: str) -> int:
        return sum(self.parts(text))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per worker process, with its memory."""
    return Encoder(path)


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)
