"""Byte-level BPE: a priority queue of merge ranks over a doubly linked list of symbols.

``Merger`` reads a tokenizer file's vocabulary and merges. One text is cut where the pattern of the
vocabulary cuts it in any case (single blanks between words), so that each distinct word is merged once
and remembered in a memory of bounded size; texts with other white space take the pattern as a whole.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush
from itertools import pairwise
from struct import pack

import regex

# The pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The byte ranges that stand for themselves in vocabulary files; others count up from 256.
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))

_UNEVEN = re.compile(r"\s\s|\A\s|\s\Z")


def byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary file."""
    plain = {b for lo, hi in PRINTABLE for b in range(lo, hi + 1)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Memory(dict):
    """word -> make(word), for about the last 2 * size words asked for."""

    def __init__(self, make, size: int, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.older = make, size, longest, {}

    def __missing__(self, word):
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Merger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.first = [vocab[c] for c in chars]
        #: left -> right -> rank; by rank: left, right and merged symbol
        self.ranks: list[dict[int, int]] = [{}] * (max(vocab.values()) + 1)
        self.left, self.right, self.new = [], [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.new.append(vocab[a + b])
            self.ranks[vocab[a]] = self.ranks[vocab[a]] or {}
            self.ranks[vocab[a]].setdefault(vocab[b], rank)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.pieces = regex.compile(PATTERN).findall
        self.words = Memory(self._symbols, 500_000)
        #: chunk of text after a blank, or not -> ids as little-endian unsigned 32-bit integers
        self.after_blank = Memory(lambda s: self._chunk(" " + s), 300_000)
        self.plain = Memory(self._chunk, 50_000)
        self.newline = self._chunk("\n")

    def merged(self, data: bytes) -> tuple[list[int], int]:
        """Symbols after all merges (-1: gone), and how many merges there were.

        A queue entry is rank * n + position: the lowest rank comes first, of equal ones the leftmost. An
        entry whose pair no longer stands at its position is stale and skipped."""
        n = len(data)
        ranks, lefts, rights, news, pop, push = self.ranks, self.left, self.right, self.new, heappop, heappush
        sym = list(map(self.first.__getitem__, data))
        queue = [r * n + i for i, (a, b) in enumerate(pairwise(sym)) if (r := ranks[a].get(b)) is not None]
        if not queue:
            return sym, 0
        sym.append(-1)  # the end: no pair has it
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heapify(queue)
        done = 0
        while queue:
            entry = pop(queue)
            rank = entry // n
            i = entry - rank * n
            j = after[i]
            if sym[i] != lefts[rank] or sym[j] != rights[rank]:
                continue
            new = sym[i] = news[rank]
            sym[j] = -1
            k = after[i] = after[j]
            before[k] = i
            done += 1
            if (r := ranks[new].get(sym[k])) is not None:
                push(queue, r * n + i)
            if i:
                h = before[i]
                if (r := ranks[sym[h]].get(new)) is not None:
                    push(queue, r * n + h)
        return sym, done

    def _symbols(self, piece: str) -> bytes:
        sym, _ = self.merged(piece.encode())
        ids = [s for s in sym if s >= 0]  # what remains stands in order
        return pack(f"<{len(ids)}I", *ids)

    def _chunk(self, text: str) -> bytes:
        if not any(map(text.__contains__, self.special)):
            return b"".join(map(self.words.__getitem__, self.pieces(text)))
        out = []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(map(self.words.__getitem__, self.pieces(part)))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if _UNEVEN.search(text):
            return self._chunk(text)
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(self.plain[first] + b"".join(map(self.after_blank.__getitem__, rest)))
        return self.newline.join(lines)

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings of the ids, one after the other."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class Counter(Merger):
    """Counts alone: initial symbols less merges; no ids are made."""

    def __init__(self, path: str):
        super().__init__(path)
        self.newline = 1

    def _symbols(self, piece: str) -> int:
        data = piece.encode()
        return len(data) - self.merged(data)[1]

    def _chunk(self, text: str) -> int:
        parts = self.cut(text) if any(map(text.__contains__, self.special)) else [text]
        return len(parts) // 2 + sum(sum(map(self.words.__getitem__, self.pieces(p))) for p in parts[::2])

    def count(self, text: str) -> int:
        if _UNEVEN.search(text):
            return self._chunk(text)
        lines = text.split("\n")
        n = self.newline * (len(lines) - 1)
        for line in lines:
            first, *rest = line.split(" ")
            n += self.plain[first] + sum(map(self.after_blank.__getitem__, rest))
        return n


_MADE: dict = {}


def worker(kind, path: str):
    """One coder for each Python worker: its memory lives on from task to task."""
    key = (kind, path)
    if key not in _MADE:
        _MADE[key] = kind(path)
    return _MADE[key]
