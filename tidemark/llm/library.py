"""Ids as the tokenizers library gives them, asked for once for each distinct word of a slice of texts
that a bounded memory doesn't hold.

A text is cut at blanks, where the tokenizer cuts it in any case. ``keeps_blank`` says whether a blank belongs to
the word after it (byte-level vocabularies) or is dropped (vocabularies with word ends).
"""

from __future__ import annotations

import os
import string

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each task has one core

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Signs that no word's letters run into: between a letter and them the tokenizer cuts.
_SIGNS = string.punctuation.replace("'", "")


#: White space that isn't one blank or line end between words; a text that has it goes to the library whole.
_BLANK = r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_OTHER = _BLANK.replace("\\t-\\r\\x1c- ", r"\t\x0b-\r\x1c-\x1f")
UNEVEN = rf"\A[{_BLANK}]|[{_BLANK}]\z|[{_BLANK}][{_BLANK}]|[{_OTHER}]"
#: Letters that every table of letters has; signs behind one are a piece of their own.
_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
_TAIL = "[" + "".join(f"\\{c}" for c in _SIGNS) + "]+"
#: Words that the library is asked for in one text.
_TOGETHER = 2000


class Encoder:
    """keeps_blank: whether a blank belongs to the word after it. size: words remembered in each of two generations, as
    Arrow arrays. longest: bytes of a word that is remembered."""

    def __init__(self, path: str, keeps_blank: bool, size: int = 250_000, longest: int = 64):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keeps_blank, self.size, self.longest = keeps_blank, size, longest
        none = (pa.array([], pa.string()), pa.array([], pa.large_binary()))
        #: by whether they are bare: words and ids of the newer and of the older generation
        self.memory = {bare: (none, none) for bare in (False, True)}
        self.none = none
        # Before each of the words asked for together stands what is one id by itself and is in none of them.
        self.mark = "\n" if keeps_blank else "\x01"
        mark_ids = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = mark_ids[0] if len(mark_ids) == 1 else None
        self.newline = np.asarray(mark_ids, "<u4").tobytes() if keeps_blank else b""
        #: words that the library was asked for
        self.asked = 0

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, words: pa.Array) -> pa.LargeBinaryArray:
        """Ids of distinct words. The signs at a word's end are asked for apart, each kind of them once."""
        special = pc.or_(pc.match_substring(words, "<|"), pc.match_substring(words, "\x01"))
        ends = pc.and_(pc.match_substring_regex(words, f"{_LETTER}{_TAIL}\\z"), pc.invert(special))
        stems = pc.if_else(ends, pc.replace_substring_regex(words, f"{_TAIL}\\z", ""), words).dictionary_encode()
        tails = pc.if_else(ends, pc.replace_substring_regex(words, f"(?s)\\A.*{_LETTER}", ""), "").dictionary_encode()
        stem, tail = self._known(stems.dictionary, False).take(stems.indices), self._known(tails.dictionary, True).take(tails.indices)
        return pc.binary_join_element_wise(stem, tail, pa.scalar(b"", pa.large_binary()))

    def _known(self, words: pa.Array, bare: bool) -> pa.LargeBinaryArray:
        """Ids of distinct words: remembered, or else asked for."""
        (newer, ids), (older, older_ids) = self.memory[bare]
        at = pc.index_in(words, newer)
        left = words.filter(at.is_null())
        before = pc.index_in(left, older)
        found, new = before.is_valid(), left.filter(before.is_null())
        more = pa.concat_arrays([left.filter(found), new])
        more_ids = pa.concat_arrays([older_ids.take(before.drop_null()), self._asked(new, bare)])
        found = np.asarray(found)
        index = at.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        index[index < 0] = len(newer) + np.where(found, np.cumsum(found) - 1, found.sum() + np.cumsum(~found) - 1)
        out = pa.concat_arrays([ids, more_ids]).take(pa.array(index))
        short = pc.less_equal(pc.binary_length(more), self.longest)
        now = (pa.concat_arrays([newer, more.filter(short)]), pa.concat_arrays([ids, more_ids.filter(short)]))
        self.memory[bare] = (self.none, now) if len(now[0]) > self.size else (now, (older, older_ids))
        return out

    def _asked(self, words: pa.Array, bare: bool) -> pa.LargeBinaryArray:
        """Ids of words by the library; bare ones have neither blank nor line end before them."""
        self.asked += len(words)
        if not self.keeps_blank:
            forms = words
            texts = pc.binary_join_element_wise(self.mark, words, "", " ")
            with_mark = np.zeros(len(words), bool)
        else:
            first = pc.starts_with(words, "\n")
            with_mark = np.asarray(first)
            forms = words if bare else pc.if_else(first, words, pc.binary_join_element_wise("", words, " "))
            texts = pc.if_else(first, words, pc.binary_join_element_wise("", forms, "\n"))
        alone = pc.or_(pc.match_substring(words, "<|"), pc.match_substring(forms, "\x01"))
        alone = np.asarray(pc.or_(alone, pc.equal(pc.binary_length(words), 0))) | (self.mark_id is None) | (with_mark & np.asarray(pc.equal(words, "\n")))
        together, parts, sizes = np.flatnonzero(~alone), [], np.zeros(len(words), np.int64)
        order = [together]
        for a in range(0, len(together), _TOGETHER):
            of = together[a : a + _TOGETHER]
            ids = self._ask(["".join(texts.take(pa.array(of)).to_pylist())])[0]
            at = np.flatnonzero(ids == self.mark_id)
            if len(at) != len(of):  # a mark that isn't one id by itself after all
                alone[of] = True
                continue
            keep = np.ones(len(ids), bool)
            keep[at[~with_mark[of]]] = False
            sizes[of] = np.diff(np.append(at, len(ids))) - ~with_mark[of]
            parts.append(ids[keep])
        order = np.concatenate([together[~alone[together]], rest := np.flatnonzero(alone)])
        for i, ids in zip(rest.tolist(), self._ask(forms.take(pa.array(rest)).to_pylist()), strict=True):
            sizes[i] = len(ids)
            parts.append(ids)
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return _binary(np.concatenate([np.empty(0, "<u4"), *parts]), sizes[order]).take(pa.array(back))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Arrow cuts the texts into words, numbers the distinct ones and puts their ids side by side; the library is
        asked for those that it hasn't been asked for lately. No Python object is made for a word."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.keeps_blank:
            return self._joined(pc.replace_substring(texts, "\n", " "))
        uneven = pc.match_substring_regex(texts, UNEVEN)
        if not pc.any(uneven).as_py():
            return self._joined(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""))
        whole = iter(self._ask(texts.filter(uneven).to_pylist()))
        even = iter(self.encode(texts.filter(pc.invert(uneven))))
        return [next(whole).tobytes() if x else next(even) for x in uneven.to_pylist()]

    def _joined(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        cuts, data = ends[lists.offsets.to_numpy()].tolist(), ids.buffers()[2]
        skip = len(self.newline)
        out = [data[a + skip : b].to_pybytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        del lists, coded, ids, ends, data
        pa.default_memory_pool().release_unused()
        return out


def _binary(ids: np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """One binary value for each run of sizes ids."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(4 * sizes, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


_MADE: dict = {}


def worker(path: str, keeps_blank: bool) -> Encoder:
    """One encoder for each Python worker: its memory lives on from task to task."""
    if path not in _MADE:
        _MADE[path] = Encoder(path, keeps_blank)
    return _MADE[path]
