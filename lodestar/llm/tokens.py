"""Exact token ids of whole texts, a batch at a time, with a bounded cache of units.

The tokenizers library gives every id. Both vocabularies split a text at white
space before any merge, so a text's ids are the ids of its white-space units
put together. A batch is split and its distinct units are found in Arrow; only
these are looked up, and encoded if they are new, and the batch's ids are then
gathered in numpy from a pool of bounded size. Texts whose white space could
join units differently take a slower path through the same pool.
"""

from __future__ import annotations

import codecs
import re
import string
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Units after which the cache begins anew.
UNIT_LIMIT = 300_000
MARK_LIMIT = 10_000

#: Marks that follow letters as an input of their own; an apostrophe may be part of a contraction.
_TRAIL = "".join(sorted(set(string.punctuation) - {"'"}))
# White space as the vocabularies' patterns have it; Python's own class also holds \x1c to \x1f.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_PARTS = re.compile(f"({_SPACE}+)")
_RE2_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts with runs of white space, with white space at an end, or with the mark below, take the slower path.
_SLOW = f"{_RE2_SPACE}{_RE2_SPACE}|^{_RE2_SPACE}|{_RE2_SPACE}\\z|\\x01"
_START = "\x01"
_BLANK = "\u0120"

# Byte-level vocabularies write a byte as a printable character: printable Latin-1 stands for itself, the rest from U+0100 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_REST = [b for b in range(256) if b not in _PLAIN]
_BYTE_CHARS = {b: 256 + _REST.index(b) for b in _REST}


#: The printable character of each byte.
_CHARMAP = "".join(chr(_BYTE_CHARS.get(b, b)) for b in range(256))


def load(path: str) -> Tokenizer:
    """The vocabulary, used as its description says: strings of special tokens in a text are ordinary text."""
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


class _Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers; nothing for null and empty texts.

    The ids of the k-th unit in `known` are pool[begin[k] : begin[k] + size[k]].
    """

    def __init__(self, path: str):
        self.tok = load(path)
        self.merged = self.tok.model.tokenize
        self.marks: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.begin, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _ids(self, unit: str) -> list[int]:
        raise NotImplementedError

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _merge(self, text: str) -> list[int]:
        """The ids of one input of the vocabulary's merges."""
        if not (text.isascii() and text.isalpha()):
            text = codecs.charmap_decode(text.encode(), "strict", _CHARMAP)[0]
        return [t.id for t in self.merged(text)]

    def _trail(self, marks: str) -> list[int]:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._merge(marks)
            if len(self.marks) < MARK_LIMIT:
                self.marks[marks] = ids
        return ids

    def _learn(self, units: list[str]) -> None:
        """Adds units that are not known."""
        fresh, ends = array("I"), array("q")
        for unit in units:
            fresh.extend(self._ids(unit))
            ends.append(len(fresh))
        size = np.diff(np.array(ends, np.int64), prepend=0)
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, np.array(fresh, "<u4")])

    def _gathered(self, split: pa.ListArray) -> Iterator[bytes]:
        """The ids of each list of units."""
        if len(self.known) > UNIT_LIMIT:
            self._forget()
        coded = split.flatten().dictionary_encode()
        numbers = pc.index_in(coded.dictionary, self.known)
        new = coded.dictionary.filter(numbers.is_null())
        if len(new):
            self._learn(new.to_numpy(zero_copy_only=False).tolist())
            self.known = pa.concat_arrays([self.known, new])
            numbers = pc.index_in(coded.dictionary, self.known)
        numbers = numbers.to_numpy()[coded.indices.to_numpy()]
        counts = self.size[numbers]
        ends = np.cumsum(counts)
        # the place of each id: where its unit begins in the pool, and its place within the unit
        ids = self.pool[np.repeat(self.begin[numbers] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield ids[lo:hi].tobytes()


class WordEncoder(_Encoder):
    """For vocabularies that drop white space and lower-case (word_bpe)."""

    def _ids(self, unit: str) -> list[int]:
        if not unit:
            return []
        core = unit if unit.isalpha() else unit.rstrip(_TRAIL)
        if not core.isalpha():
            return self._whole(unit)
        lowered = core.lower()
        if not core.isascii() and ("Σ" in core or not unicodedata.is_normalized("NFC", core) or not lowered.isalpha()):
            return self._whole(unit)
        # a run of letters and one of marks are an input of the vocabulary's merges each
        ids = self._merge(lowered)
        return ids + self._trail(unit[len(core) :]) if len(core) < len(unit) else ids

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        # blanks and newlines are white space to every part of the tokenizer; any other stays inside its unit
        yield from self._gathered(pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " "))


class ByteEncoder(_Encoder):
    """For byte-level vocabularies that keep white space and attach one blank to the next word (byte_bpe).

    A unit stands for a blank and what follows it; one that begins with a
    newline for just that, and one that begins with _START for its rest alone.
    """

    def _ids(self, unit: str) -> list[int]:
        if unit.isalpha():
            # a blank and letters are one input of the vocabulary's merges
            return [t.id for t in self.merged(_BLANK + unit)] if unit.isascii() else self._merge(" " + unit)
        if unit[:1] == "\n":
            return self._trail("\n") + self._ids(_START + unit[1:])
        before, rest = ("", unit[1:]) if unit[:1] == _START else (" ", unit)
        core = rest.rstrip(_TRAIL)
        if not core.isalpha():
            return self._whole(before + rest) if rest else []
        ids = self._merge(before + core)
        return ids + self._trail(rest[len(core) :]) if len(core) < len(rest) else ids

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        texts = pc.fill_null(texts, "")
        slow = pc.match_substring_regex(texts, _SLOW)
        quick = pc.replace_substring(pc.if_else(slow, "", texts), "\n", " \n")
        found = self._gathered(pc.split_pattern(pc.binary_join_element_wise(_START, quick, ""), " "))
        if not pc.any(slow).as_py():
            yield from found
            return
        quick_ids = list(found)
        runs = self._gathered(pa.array([_run_units(t) for t in texts.filter(slow).to_pylist()], pa.list_(pa.string())))
        for ids, late in zip(quick_ids, slow.to_pylist(), strict=True):
            yield next(runs) if late else ids


def _run_units(text: str) -> list[str]:
    """A run of white space before a word is all but its last character as one piece; a last blank joins the word."""
    if _START in text:
        return [_START + text]
    parts = _PARTS.split(text)
    out = [_START + parts[0]]
    for space, word in zip(parts[1::2], parts[2::2], strict=True):
        if not word:
            out.append(_START + space)
            continue
        if len(space) > 1:
            out.append(_START + space[:-1])
        if space[-1] == " ":
            out.append(word)
        else:
            out += [_START + space[-1], _START + word]
    return out


_ENCODERS: dict = {}


def release() -> bool:
    """Drops the caches, if there are any; operators that need the memory call this in workers that have encoded before."""
    held = bool(_ENCODERS)
    _ENCODERS.clear()
    return held


def encoder(kind: type, path: str):
    """One encoder per worker and file."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]
