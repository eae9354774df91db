"""Token ids of whole texts by a public tokenizer, at the speed of a table lookup.

A byte-level BPE with this pre-tokenisation never joins characters across a
single blank between two non-blank characters.  Texts are cut there.  The ids
of units (blank and word; marks behind a word and line ends are units of their
own) are kept in a bounded table that drops what has not been used for longest.
Units that are no plain word are made of the tokenizer's own pre-tokens, which
have a table too.  The ids of a text are those of ``encode(text)``.  Texts
that hold a special token's string, and tokenizers of another kind, take the
plain call.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import regex

#: Entries of the table of units, of all generations; some 220 bytes each in a worker process.
TABLE_ENTRIES = 1_200_000
#: Entries of the table of pre-tokens of other units.
PIECE_ENTRIES = 100_000
BLOCK = 1 << 20
# A mark between a letter and a single blank or line end is a pre-token of its own, and so is a single line end
# between two characters.  They are set apart as units by control characters that no other unit then holds.
_MARK, _LINE = "\x00", "\x01"
# What precedes is looked at last: the search runs over marks and line ends only.
_MARKED = re.compile(r"([.,;:!?])(?<=[A-Za-zÀ-ÖØ-öø-ÿ].)(?=[ \n]\S)")
_ENDED = re.compile(r"\n(?<=\S\n)(?=\S)")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space but the blank and the line end.
_OTHER_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
# Fixed value: the pre-tokenisation pattern of byte-level BPE.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_names() -> dict[int, str]:
    """The character by which byte-level BPE writes each byte: itself where it prints, else one from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + k) for k, b in enumerate(others)}


_NAMES = _byte_names()


class _Table(dict):
    """A table that makes missing entries.

    It has two generations; an entry of the older one moves to the younger when
    it is used.  Where that is full the older one goes, so what is dropped was
    not used while half the table filled.
    """

    def __init__(self, make: Callable[[str], bytes], room: int):
        super().__init__()
        self.make, self.room, self.old = make, room // 2, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.room:
            self.old = dict(self)
            self.clear()


def _plain(word: str) -> bool:
    """Letters only, of those whose class does not depend on the version of Unicode: with its blank one pre-token."""
    return word.isalpha() and (word.isascii() or max(word) <= "ÿ")


class UnitTokenizer:
    def __init__(self, path: str, room: int = TABLE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        self.special = [a.content for a in t.get_added_tokens_decoder().values()]
        pre = t.pre_tokenizer
        self.by_unit = (isinstance(t.model, models.BPE) and isinstance(pre, pre_tokenizers.ByteLevel)
                        and not pre.add_prefix_space and pre.use_regex and t.normalizer is None)
        self.pieces = _Table(self._merged, min(room, PIECE_ENTRIES))
        self.units = _Table(self._unit, room)

    def _unit(self, unit: str) -> bytes:
        """Ids of a blank and a word, of a mark, or of a line end and the word behind it."""
        if unit[0] == _MARK:
            return self._of(unit[1:])
        if unit[0] == _LINE:
            return self._of("\n") + self._of(unit[1:])
        return self._merged(" " + unit) if _plain(unit) else self._of(" " + unit)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _of(self, text: str) -> bytes:
        """Ids of a short text by way of its pre-tokens."""
        if text.isascii() or max(text) <= "\u00ff":
            found = _PATTERN.findall(text)
        else:  # characters whose class depends on the version of Unicode
            found = [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        if len(found) == 1:
            return self.pieces[found[0]]
        return b"".join([self.pieces[p] for p in found])

    def _merged(self, piece: str) -> bytes:
        named = piece.encode().decode("latin-1").translate(_NAMES)
        return self._packed([x.id for x in self.tokenizer.model.tokenize(named)])

    @staticmethod
    def _units(block: str) -> list[str]:
        """A block cut at single blanks between two non-blank characters."""
        if ("  " in block or " \n" in block or "\n " in block or block[:1] == " " or block[-1:] == " "
                or any(c in block for c in _OTHER_SPACE)):
            return _CUT.split(block)
        return block.split(" ")

    def _blocks(self, text: str) -> Iterator[str]:
        """The text in blocks of about ``BLOCK`` characters, cut only where units are."""
        at = 0
        while len(text) - at > BLOCK:
            cut = _CUT.search(text, at + BLOCK)
            if cut is None:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if not self.by_unit or any(s in text for s in self.special):
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        out = []
        apart = _MARK not in text and _LINE not in text
        for block in self._blocks(text):
            if apart:
                block = _ENDED.sub(" " + _LINE, _MARKED.sub(" " + _MARK + r"\1", block))
            first, *units = self._units(block)
            out.append(self._of(first) if first else b"")
            out.append(b"".join(map(self.units.__getitem__, units)))
            self.units.trim()
            self.pieces.trim()
        return b"".join(out)


_KEPT: dict[str, UnitTokenizer] = {}


def tokenizer(path: str) -> UnitTokenizer:
    """One tokenizer a worker process."""
    if path not in _KEPT:
        _KEPT[path] = UnitTokenizer(path)
    return _KEPT[path]
