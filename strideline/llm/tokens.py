"""Exact token ids of whole texts, with the pieces between certain borders encoded once.

A border is certain when the pre-tokeniser splits there whatever stands around it.  Between
such borders ids depend on the piece alone, so a worker keeps those of short pieces.

Cases: an empty text has no ids; a text that holds a special string goes to the library as a whole.
"""

from __future__ import annotations

import re
from array import array

from tokenizers import Tokenizer

#: Characters that every Unicode version has as letters, digits or marks, never as space.
SURE = "!-~À-ɏ"

#: Byte-level split: a single space joins the word after it; a lone line end stands alone.
_PLAIN = re.compile(rf"[ \n{SURE}]*+").fullmatch
_UNSURE = re.compile(rf" (?![{SURE}])|(?<![{SURE}])\n|\n(?![{SURE}])")
_BORDER = re.compile(rf"(?= [{SURE}])|(?<=[{SURE}])(?=\n[{SURE}])|(?<=[{SURE}]\n)(?=[{SURE}])")

#: Letters in every Unicode version, which normalisation leaves as they are.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch

#: A letter and the ASCII symbols that close a piece behind it; an apostrophe may begin an ending and is left out.
_CLOSED = re.compile(r"(.*[A-Za-zÀ-ÖØ-öø-ɏ])([!-&(-/:-@\[-`{-~]+)").fullmatch

#: The characters by which byte-level vocabularies show bytes above ASCII and a space.
_SHOWN, _SHOWN_SPACE = {b: 162 + b for b in range(127, 161)} | {173: 323}, chr(288)

_LOADED: dict[tuple[str, str, int | None], "PieceEncoder"] = {}


def _even(text: str) -> bool:
    """Single spaces and line ends between characters that are sure; says no to some texts without unsure places."""
    return (
        "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text
        and text[:1] not in " \n" and text[-1:] not in " \n" and _PLAIN(text) is not None
    )


class PieceEncoder(dict):
    """Maps a piece to its ids as little-endian unsigned 32-bit integers."""

    MOST_PIECES, LONGEST_KEPT = 1_400_000, 48

    def __init__(self, path: str, split: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.packed = [array("I", [i]).tobytes() for i in range(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values()))]
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {m.encode(): self.library(m) for m in ".,!?"}
        self.older: dict = {}
        self.tails: dict[str, bytes | None] = {}
        self.of = {"byte_level": self._byte_level, "spaces": self._spaces}[split]

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return self.library(text)
        if len(self) > self.MOST_PIECES // 2:
            # Pieces that occur again come back from the older half.
            self.older = dict(self)
            self.clear()
        return self.of(text)

    def _byte_level(self, text: str) -> bytes:
        """Keys: the text of a piece after a mark, or a word whose leading space is left out."""
        if _even(text) or _UNSURE.search(text) is None:
            pieces = ("\0" + text).replace("\n", " \n \0").split(" ")
        else:
            pieces = ["\0" + p for p in _BORDER.split(text)]
        return b"".join(map(self.__getitem__, pieces))

    def _spaces(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))

    def tail(self, marks: str) -> bytes | None:
        """Ids of marks behind a letter, if the library gives them apart from the letter's."""
        if marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            letter, both = self.library("a"), self.library("a" + marks)
            self.tails[marks] = both[len(letter):] if both.startswith(letter) else None
        return self.tails[marks]

    def _word(self, lead: str, word: str) -> bytes:
        """Ids of a piece; one of letters alone is a single token of the pre-tokeniser."""
        if _LETTERS(word) is None:
            return self.library(lead + word)
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_SHOWN)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(_SHOWN_SPACE + word if lead else word)])

    def __missing__(self, key: str | bytes) -> bytes:
        if (ids := self.older.get(key)) is not None:
            self[key] = ids
            return ids
        if isinstance(key, str):
            closed = _CLOSED(key)
            base, mark = closed.groups() if closed else (key, "")
            tail = self.tail(mark) if closed else None
        else:
            base, mark = key[:-1], key[-1:]
            tail = self.marks.get(mark) if base[-1:].isalpha() else None
        if tail is not None:
            # A letter before closing marks is a border, too; kept from the second time on.
            known = base in self or base in self.older
            ids = self[base] + tail
            if not known:
                return ids
        elif isinstance(key, bytes):
            word = key.decode()
            low = word.lower()
            ids = self._word("", low) if _LETTERS(low) else self.library(word)
        elif key[:1] == "\0":
            ids = self._word("", key[1:])
        else:
            ids = self.library(key) if key == "\n" else self._word(" ", key)
        if len(key) <= self.LONGEST_KEPT:
            self[key] = ids
        return ids


def encoder(path: str, split: str, most_pieces: int | None = None) -> PieceEncoder:
    """The worker's encoder for a tokenizer file; ``split`` names its kind of borders.

    ``most_pieces`` bounds the pieces that it keeps: 200 bytes each, and fewer take more time.
    """
    key = path, split, most_pieces
    if key not in _LOADED:
        _LOADED[key] = PieceEncoder(path, split)
        if most_pieces is not None:
            _LOADED[key].MOST_PIECES = most_pieces
    return _LOADED[key]
