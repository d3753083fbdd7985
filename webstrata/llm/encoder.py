"""Token ids of whole texts by a public vocabulary file, word by word.

The vocabularies split texts at white space before any merge, so the words of a text can be
encoded apart. Each process keeps the ids of words it has met; only new ones reach the
tokenizers library. A new word of plain letters, with or without one closing mark, needs the
merges alone, since a run of letters is one unit of such vocabularies; others pass the whole
tokenizer. Texts with runs of white space, or with other white space beside a line's end, are
encoded whole where white space has ids: such runs can be one token.
"""

from __future__ import annotations

import json
from array import array

import numpy as np

from webstrata.llm.workers import cache

CACHED_BYTES = 40 << 20  # of each of two generations, the cost of an entry included
ENTRY_BYTES = 160
_PLAIN_BELOW = "ɐ"  # letters below keep their form and class in every Unicode version
_MARKS = ".,;:!?"

_encoders: dict[tuple[str, bool], "WordEncoder"] = cache()


def encoder(path: str, specials: bool = False) -> "WordEncoder":
    """The process's encoder for a vocabulary file.

    With ``specials``, a special token's string inside a text gives that token's id, as the
    library does by default; without, it is ordinary text.
    """
    if (path, specials) not in _encoders:
        _encoders[path, specials] = WordEncoder(path, specials)
    return _encoders[path, specials]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {byte: chr(byte) for byte in shown}
    for byte in range(256):
        letters.setdefault(byte, chr(256 + len(letters) - len(shown)))
    return letters


class Known(dict):
    """Ids by word, found on first use; when full, it starts anew beside its elder generation."""

    def __init__(self, find) -> None:
        super().__init__()
        self._find, self._elder, self._bytes = find, {}, 0

    def __missing__(self, word: str) -> bytes:
        ids = self._elder.get(word)
        if ids is None:
            ids = self._find(self, word)
        self[word] = ids
        self._bytes += ENTRY_BYTES + len(word) + len(ids or b"")
        return ids

    def learn(self, words: set[str], find_all) -> None:
        """Enter all of ``words``; ``find_all`` gives the ids of a list of new ones."""
        new = []
        for word in words:
            if word not in self:
                if word in self._elder:
                    self[word]  # moves over
                else:
                    new.append(word)
        for word, ids in zip(new, find_all(new)):
            self[word] = ids
            self._bytes += ENTRY_BYTES + len(word) + len(ids)

    def settle(self) -> None:
        if self._bytes > CACHED_BYTES:
            self._elder, self._bytes = dict(self), 0
            self.clear()


class WordEncoder:
    def __init__(self, path: str, specials: bool = False) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not specials
        self._tokenizer.no_truncation()
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        parts = json.loads(self._tokenizer.to_str())
        self._lowers = "Lowercase" in json.dumps(parts["normalizer"])
        # Where white space has ids, a word carries the space before it.
        self._keeps_space = bool(self._tokenizer.encode(" ", add_special_tokens=False).ids)
        self._letters = byte_letters()
        self._merge = self._tokenizer.model.tokenize
        self._words = Known(lambda known, word: self._find(known, word, ""))
        self._spaced = Known(lambda known, word: self._find(known, word, " "))
        self._words[""] = b""
        self._marks = {mark: self._whole(mark) for mark in _MARKS}
        self._line = self._whole("\n") if self._keeps_space else b""

    def _pack(self, ids: list[int]) -> bytes:
        return array(self._code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _is_plain(self, word: str) -> bool:
        # The small form of U+0130 has a combining mark, at which the vocabulary splits.
        return word.isalpha() and max(word) < _PLAIN_BELOW and (
            not self._lowers or word.lower().isalpha())

    def _find(self, known: Known, word: str, before: str) -> bytes:
        mark = self._marks.get(word[-1:])
        if mark is not None:
            core = word[:-1]
            if self._is_plain(core):
                return known[core] + mark
        elif self._is_plain(word):
            unit = before + (word.lower() if self._lowers else word)
            return self._pack([token.id for token in self._merge(
                unit.encode().decode("latin-1").translate(self._letters))])
        return self._whole(before + word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of type ``dtype``."""
        return self._encode_spaced(texts) if self._keeps_space else self._encode_bare(texts)

    def _encode_bare(self, texts: list[str]) -> list[bytes]:
        self._words.settle()
        self._words[""] = b""
        get = self._words.__getitem__
        return [b"".join(map(get, text.replace("\n", " ").split(" "))) for text in texts]

    def _encode_spaced(self, texts: list[str]) -> list[bytes]:
        self._words.settle()
        self._spaced.settle()
        head, rest, out = self._words, self._spaced.__getitem__, []
        for text in texts:
            rows = text.split("\n")
            lines = [row.split(" ") for row in rows]
            if any("" in line for line in lines) or any(
                    row[0].isspace() or row[-1].isspace() for row in rows):
                out.append(self._whole(text))
            else:
                out.append(self._line.join(
                    [head[line[0]] + b"".join(map(rest, line[1:])) for line in lines]))
        return out
