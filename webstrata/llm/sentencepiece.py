"""SentencePiece encoding and decoding: Viterbi over a double-array trie of scored pieces.

The pieces and scores of a model file are read as a Unigram model. White space becomes the marker
U+2581, with one marker before the text; the best segmentation is the one of largest total
score, the earlier start winning ties. Characters without a piece cost ten less than the worst
score and become byte pieces. No piece runs on into a marker, so each stretch from a marker to
the next is segmented once per process and remembered.

A null text counts as empty and has no pieces. Texts of any length are encoded whole. Repeated
rows are encoded each; columns whose names clash with the outputs give way.
"""

from __future__ import annotations

import codecs
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webstrata.llm.frames import add_columns
from webstrata.llm.text import slices
from webstrata.llm.workers import cache

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_PARTS = 200_000
CHUNK_BYTES = 1 << 20

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class DoubleArray:
    """A trie over bytes: the child of state s by byte b is base[s] + b if its check is s."""

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        root: dict = {}
        for key, value in zip(keys, values):
            node = root
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = value
        self.base, self.check, self.value = [0], [0], [-1]
        used, free, pending = np.zeros(1 << 12, bool), 1, [(0, root)]
        used[0] = True
        while pending:
            state, node = pending.pop()
            self.value[state] = node.get(-1, -1)
            labels = np.array(sorted(b for b in node if b >= 0))
            if not len(labels):
                continue
            base = max(1, free - int(labels[0]))
            while True:  # the first place where the slots of all labels are free
                if base + 768 > len(used):
                    used = np.concatenate([used, np.zeros(len(used), bool)])
                fits = ~used[base + np.arange(256)[:, None] + labels].any(axis=1)
                if fits.any():
                    base += int(fits.argmax())
                    break
                base += 256
            slots = base + labels
            used[slots] = True
            grow = int(slots[-1]) + 1 - len(self.check)
            if grow > 0:
                self.base += [0] * grow
                self.check += [-1] * grow
                self.value += [-1] * grow
            self.base[state] = base
            for byte, slot in zip(labels.tolist(), slots.tolist()):
                self.check[slot] = state
                pending.append((slot, node[byte]))
            # Slots far behind the last fit are rarely taken; the search moves on from them.
            free = max(free, base - 2048)
            while free < len(used) and used[free]:
                free += 1
        self.base += [0] * 256
        self.check += [-1] * 256
        self.value += [-1] * 256

    def prefixes(self, data: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of each key that starts at ``at``, shortest first."""
        base, check, value, state = self.base, self.check, self.value, 0
        for place in range(at, len(data)):
            child = base[state] + data[place]
            if check[child] != state or child == 0:
                return
            state = child
            if value[state] >= 0:
                yield place + 1, value[state]


class Unigram:
    """Pieces with scores, ready to encode and decode."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_of: dict[int, int],
                 silent: set[int], unknown: int = 0) -> None:
        """``bytes_of`` maps byte pieces to their byte; ``silent`` ids are never segmented into."""
        plain = [i for i in range(len(pieces)) if i not in silent and i not in bytes_of]
        self.scores, self.unknown = scores, unknown
        self.trie = DoubleArray([pieces[i].encode() for i in plain], plain)
        self.byte_ids = {byte: i for i, byte in bytes_of.items()}
        self.unknown_score = min((scores[i] for i in plain), default=0.0) - UNKNOWN_PENALTY
        self.shown = [bytes([bytes_of[i]]) if i in bytes_of else
                      b"" if i in silent else piece.replace(MARKER, " ").encode()
                      for i, piece in enumerate(pieces)]
        self.dtype = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        self.splits = not any(MARKER in pieces[i].lstrip(MARKER) for i in plain)
        self.lines = self.splits and not any("\n" in pieces[i] for i in plain)
        self._known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> "Unigram":
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(count)]
        bytes_of = {i: int(pieces[i][3:5], 16) for i in range(count) if model.is_byte(i)}
        silent = {i for i in range(count)
                  if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        return cls(pieces, [model.get_score(i) for i in range(count)], bytes_of, silent,
                   model.unk_id())

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text whose white space is marked already."""
        data = text.encode()
        size = len(data)
        best, came, piece = [-math.inf] * (size + 1), [-1] * (size + 1), [0] * (size + 1)
        best[0], at = 0.0, 0
        scores, trie = self.scores, self.trie
        base, check, value_of = trie.base, trie.check, trie.value
        while at < size:
            lead = data[at]
            next_ = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            single, here = False, best[at]
            state, end = 0, at
            while end < size:  # walks the trie along the text, as `DoubleArray.prefixes` does
                child = base[state] + data[end]
                if check[child] != state or child == 0:
                    break
                state = child
                end += 1
                value = value_of[state]
                if value >= 0:
                    total = here + scores[value]
                    if total > best[end]:
                        best[end], came[end], piece[end] = total, at, value
                    if end == next_:
                        single = True
            if not single:
                total = here + self.unknown_score
                if total > best[next_]:
                    best[next_], came[next_], piece[next_] = total, at, -1
            at = next_
        out: list[int] = []
        at = size
        while at > 0:
            start = came[at]
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(data[start:at])]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)  # unknown characters in a row are one piece
            at = start
        return out[::-1]

    def _ids(self, part: str) -> bytes:
        ids = self._known.get(part)
        if ids is None:
            ids = self._known[part] = np.array(self.segment(part), self.dtype).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian ids of a text."""
        if not text:
            return b""
        if len(self._known) > CACHED_PARTS:
            self._known.clear()
        marked = MARKER + text.replace(" ", MARKER)
        if not self.splits:
            return np.array(self.segment(marked), self.dtype).tobytes()
        known, out = self._known, []
        for number, line in enumerate(marked.split("\n") if self.lines else [marked]):
            if number:
                out.append(self._ids("\n"))
            parts = line.split(MARKER)
            if "" in parts[1:]:  # markers in a row may share pieces: they stay with their word
                parts = _runs(line)
            else:
                parts = [p for p in (parts[0], *(MARKER + p for p in parts[1:])) if p]
            for part in parts:
                ids = known.get(part)
                out.append(self._ids(part) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of little-endian ids; bytes that are not UTF-8 become U+FFFD each."""
        raw = b"".join(map(self.shown.__getitem__, np.frombuffer(ids, self.dtype).tolist()))
        text = raw.decode("utf-8", "each-byte")
        return text[1:] if text.startswith(" ") else text


def _runs(line: str) -> list[str]:
    """Parts of a line, each a run of markers and the characters up to the next run."""
    parts, begin = [], 0
    for at in range(1, len(line)):
        if line[at] == MARKER and line[at - 1] != MARKER:
            parts.append(line[begin:at])
            begin = at
    return [*parts, line[begin:]] if line else []


_models: dict[str, Unigram] = cache()


def model_of(path: str) -> Unigram:
    """The process's model for a file."""
    if path not in _models:
        _models[path] = Unigram.load(path)
    return _models[path]


def encode_texts(docs: DataFrame, path: str, keep: list[str] | None = None,
                 with_ids: bool = False) -> DataFrame:
    """Append n_pieces, n_byte_pieces, ids_crc32, decoded_same and, if asked, ids and decoded.

    ``ids_crc32`` is over little-endian 32-bit ids; ``decoded_same`` tells whether decoding the ids
    gives the text again.
    """
    def compute(batches: Iterator[pa.RecordBatch]):
        model = model_of(path)
        is_byte = np.zeros(len(model.shown), bool)
        is_byte[list(model.byte_ids.values())] = True
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                encoded = [model.encode(t) for t in texts]
                ids = [np.frombuffer(e, model.dtype) for e in encoded]
                decoded = [model.decode(e) for e in encoded]
                arrays = [
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    pa.array([d == t for d, t in zip(decoded, texts)])]
                if with_ids:
                    arrays += [pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
                               pa.array(decoded)]
                yield part, arrays

    return add_columns(docs, "n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, "
                             "decoded_same boolean" + ", ids binary, decoded string" * with_ids,
                       compute, keep)
