"""Cutting texts where no token can cross, and encoding the pieces with a remembered table.

Byte-level BPE: its pattern ends a match before a space or line feed that stands between two characters which are not
white space, so pieces cut there have the ids that the whole text has. Where white space stands beside white space no
cut is made. The table of known pieces has a fixed number of places; further pieces are encoded each time.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa

#: Pieces a worker remembers.
KNOWN = 300_000
#: Letters that are one character in every form; a run of them is one piece for the pattern, and so is a run of marks.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
MARKS = '.,!?;:|#$%&*"'
_DOUBLE = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")


def tokenizer_of(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def cut_pieces(texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The texts, end to end, in pieces whose ids are, end to end, those of each text; and at which piece each text
    starts, with the number of pieces last."""
    coded = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(coded), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in coded], dtype=np.int64)])
    cut = np.zeros(len(data) + 1, bool)
    feed = data == 0x0A
    cut[:-1] = (data == 0x20) | feed
    cut[1:] |= feed
    for i, text in enumerate(texts):
        if _DOUBLE.search(text):
            cut[begin[i]:begin[i + 1]] = False
            cut[begin[i] + np.cumsum([len(p.encode()) for p in _SAFE.split(text)])] = True
    cut[begin] = True
    edges = np.flatnonzero(cut)
    buffers = [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, buffers), np.searchsorted(edges, begin)


def safe_pieces(text: str) -> list[str]:
    """The pieces of one text."""
    return [p.decode() for p in cut_pieces([text])[0].to_pylist()]


def byte_of_character() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


_WRITTEN = {b: c for c, b in byte_of_character().items()}


def letters_and_marks(word: str) -> tuple[str, str] | None:
    """A run of letters and the run of marks behind it, if the word is no more than that."""
    if word.isascii() and word.isalpha():
        return word, ""
    letters = word.rstrip(MARKS)
    return (letters, word[len(letters):]) if letters and _LETTERS(letters) else None


def in_vocabulary(word: str) -> str:
    """A word as a byte-level vocabulary writes it."""
    if word.isascii() and word.isalpha():
        return word
    if word[:1] == " " and word.isascii() and word[1:].isalpha():
        return _WRITTEN[32] + word[1:]
    return word.encode().decode("latin-1").translate(_WRITTEN)


class Encoder:
    """Ids of texts as packed little-endian integers."""

    def __init__(self, path: str, known: int = KNOWN):
        self.tokenizer = tokenizer_of(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.limit = known
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _pack(self, ids) -> bytes:
        packed = array(self.kind, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def pieces(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each piece, all in one call of the library."""
        return [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str], lead: str = "") -> dict[str, bytes]:
        """Packed ids of each of the words with `lead` before it. Runs of letters go straight to the library's model."""
        found: dict[str, bytes] = {}
        rest, model = [], self.tokenizer.model
        for word in words:
            parts = letters_and_marks(word)
            if parts is None:
                rest.append(word)
                continue
            letters, marks = parts
            if letters not in found:
                ids = self.known.get((lead + letters).encode())
                found[letters] = ids or self._pack([t.id for t in model.tokenize(in_vocabulary(lead + letters))])
            if marks:
                if marks not in self.marks:
                    self.marks[marks] = self.pieces([marks])[0]
                found[word] = found[letters] + self.marks[marks]
        for low in range(0, len(rest), 4096):
            part = rest[low:low + 4096]
            found.update(zip(part, self.pieces([lead + w for w in part]), strict=True))
        return found

    def distinct(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces that differ; new ones go to the table while it has places."""
        out = list(map(self.known.get, pieces))
        new = {p: b"" for p, ids in zip(pieces, out, strict=True) if ids is None}
        model, rest = self.tokenizer.model, {" ": [], "": []}
        for piece in new:
            word = piece.decode()
            lead = " " if word[0] == " " else ""
            letters = word[len(lead):]
            if letters.isalpha() and letters.isascii():
                new[piece] = self._pack([t.id for t in model.tokenize(_WRITTEN[32] + letters if lead else letters)])
            else:
                rest[lead].append(letters)
        for lead, words in rest.items():
            coded = self.words(words, lead)
            new.update(((lead + w).encode(), coded[w]) for w in words)
        if len(self.known) + len(new) <= self.limit:
            self.known.update(new)
        return [new[p] if ids is None else ids for p, ids in zip(pieces, out, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; each distinct piece of the texts is looked up once."""
        pieces, first = cut_pieces(texts)
        found = pieces.dictionary_encode()
        coded = self.distinct(found.dictionary.to_pylist())
        ids, size = np.frombuffer(b"".join(coded), self.dtype), np.array([len(c) for c in coded], np.int64) // self.dtype.itemsize
        place = found.indices.to_numpy()
        length = size[place]
        end = np.concatenate([[0], np.cumsum(length)])
        packed = ids[np.repeat((np.cumsum(size) - size)[place] - end[:-1], length) + np.arange(end[-1])].tobytes()
        at = (end[first] * self.dtype.itemsize).tolist()
        return [packed[a:b] for a, b in zip(at, at[1:], strict=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each worker and tokenizer."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
