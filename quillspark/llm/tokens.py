"""Exact, cached tokenising of whole texts with the ``tokenizers`` library.

Texts repeat their words, so a run of texts is cut into pieces where the pre-tokeniser must cut anyway, Arrow
finds the different pieces, and each of them is encoded once for as long as the cache holds it; the ids of the
texts are then taken from those of their pieces.  All of it but the encoding itself is a few passes over arrays.

A cut is exact where no match of the pre-tokeniser's pattern can run over it, whatever stands around:

* before a space that follows a character that isn't white space (byte-level pattern), before any space or
  newline (word-level pattern, which drops white space);
* on both sides of a newline between two characters that aren't white space (byte-level);
* between a letter or digit and ASCII punctuation, and the other way round but after an apostrophe, which may
  begin a contraction; between a letter and a digit; between two digits (word-level, a token each).

Where the kind of a character outside ASCII isn't plain from its bytes there is no cut, so a piece is only longer.
A text that holds one of the tokenizer's special strings is one piece.

Of pieces that aren't in the cache, those that are one pre-token and need no normalising but lower case go straight
to the tokenizer's model, many at a time; others are encoded by the whole tokenizer, joined by a mark that the pre-tokeniser keeps
apart from its neighbours; those that hold the mark themselves, or white space that could run into it, go one by one.

A Python worker keeps its encoder, and so its cache, from task to task; the cache is bounded in bytes.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm.text import utf8

#: Longer pieces, in bytes, such as texts that are encoded whole, don't stay in the cache.
_LONG = 128
_AT_A_TIME = 4096
#: Classes of bytes: white space and controls, space, newline, digit, letter, apostrophe, other ASCII, byte that continues or begins a character.
_BLANK, _SPACE, _NEWLINE, _DIGIT, _LETTER, _QUOTE, _PUNCT, _TAIL, _HEAD = range(9)
_LATIN_LETTER = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"


def _byte_classes() -> np.ndarray:
    table = np.full(256, _PUNCT, np.uint8)
    table[: 0x21] = table[0x7F] = _BLANK
    table[0x20], table[0x0A], table[0x27] = _SPACE, _NEWLINE, _QUOTE
    table[0x30:0x3A] = _DIGIT
    table[0x41:0x5B] = table[0x61:0x7B] = _LETTER
    table[0x80:0xC0] = _TAIL
    table[0xC0:] = _HEAD
    return table


_CLASS_OF = _byte_classes()


def _byte_letters() -> np.ndarray:
    """The byte-level pre-tokeniser's letter for each byte, in UTF-8 after zeros: visible Latin-1 characters stand for themselves, the
    others follow from U+0100; a newline, which stands between pieces, stays."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100), 0x0A}
    others = iter(range(0x100, 0x200))
    table = np.zeros((256, 2), np.uint8)
    for b in range(256):
        follows = chr(next(others)) if b not in own - {0x0A} else ""
        letter = (chr(b) if b in own else follows).encode()
        table[b, 2 - len(letter) :] = list(letter)
    return table


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A vocabulary file; ``folder`` overrides the installed collection."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _pairs(*kinds: tuple[int, int]) -> np.ndarray:
    """A table of pairs of neighbouring classes, as 16 x first + second."""
    table = np.zeros(256, bool)
    table[[16 * a + b for a, b in kinds]] = True
    return table


_ALNUM, _ASCII_PUNCT = (_DIGIT, _LETTER), (_QUOTE, _PUNCT)
_COMMON = [*((a, b) for a in _ALNUM for b in _ASCII_PUNCT), *((_PUNCT, b) for b in _ALNUM), (_LETTER, _DIGIT), (_DIGIT, _LETTER)]
_SPACED_CUTS = _pairs(*_COMMON, *((a, _SPACE) for a in (*_ALNUM, *_ASCII_PUNCT)))
_WORD_CUTS = _pairs(*_COMMON, (_DIGIT, _DIGIT), *((a, b) for a in range(9) for b in (_SPACE, _NEWLINE)))
#: A character outside ASCII before these needs a look at its bytes.
_AFTER_TAIL = _pairs(*((_TAIL, b) for b in (_SPACE, *_ASCII_PUNCT, _DIGIT)))


def piece_starts(data: np.ndarray, offsets: np.ndarray, spaced: bool, whole: np.ndarray) -> np.ndarray:
    """Where pieces begin, in order.  spaced: of the byte-level pattern; whole: indices of texts that aren't cut."""
    n = len(data)
    kinds = _CLASS_OF[data]
    pair = kinds[:-1] << 4
    pair |= kinds[1:]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = (_SPACED_CUTS if spaced else _WORD_CUTS)[pair]
    at = np.flatnonzero(_AFTER_TAIL[pair]) + 1
    if len(at):
        last, middle, first = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
        letter = (middle == 0xC3) & (last != 0x97) & (last != 0xB7)  # U+00C0 to U+00FF without signs; some others gain a mark in lower case
        blank = (middle == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (first == 0xE1) & ((middle == 0x9A) | (middle == 0xA0)) | (first == 0xE2) & ((middle == 0x80) | (middle == 0x81)) | (first == 0xE3) & (middle == 0x80)
        cut[at] |= np.where(kinds[at] == _SPACE, ~blank, letter)
    if spaced:
        lines = np.flatnonzero(kinds == _NEWLINE)
        lines = lines[(lines > 0) & (lines < n - 1)]
        before, after = kinds[lines - 1], data[lines + 1]
        seen = ((before == _DIGIT) | (before == _LETTER) | (before == _QUOTE) | (before == _PUNCT)) & ((after > 0x20) & (after < 0x7F) | (after >= 0xC3) & (after <= 0xDF) | (after >= 0xE4))
        cut[lines[seen]] = True
        cut[lines[seen] + 1] = True
    for i in whole:
        cut[offsets[i] : offsets[i + 1]] = False
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


class PieceEncoder:
    """Texts to token ids."""

    #: Bytes of pieces and their ids in the cache; beyond it the pieces of the texts at hand stay.
    CACHE_BYTES = 24 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = self._ids(" a") != self._ids("a")
        self.mark, self.around = ("\n", "\n") if self.spaced else ("\x01", " \x01 ")
        (self.mark_id,) = self._ids(self.mark)
        self.letters = _byte_letters()
        number = rb"[0-9]+" if self.spaced else rb"[0-9]"
        self.direct = re.compile(rb" ?(?:(?:[A-Za-z]|" + _LATIN_LETTER + rb")+|" + number + rb"|[!-/:-@\[-`{-~]+)").fullmatch
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = pa.array([], pa.binary())
        self.known_ids = self._lists([], [])

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _lists(self, counts, ids) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.asarray(ids, self.dtype)))

    def _joinable(self, piece: str) -> bool:
        return bool(piece) and not piece[-1].isspace() and not piece[:2].isspace() and self.mark not in piece and not any(x in piece for x in self.special)

    def _encode_direct(self, pieces: list[bytes]) -> pa.ListArray:
        """Ids of pieces that are one pre-token each, by the model alone."""
        joined = b"\n".join(pieces)
        if not self.spaced:
            joined = joined.decode().lower().encode().replace(b" ", b"")
        data = np.frombuffer(joined, np.uint8)
        letters = self.letters[data][self.letters[data] > 0].tobytes().decode()  # two columns of UTF-8
        tokenize, counts, ids = self.tokenizer.model.tokenize, [], []
        for word in letters.split("\n"):
            got = tokenize(word)
            counts.append(len(got))
            ids += [t.id for t in got]
        return self._lists(counts, ids)

    def _encode_others(self, pieces: list[str]) -> pa.ListArray:
        """Ids of any pieces, by the whole tokenizer."""
        made: dict[str, np.ndarray] = {}
        plain = [p for p in pieces if self._joinable(p)]
        for i in range(0, len(plain), _AT_A_TIME):
            part = plain[i : i + _AT_A_TIME]
            ids = np.asarray(self.tokenizer.encode_batch_fast([self.around.join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            if len(ends) == len(part):
                made.update(zip(part, (ids[a:z] for a, z in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)), strict=True))
        got = [made[p] if p in made else np.asarray(self._ids(p), self.dtype) for p in pieces]
        return self._lists([len(x) for x in got], np.concatenate(got))

    def _encode(self, pieces: list[bytes]) -> pa.ListArray:
        straight = [len(p) <= _LONG and self.direct(p) is not None for p in pieces]
        a, b = [p for p, d in zip(pieces, straight, strict=True) if d], [p.decode() for p, d in zip(pieces, straight, strict=True) if not d]
        parts = [*([self._encode_direct(a)] if a else []), *([self._encode_others(b)] if b else [])]
        place = np.cumsum(straight) - 1
        rest = len(a) + np.cumsum(~np.asarray(straight)) - 1
        return pa.concat_arrays(parts).take(pa.array(np.where(straight, place, rest)))

    def _rows(self, pieces: pa.Array) -> tuple[np.ndarray, int]:
        """The place of each of the different pieces in the cache, where missing ones are added, and how many there may stay."""
        at = pc.index_in(pieces, value_set=self.known)
        missing, stay = pieces.filter(pc.is_null(at)), len(self.known)
        if not len(missing):
            return at.to_numpy(), stay
        long = pc.greater(pc.binary_length(missing), _LONG)
        order = pa.concat_arrays([missing.filter(pc.invert(long)), missing.filter(long)])  # long ones last, to be cut off
        stay += len(order) - pc.sum(long).as_py()
        self.known_ids = pa.concat_arrays([self.known_ids, self._encode(order.to_pylist())])
        self.known = pa.concat_arrays([self.known, order])
        rows, added, is_long = at.to_numpy(zero_copy_only=False), len(self.known) - len(order), long.to_numpy(zero_copy_only=False)
        rows[np.isnan(rows)] = added + np.argsort(np.argsort(is_long, kind="stable"), kind="stable")
        return rows.astype(np.int64), stay

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by ``end`` if given, and the bounds of the texts' ids."""
        n = len(offsets) - 1
        starts, got = np.zeros(0, np.int64), self._lists([], [])
        if len(data):
            starts = piece_starts(data, offsets, self.spaced, self._special_texts(data, offsets))
            places = np.append(starts, len(data)).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            rows, stay = self._rows(pieces.dictionary)
            got = self.known_ids.take(pa.array(rows[pieces.indices.to_numpy()]))
            self._trim(rows[rows < stay], stay)
        ids, edges = got.values.to_numpy(), got.offsets.to_numpy().astype(np.int64)
        bounds = edges[np.searchsorted(starts, offsets)]
        if end is not None:
            ids = np.insert(ids, bounds[1:], end)
            bounds = bounds + np.arange(n + 1)
        return ids, bounds

    def _special_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Indices of the texts that hold a special string."""
        raw, found = data.tobytes(), []
        for s in map(str.encode, self.special):
            at = raw.find(s)
            while at >= 0:
                found.append(at)
                at = raw.find(s, at + 1)
        return np.unique(np.searchsorted(offsets, found, "right") - 1).astype(np.int64)

    def _trim(self, used: np.ndarray, stay: int) -> None:
        """Long pieces leave the cache, and when it is full all that the texts at hand don't use."""
        if stay < len(self.known):
            self.known, self.known_ids = self.known.slice(0, stay), self.known_ids.slice(0, stay)
            self.known, self.known_ids = (pa.concat_arrays([x, x.slice(0, 0)]) for x in (self.known, self.known_ids))
        if self.known.nbytes + self.known_ids.nbytes > self.CACHE_BYTES:
            kept = pa.array(np.sort(used))
            self.known, self.known_ids = self.known.take(kept), self.known_ids.take(kept)

    def texts(self, texts: list[str]) -> list[list[int]]:
        """The ids of a few texts."""
        ids, bounds = self.encode(*utf8(pa.array(texts, pa.string())))
        return [ids[a:z].tolist() for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str) -> PieceEncoder:
    """The encoder of this process."""
    return PieceEncoder(path)
