"""Token ids of whole texts by the files of public tokenizers.

Byte-pair merges never cross white space (in byte-level files: never the place before a single
space or around a single line feed), nor the place between a letter or digit and a full stop or
comma that ends a word. So texts are cut there, and each distinct piece is encoded once per
worker; pieces are known by 64-bit hashes. Texts with white space of other kinds are encoded
whole, which gives the same ids.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kerbside.llm import words as W

#: Pieces kept per worker, the first that come; others are encoded for each slice again.
KEPT = 400_000
#: Bytes of a slice, and new pieces that are encoded at once: an encoding is many times its size while it is made.
SLICE, PIECES = 1 << 19, 1 << 12

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
# what stands before a piece: nothing that belongs to it, a space, or a line feed
_BEFORE = ("", " ", "\n")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _other_spaces(data: np.ndarray) -> np.ndarray:
    """Where white space outside ASCII may start, and ASCII separators that only some call
    white space."""
    found = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(data == lead)
        a, b = padded[at + 1], padded[at + 2]
        if lead == 0xC2:
            odd = (a == 0x85) | (a == 0xA0)
        elif lead == 0xE1:
            odd = a == 0x9A
        elif lead == 0xE2:
            odd = (a == 0x80) & ((b <= 0x8A) | (b == 0xA8) | (b == 0xA9) | (b == 0xAF)) | (a == 0x81)
        else:
            odd = a == 0x80
        found.append(at[odd])
    return np.concatenate(found)


class Encoder:
    """Ids without special tokens; strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        # a byte-level file without a normalizer keeps white space in its ids
        self._spaces = self._tokenizer.normalizer is None
        self._keys = np.empty(0, np.uint64)
        self._places = np.empty(0, np.int64)
        self._ids = np.empty(0, np.uint32)
        self._ends = np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.uint32)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and how many each has."""
        ids, sizes = [], []
        for at in range(0, len(pieces), PIECES):
            part = pieces[at : at + PIECES]
            out = self._tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(out.ids, np.uint32))
            sizes.append(np.bincount(np.array(out.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; null is empty."""
        for _, part in W.slices(texts, SLICE):
            yield from self._slice(part)

    def _slice(self, texts: pa.LargeStringArray) -> Iterator[np.ndarray]:
        data, offsets = W.body(texts)
        start, end = W.runs(~_SPACE[data], offsets)
        row = np.searchsorted(offsets[:-1], start, "right") - 1
        plain = np.ones(len(texts), bool)
        plain[np.searchsorted(offsets[:-1], _other_spaces(data), "right") - 1] = False
        before = np.zeros(len(start), np.int64)
        if self._spaces and len(start):
            # between words stands one space or line feed, and nothing before or after
            first = np.concatenate([[True], row[1:] != row[:-1]])
            gap = np.where(first, start - offsets[row], start - np.roll(end, 1))
            mark = data[np.maximum(start, 1) - 1]
            bad = np.where(first, gap != 0, (gap != 1) | ((mark != 0x20) & (mark != 0x0A)))
            last = np.concatenate([first[1:], [True]])
            bad |= last & (end != offsets[row + 1])
            plain[row[bad]] = False
            before = np.where(first, 0, np.where(mark == 0x20, 1, 2))
        if self._spaces:  # texts of white space only
            plain[(np.bincount(row, minlength=len(texts)) == 0) & (np.diff(offsets) > 0)] = False
        keep = plain[row]
        start, end, row, before = start[keep], end[keep], row[keep], before[keep]
        # a full stop or comma after a letter or digit is a piece of its own
        tail = np.flatnonzero((end - start > 1) & _STOP[data[end - 1]] & _ALNUM[data[end - 2]])
        at = end[tail] - 1
        end[tail] -= 1
        order = np.argsort(np.concatenate([start, at]), kind="stable")
        before = np.concatenate([before, np.zeros(len(at), np.int64)])[order]
        row = np.concatenate([row, row[tail]])[order]
        start, end = np.concatenate([start, at])[order], np.concatenate([end, at + 1])[order]

        keys = W.mix(W.span_hashes(data, start, end) + before.astype(np.uint64))
        keys, one, of = np.unique(keys, return_index=True, return_inverse=True)
        found = np.searchsorted(self._keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self._keys):
            known = self._keys[np.minimum(found, len(self._keys) - 1)] == keys
        place = np.empty(len(keys), np.int64)
        place[known] = self._places[found[known]]
        new = np.flatnonzero(~known)
        ends, ids = self._ends, self._ids
        if len(new):
            body = data.tobytes()
            pieces = [
                _BEFORE[b] + body[s:e].decode()
                for s, e, b in zip(start[one[new]].tolist(), end[one[new]].tolist(), before[one[new]].tolist())
            ]
            made, sizes = self._encode(pieces)
            place[new] = len(ends) - 1 + np.arange(len(new))
            ids = np.concatenate([ids, made])
            ends = np.concatenate([ends, ends[-1] + np.cumsum(sizes)])
            if len(self._keys) + len(new) <= KEPT:
                self._keys = np.insert(self._keys, found[new], keys[new])
                self._places = np.insert(self._places, found[new], place[new])
                self._ids, self._ends = ids, ends
        of = place[of]
        first, size = ends[of], ends[of + 1] - ends[of]
        shift = np.repeat(first - (np.cumsum(size) - size), size)
        flat = ids[np.arange(len(shift)) + shift]
        stop = np.cumsum(np.bincount(row, weights=size, minlength=len(texts)).astype(np.int64))
        for i, (a, b) in enumerate(zip([0, *stop[:-1].tolist()], stop.tolist())):
            yield flat[a:b] if plain[i] else self.whole(texts[i].as_py())


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)
