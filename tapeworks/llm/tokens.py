"""Token ids of whole texts by the tokenizers library, inside tasks.

A byte-level pre-tokenizer never joins a mark with white space after it, nor a letter with what is no
letter, so a text may be cut there and the pieces encoded apart. A worker keeps the ids of pieces it has met, by a 64-bit code
of their bytes; what is new in a block is joined to a few strings for the library, and cut again by the
byte lengths of the tokens. (A cut after one of Unicode's other spaces isn't made, as white space goes
together.)
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .text import SPACE, U64, Words, column, row_blocks, span_codes

#: Pieces that a worker keeps, bytes of text handled at once, and bytes of a string for the library.
KEEP, BLOCK, STRING = 1_000_000, 1 << 21, 1 << 15


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = ~_LETTER & ~SPACE & (np.arange(256) < 128)
_WIDE_SPACE = re.compile(rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)$")


def pieces(buf: np.ndarray, at: np.ndarray, whole: list[bytes] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of some rows: cuts before white space and after an ASCII letter that no letter follows, none inside the strings `whole`."""
    cut = np.zeros(len(buf) + 1, bool)
    ends = Words(buf, at, codes=False).end
    a, b, c = (np.where(ends >= k, buf[np.maximum(ends - k, 0)], 0) for k in (1, 2, 3))
    wide = (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE3) & (b == 0x80) & (a == 0x80)
    wide |= (c == 0xE2) & ((b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF)) | (b == 0x81) & (a == 0x9F))
    cut[ends[~wide]] = True
    cut[1:-1] |= _LETTER[buf[:-1]] & _MARK[buf[1:]]
    for string in whole:
        raw = buf.tobytes()
        found = raw.find(string)
        while found >= 0:
            cut[found + 1 : found + len(string)] = False
            found = raw.find(string, found + 1)
    cut[at] = True
    starts = np.flatnonzero(cut[:-1])
    return starts, np.append(starts[1:], len(buf))[: len(starts)]


class Encoder:
    """Little-endian unsigned 32-bit ids of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of a byte-level token each character is a byte
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.added = [t["content"].encode() for t in file.get("added_tokens", [])]
        self.splits = file.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self._start(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _start(self, codes: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """The store: sorted codes, and for each the place and number of its ids."""
        self.codes, self.count, self.place, self.ids, self.used = codes, count, np.cumsum(count) - count, ids, len(ids)

    def _find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where codes are or would be, and whether they are there."""
        at = np.searchsorted(self.codes, codes)
        return at, self.codes[np.minimum(at, len(self.codes) - 1)] == codes if len(self.codes) else np.zeros(len(codes), bool)

    def _forget(self, needed: np.ndarray) -> None:
        """Drop all pieces but the known ones among `needed`, which are the common ones."""
        at, hit = self._find(needed)
        at = at[hit]
        self._start(self.codes[at], self.count[at], self._gather(self.place[at], self.count[at]))

    def _gather(self, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        ends = np.cumsum(count)
        return self.ids[np.repeat(place - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]

    def _keep(self, codes: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(self.used + len(ids), np.uint32)))
        self.ids[self.used : self.used + len(ids)] = ids
        place = self.used + np.cumsum(count) - count
        self.used += len(ids)
        codes = np.concatenate((self.codes, codes))
        order = np.argsort(codes, kind="stable")  # runs that are sorted already are merged
        self.codes, self.count, self.place = codes[order], np.concatenate((self.count, count))[order], np.concatenate((self.place, place))[order]

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, codes: np.ndarray, texts: list[bytes]) -> None:
        whole = [t[0] < 33 and SPACE[t[0]] and not SPACE[t[-1]] and (t[-1] < 128 or not _WIDE_SPACE.search(t)) for t in texts] if self.splits else [False] * len(texts)
        joined, alone = [i for i, w in enumerate(whole) if w], [i for i, w in enumerate(whole) if not w]
        strings, lo, size = [], 0, 0
        for n, i in enumerate(joined):
            size += len(texts[i])
            if size > STRING or n + 1 == len(joined):
                strings.append(joined[lo : n + 1])
                lo, size = n + 1, 0
        order, ids, counts = [], [], []
        for group, found in zip(strings, self._encode([b"".join(texts[i] for i in g) for g in strings]), strict=True):
            reach, ends = np.cumsum(self.width[found]), np.cumsum([len(texts[i]) for i in group])
            last = np.searchsorted(reach, ends)
            if len(found) and last[-1] == len(found) - 1 and (reach[last] == ends).all():
                order += group
                ids.append(found)
                counts.append(np.diff(last, prepend=-1))
            else:
                alone += group
        for lo in range(0, len(alone), 4096):
            some = self._encode([texts[i] for i in alone[lo : lo + 4096]])
            order += alone[lo : lo + 4096]
            ids += some
            counts.append(np.array([len(x) for x in some]))
        self._keep(codes[order], np.concatenate(ids), np.concatenate(counts))

    def rows(self, texts) -> Iterator[bytes]:
        """Ids of each text of an Arrow column, as bytes; null is empty."""
        buf, at = column(texts)
        for lo, hi in row_blocks(at, BLOCK):
            yield from self._block(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])

    def _block(self, buf: np.ndarray, at: np.ndarray) -> list[bytes]:
        if not len(buf):
            return [b""] * (len(at) - 1)
        start, end = pieces(buf, at, self.added) if self.splits else (np.unique(at[:-1][at[:-1] < at[1:]]), np.unique(at[1:][at[:-1] < at[1:]]))
        codes, first, where = np.unique(span_codes(buf, start, end), return_index=True, return_inverse=True)
        if len(self.codes) > KEEP:
            self._forget(codes)
        new = np.flatnonzero(~self._find(codes)[1])
        if len(new):
            raw = buf.tobytes()
            self._learn(codes[new], [raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        slot = self._find(codes)[0][where]
        place, count = self.place[slot], self.count[slot]
        reach = np.concatenate(([0], np.cumsum(count)))
        ids = self._gather(place, count).astype("<u4").tobytes()
        cut = (4 * reach[np.searchsorted(start, at)]).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)
