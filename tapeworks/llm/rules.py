"""Quality rules, line first: lines that fail a rule go, then documents that lose too much go.

Base figures follow the usual repetition rules. The verdict of the method: a line fails if it
* punctuation: has more than one mark of PUNCTUATION for every two words, or ends an unfinished
  sentence (more than `long_line` words, no closing mark);
* navigation: has three or more separators and no closing mark, or is a bare menu entry of at most
  three words of which none ends a sentence or clause;
* boilerplate: matches a licence, rights, cookie or account phrase, or repeats an earlier line.
The failing lines are removed; the document is kept if the lines left hold at least `keep_share` of
its words and it passed the base rules. Blank lines hold no words and never fail.

Cases: null and empty texts have zero words and fail the base rules. Each row is judged by itself, so
repeated rows, ids and other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import SPACE, Words, column, rolling, row_blocks

MIN_WORDS, REPEAT_PERCENT = 50, 50
KEEP_SHARE, LONG_LINE = 0.6, 60
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = SYMBOLS + b"!?=~^_{}[]\\"
SEPARATORS = b"|>/"
CLOSING = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", "”".encode(), "»".encode(), "…".encode())
BOILERPLATE = re.compile(
    rb"all rights reserved|licen[sc]ed under|creative commons|general public license|cookie|privacy policy|terms of (?:use|service)"
    rb"|subscribe to|sign (?:in|up)|log ?in\b|javascript|lorem ipsum|copyright|powered by|click here|read more", re.I)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def failing(line: bytes, n: int, long_line: int = LONG_LINE) -> str | None:
    """The rule that a line of n > 0 words fails."""
    closed = line.rstrip().endswith(CLOSING)
    if 2 * (len(line) - len(line.translate(None, PUNCTUATION))) > n:
        return "punctuation"
    if not closed:
        if n > long_line:
            return "punctuation"
        if len(line) - len(line.translate(None, SEPARATORS)) >= 3 or n <= 3 and b"," not in line:
            return "navigation"
    if n <= 40 and BOILERPLATE.search(line):
        return "boilerplate"
    return None


def _repeat_words(h: np.ndarray, n: int) -> int:
    """Words in 3-word windows (hashes h) that are found twice or more."""
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = np.diff(h[order].view(np.int64)) == 0
    if not same.any():
        return 0
    hit = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[hit + k] = True
    return int(mark.sum())


def judge(texts, keep_share: float = KEEP_SHARE, with_text: bool = False) -> Iterator[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines removed, text left."""
    buf, at = column(texts)
    for lo, hi in row_blocks(at, 1 << 21):
        part, own = buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        words = Words(part, own)
        chars = np.concatenate(([0], np.cumsum(~SPACE[part] & ((part & 0xC0) != 0x80))))[own]
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[part])))[own]
        h, raw = rolling(words.code, 3), part.tobytes()
        for r, n in enumerate(words.count.tolist()):
            a = int(words.first[r])
            repeat = _repeat_words(h[a : a + n - 2], n) if n > 2 else 0
            seen, dup, lost, left, removed = set(), 0, 0, [], 0
            for line in raw[own[r] : own[r + 1]].split(b"\n"):
                k = len(line.split())
                if k:
                    again = line in seen
                    seen.add(line)
                    dup += again
                    if again or failing(line, k):
                        lost += k
                        removed += 1
                        continue
                if with_text:
                    left.append(line)
            failed = n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n
            yield n, int(chars[r + 1] - chars[r]), int(symbols[r + 1] - symbols[r]), dup, repeat, failed, not failed and n - lost >= keep_share * n, removed, b"\n".join(left).decode() if with_text else None


def clean_lines(docs: DataFrame, keep_share: float = KEEP_SHARE, with_text: bool = True) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, n_lines_removed, cleaned text (null unless asked for)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "cleaned"]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(judge(b["text"], keep_share, with_text)) if b.num_rows else []
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(
        f"{n} {'boolean' if t == pa.bool_() else 'string' if t == pa.string() else 'long'}" for n, t in zip(names, types, strict=True)))
