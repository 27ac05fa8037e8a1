"""Substring dedup: word windows that occur more than once are cut out of every text.

Method: texts are dealt into groups of bounded size. Each group computes the Rabin-Karp hash of
every window of `window` words and sends every distinct hash once, packed by hash bucket, so a
window of a million copies costs one hash per group and no bucket is hotter than another. A
bucket counts each hash over all groups and answers with those that repeat. Each group then
computes its hashes again, marks windows that repeat inside it or elsewhere, and merges them
into maximal removal intervals.

Windows are compared by 64-bit hashes: n windows give about n*n/2**65 false repeats (2e-4 for 10**8).

Cases: null or empty texts and texts shorter than the window have no interval. Rows with the same
doc_id are separate documents. Other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import group_of, parts, text_bytes
from .text import U64, Words, column, distinct, rolling, row_blocks

WINDOW = 35
#: Bytes of text in a group, and bytes of hashes in a bucket.
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
_BLOCK = 1 << 21


def _hashes(texts, window: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    buf, at = column(texts)
    for lo, hi in row_blocks(at, _BLOCK):
        words = Words(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        starts = words.whole_windows(window)
        yield words, starts, rolling(words.code, window)[starts] if len(starts) else np.zeros(0, U64)


def _distinct(table: pa.Table, window: int, buckets: int) -> pa.Table:
    """A group's distinct window hashes, one binary for each bucket."""
    found = [h for _, _, h in _hashes(table["text"], window)]
    h = distinct(np.concatenate(found)) if found else np.zeros(0, U64)
    cut = np.searchsorted(h, _edges(buckets))
    full = np.flatnonzero(np.diff(cut))
    grp = table["grp"][0].as_py()
    return pa.table({
        "grp": pa.array([grp] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()),
        "hashes": pa.array([h[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()),
    })


def _edges(buckets: int) -> np.ndarray:
    """Limits of equal ranges of hash values (the last range is closed by the highest value)."""
    return np.array([*((i << 64) // buckets for i in range(buckets)), (1 << 64) - 1], U64)


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket, each group's hashes that another group has as well."""
    grps, lists = table["grp"].to_pylist(), [np.frombuffer(x.as_buffer(), U64) for x in table["hashes"]]
    h = np.sort(np.concatenate(lists))
    twice = distinct(h[1:][h[1:] == h[:-1]])
    out = []
    for g, own in zip(grps, lists, strict=True):
        if len(twice) and len(both := own[_among(own, twice)]):
            out.append((g, both.tobytes()))
    return pa.table({"grp": pa.array([g for g, _ in out], pa.int32()), "hashes": pa.array([b for _, b in out], pa.binary())})


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _intervals(docs: pa.Table, repeats: pa.Table, window: int, with_text: bool) -> pa.Table:
    known = np.sort(np.concatenate([np.zeros(0, U64), *(np.frombuffer(x.as_buffer(), U64) for x in repeats["hashes"])]))
    blocks = list(_hashes(docs["text"], window)) if docs.num_rows else []
    own = np.sort(np.concatenate([np.zeros(0, U64), *(h for _, _, h in blocks)]))
    known = distinct(np.concatenate((known, own[1:][own[1:] == own[:-1]])))
    n_words, n_removed, spans, digests, texts = [], [], [], [], []
    for words, starts, h in blocks:
        edge = np.zeros(len(words.start) + 1, np.int32)
        hit = starts[_among(h, known)]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        raw = words.buf.tobytes()
        for r in range(len(words.count)):
            a, b = int(words.first[r]), int(words.first[r + 1])
            cut = gone[a:b]
            turn = np.flatnonzero(np.diff(np.concatenate(([0], cut.view(np.int8), [0]))))
            s, e = words.start[a:b][~cut].tolist(), words.end[a:b][~cut].tolist()
            kept = b" ".join([raw[i:j] for i, j in zip(s, e, strict=True)])
            n_words.append(b - a)
            n_removed.append(int(cut.sum()))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if with_text else None)
    return pa.table({
        "doc_id": docs["doc_id"] if docs.num_rows else pa.array([], pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
        "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(texts, pa.string()),
    })


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, removed (word intervals [start, end)), kept_sha256, kept_text (null unless asked for)."""
    total = text_bytes(docs)
    groups, buckets = parts(total, group_bytes, 8), parts(2 * total, bucket_bytes, 8)
    dealt = docs.select("doc_id", "text", group_of(groups, F.col("doc_id"), F.col("text")).alias("grp"))

    # Grouped functions live here so that they carry their parameters.
    def own_hashes(table: pa.Table) -> pa.Table:
        return _distinct(table, window, buckets)

    def intervals(left: pa.Table, right: pa.Table) -> pa.Table:
        return _intervals(left, right, window, with_text)

    repeats = (
        dealt.groupBy("grp").applyInArrow(own_hashes, "grp int, bucket int, hashes binary")
        .groupBy("bucket").applyInArrow(_repeated, "grp int, hashes binary")
    )
    return dealt.groupBy("grp").cogroup(repeats.groupBy("grp")).applyInArrow(
        intervals, "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_sha256 string, kept_text string"
    )
