"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidates, exact links.

1. A text becomes its set of 5-word shingles (64-bit hashes). One permutation is cut into 250 bins,
   the smallest hash of each is kept and empty bins borrow from another bin by a fixed probe order
   (optimal densification). 50 bands of 5 bins are bucket keys: two sets of similarity 0.75 miss each
   other with probability 1e-6.
2. Equal sets are one node. In each bucket every node gets one candidate edge, to the bucket's
   smallest node: as many edges as bucket entries, and still all that share a bucket are connected.
3. Candidate components hold every true link. Their members' full sets meet in blocks of bounded size
   (a component of several blocks is compared block by block), where shared shingles are counted
   exactly. A block returns a spanning forest of its true links; their components are the result.

Cases: fewer than five words are one shingle; no words: an empty set, never linked. Null doc_id:
never linked and kept, component null. Rows that share a doc_id are one vertex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import written
from .text import U64, Words, column, distinct, mix, rolling, row_blocks

SHINGLE, BINS, ROWS = 5, 250, 5
#: Sets compared at once, and 64-bit shingles that may meet in one comparison (about 60 MB).
BLOCK_SETS, BLOCK_SHINGLES = 1024, 8_000_000
_EDGES = np.array([-(-(i << 64) // BINS) for i in range(1, BINS)], U64)
_ORDER = np.random.default_rng(20240229)
_PROBES = np.stack([_ORDER.permutation(BINS) for _ in range(BINS)])
_EMPTY = (1 << 64) - 1


def shingle_sets(texts, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes (A-Z lower-cased)."""
    buf, at = column(texts)
    for lo, hi in row_blocks(at, 1 << 21):
        words = Words(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lower=True)
        hashes = rolling(words.code, k)
        for a, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
            if n >= k:
                yield distinct(hashes[a : a + n - k + 1])
            elif n:
                yield mix(np.array([int(mix(words.code[a : a + n] + np.arange(n, dtype=U64)).sum(dtype=U64)) ^ n], U64))
            else:
                yield np.zeros(0, U64)


def bands(shingles: np.ndarray) -> np.ndarray:
    """Bucket keys of a set: one-permutation minima, densified, five to a band."""
    cut = np.concatenate(([0], np.searchsorted(shingles, _EDGES), [len(shingles)]))
    full = cut[1:] > cut[:-1]
    low = np.zeros(BINS, U64)
    low[full] = shingles[cut[:-1][full]]
    empty = np.flatnonzero(~full)
    for depth in (8, BINS):
        if len(empty):
            seen = full[_PROBES[empty, :depth]]
            hit = seen.any(axis=1)
            donor = _PROBES[empty[hit], seen[hit].argmax(axis=1)]
            low[empty[hit]] = low[donor]
            empty = empty[~hit]
    key = np.arange(BINS // ROWS, dtype=U64)
    for r in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + low[r::ROWS])
    return key


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, one, two, keys = [], [], [], []
        for s in shingle_sets(batch["text"]):
            n.append(len(s))
            one.append(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)))
            two.append(int(mix(s + U64(0x14057B7EF767814F)).sum(dtype=U64)))
            keys.append(bands(s).view(np.int64) if len(s) else None)
        yield pa.RecordBatch.from_arrays([
            batch["doc_id"], pa.array(n, pa.int64()), pa.array(np.array(one, U64).view(np.int64)), pa.array(np.array(two, U64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())),
        ], ["doc_id", "n_shingles", "s1", "s2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([s.tobytes() for s in shingle_sets(batch["text"])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["node"], batch["candidate"], batch["blocks"], sets], ["node", "candidate", "blocks", "shingles"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, exactly: rare shingles by pairs, frequent ones by matrix products."""
    m = len(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, who = values[order], who[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    size = np.diff(np.append(first, len(values)))
    out = np.zeros((m, m), np.int32)
    for k in range(2, 5):
        rows = who[first[size == k][:, None] + np.arange(k)]
        for i in range(k):
            for j in range(i + 1, k):
                out += np.bincount(rows[:, i] * m + rows[:, j], minlength=m * m).reshape(m, m).astype(np.int32)
    common = np.flatnonzero(size > 4)
    for lo in range(0, len(common), 2048):
        own = common[lo : lo + 2048]
        has = np.zeros((m, len(own)), np.float32)
        col = np.repeat(np.arange(len(own)), size[own])
        at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(size[own])[:-1])), size[own]) + np.arange(size[own].sum())
        has[who[at], col] = 1
        out += np.triu(has @ has.T, 1).astype(np.int32)
    return out + out.T


def forest(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges from each node to the smallest node that its true links reach in this block."""
    size = np.array([len(s) for s in sets], np.int64)
    both = shared_counts(sets).astype(np.int64)
    a, b = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
    label = np.arange(len(sets))
    rank = np.argsort(nodes, kind="stable")
    place = np.empty_like(rank)
    place[rank] = np.arange(len(rank))
    label = place.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = np.minimum(label, label[rank[label]])
        if (label == before).all():
            break
    return [(int(nodes[i]), int(nodes[rank[label[i]]])) for i in range(len(nodes)) if rank[label[i]] != i]


def near_duplicates(docs: DataFrame, percent: int = 75, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = written(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "sketch")
    same = ["n_shingles", "s1", "s2"]
    linked = sketch.where("n_shingles > 0 and doc_id is not null")
    nodes = written(linked.groupBy(*same).agg(F.min("doc_id").alias("node"), F.min("bands").alias("bands")), "nodes")
    entries = nodes.select("node", F.explode("bands").alias("key"))
    hubs = entries.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
    stars = entries.join(hubs, "key").where("node > hub").select("node", "hub").distinct()
    rough = components(stars, "node", "hub")

    links = _true_links(docs, rough, nodes, percent, block_sets, block_shingles)
    found = components(links.union(_shared_ids(linked, nodes, same)), "a", "b")
    owners = nodes.join(found, "node", "left").select(*same, F.coalesce("component", "node").alias("component"))
    component = F.coalesce("component", "doc_id")
    rows = sketch.drop("bands").join(owners, same, "left")  # a set's copies are one row in `owners`
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _true_links(docs: DataFrame, rough: DataFrame, nodes: DataFrame, percent: int, block_sets: int, block_shingles: int) -> DataFrame:
    """Spanning links (a, b) of the candidate components; all texts of a component meet, block by block."""
    members = rough.join(nodes.groupBy("node").agg(F.sum("n_shingles").alias("n")), "node")
    blocks = F.greatest(F.ceil(2 * F.count("*") / block_sets), F.ceil(2 * F.sum("n") / block_shingles), F.lit(2))
    sizes = members.groupBy("component").agg(F.when((F.count("*") <= block_sets) & (F.sum("n") <= block_shingles), 1).otherwise(blocks).cast("int").alias("blocks"))
    spread = members.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("candidate"), "blocks")
    sets = docs.join(spread, "doc_id").select(F.col("doc_id").alias("node"), "candidate", "blocks", "text").mapInArrow(
        _sets, "node long, candidate long, blocks int, shingles binary")
    own = sets.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).where("blocks = 1 or own != other").select(
        "node", "shingles", "candidate", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(table: pa.Table) -> pa.Table:
        found = forest(table["node"].to_numpy(), [np.frombuffer(x.as_buffer(), U64) for x in table["shingles"]], percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return met.groupBy("candidate", "lo", "hi").applyInArrow(compare, "a long, b long")


def _shared_ids(linked: DataFrame, nodes: DataFrame, same: list[str]) -> DataFrame:
    """Links between the nodes of rows that share a doc_id but not the set."""
    sets = F.struct(*same)
    several = linked.groupBy("doc_id").agg(F.min(sets).alias("x"), F.max(sets).alias("z")).where("x != z").select("doc_id")
    pairs = linked.join(several, "doc_id").select("doc_id", *same).distinct().join(nodes.drop("bands"), same)
    return pairs.join(pairs.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, with one row for each group; rows without doc_id or words all stay."""
    ids = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept_id")).distinct()
    kept = docs.join(ids, docs["doc_id"].cast("long") == F.col("__kept_id"), "left_semi")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))  # rows that share a doc_id are one vertex
    first = kept.withColumn("__turn", turn).where("__turn = 1").drop("__turn")
    return first.unionByName(docs.where("doc_id is null"))
