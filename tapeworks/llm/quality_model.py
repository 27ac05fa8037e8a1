"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal.

Tokens are runs of letters and digits or of other marks; a token equal to the one before it becomes
one fixed token, so that repetition is a feature of its own. Features are hashed tokens and pairs of
tokens with value sqrt(count / total), a unit vector; a score is one sparse dot product.

The model is fitted in one task on at most `sample` labelled documents, those of the smallest hashed
doc_ids: a stated bound. Every document is scored, over its whole text.

Cases: null and empty texts have no feature and score the bias alone. Null labels are ignored;
several labels of one document are averaged; a repeated labelled row counts once. Null doc_id: never
labelled, held_out false. No labels at all: every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import U64, Words, column, mix, row_blocks

BITS, SAMPLE, EPOCHS = 20, 12_000, 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.0005
THRESHOLD = 0.3
_KINDS = np.full(256, 2, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_SAME = U64(0x51ED270B9F2C8E5D)


def features(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's feature numbers and values."""
    buf, at = column(texts)
    for lo, hi in row_blocks(at, 1 << 21):
        tokens = Words(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], classes=_KINDS)
        code = tokens.code
        code[1:][code[1:] == code[:-1]] = _SAME
        code[tokens.first[:-1][tokens.count > 0]] ^= U64(1)  # a text's first token is no repetition
        pair = mix(code[1:] * U64(0x9E3779B97F4A7C15) + code[:-1])
        shift = U64(64 - BITS)
        one, two = (mix(code) >> shift).astype(np.int32), (pair >> shift).astype(np.int32)
        for a, n in zip(tokens.first[:-1].tolist(), tokens.count.tolist(), strict=True):
            at_, count = np.unique(np.concatenate((one[a : a + n], two[a : a + max(n - 1, 0)])), return_counts=True)
            yield at_, np.sqrt(count / max(1, 2 * n - 1))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights, the bias last; rows are taken in the given order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(epochs):
        for (i, x), y in zip(rows, labels, strict=True):
            i, x = np.append(i, bias), np.append(x, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(bias + 1)).astype(np.float32)


def _train(table: pa.Table) -> pa.Table:
    order = np.argsort(table["turn"].to_numpy(), kind="stable")
    labels = table["label"].to_numpy()[order].astype(float)
    w = fit([r for r in features(table["text"].take(pa.array(order)))], labels)
    return pa.table({"w": pa.array([w.tobytes()], pa.binary())})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights (4 MB) fitted to `labels[target]`, without the held-out ids."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("int").alias("label"))
    chosen = known.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn").limit(sample)
    rows = (  # `chosen` has at most `sample` rows of three numbers
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "turn").agg(F.min("text").alias("text"))
    )
    found = rows.select("label", "turn", "text").groupBy(F.lit(0).alias("all")).applyInArrow(_without_key, "w binary").first()
    return np.frombuffer(found["w"], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def _without_key(table: pa.Table) -> pa.Table:
    return _train(table.select(["label", "turn", "text"]))


def scores(texts, w: np.ndarray) -> np.ndarray:
    margin = np.array([float(w[i] @ x) for i, x in features(texts)]) + float(w[-1])
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def score(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = scores(b["text"], w) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(p, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, w: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that score `threshold` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(scores(b["text"], w) >= threshold))

    return docs.mapInArrow(run, docs.schema)
