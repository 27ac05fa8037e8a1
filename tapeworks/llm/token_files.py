"""Token ids on disk: entropy-coded segments in ascending doc_id order, written and read by Spark.

Documents are range-partitioned and sorted by doc_id; a task encodes them and closes a segment
of whole documents every `segment` ids. A segment is one row of a Parquet file: the documents'
ids and lengths, one frequency table and independent blocks with checkpoints and checksums (see
`rans`). Spark's commit protocol makes the files whole after lost executors, on any file system.

Cases: a null or empty text is its end id alone. Rows that share a doc_id stay rows of their own, in
order of their text; null doc_ids come first. Other columns are left out. An empty table makes
files without segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rans
from .shared import parts, text_bytes
from .tokens import default_path, encoder

END, SEGMENT, PART_BYTES = 0, 1 << 20, 16 << 20
SEGMENTS = "part int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, freqs binary, blocks array<binary>"
_ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int64())), ("freqs", pa.binary()), ("blocks", pa.list_(pa.binary())),
])


def _segment(part: int, number: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
    all_ids = np.frombuffer(b"".join(ids), "<u4")
    freqs, blocks = rans.encode(all_ids)
    row = [part, number, len(all_ids), doc_ids, [len(x) // 4 for x in ids], freqs, blocks]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)


def write(docs: DataFrame, folder: str, end: int = END, path: str | None = None, segment: int = SEGMENT, part_bytes: int = PART_BYTES) -> None:
    """Write the token ids of all texts, each followed by `end`, to `folder`."""
    path, tail = path or default_path(), np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, doc_ids, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            for d, x in zip(b["doc_id"].to_pylist(), encoder(path).rows(b["text"]), strict=True):
                doc_ids.append(d)
                ids.append(x + tail)
                size += len(ids[-1]) // 4
                if size >= segment:
                    yield _segment(part, number, doc_ids, ids)
                    number, doc_ids, ids, size = number + 1, [], [], 0
        if ids:
            yield _segment(part, number, doc_ids, ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(parts(text_bytes(docs), part_bytes, 8), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(folder)


def read(spark, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian 32-bit; null unless asked for) of every document."""
    files = spark.read.schema(SEGMENTS).parquet(folder)
    sizes = files.select("part", "segment", "n_ids")
    by_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each file
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = sizes.select("part", "segment", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("within"))
    starts = within.join(before, "part").select("part", "segment", (F.col("before") + F.col("within")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = rans.decode(b["freqs"][i].as_py(), b["blocks"][i].as_py()).astype("<u4").tobytes()
                length = b["lengths"].slice(i, 1).flatten().to_numpy()
                ends = np.cumsum(length)
                own = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
                k = len(length)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b["part"][i].as_py()] * k, pa.int32()), pa.array([b["segment"][i].as_py()] * k, pa.int32()), b["doc_ids"].slice(i, 1).flatten(), pa.array(ends - length),
                    pa.array(length), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own if with_ids else [None] * k, pa.binary()),
                ], ["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    found = files.select("part", "segment", "doc_ids", "lengths", "freqs", "blocks").mapInArrow(run, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    out = found if with_ids else found.drop("ids")
    return out.join(starts, ["part", "segment"]).withColumn("start", F.col("first") + F.col("at")).select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
