"""Ranked lexical search: item bundles go through the owners of their terms and gather integer scores.

1. One pass counts every document's terms (maximal runs of ASCII letters and digits and of all beyond
   ASCII, A-Z lower-cased). Only terms that a query item may hold are kept, by a bit map of fixed
   size; a join with the items' terms makes that exact. The result is a compact table of documents:
   length and the counts of its query terms. Corpus figures and document frequencies come from it.
2. Terms belong to owners by weight, the rarest first. Documents are dealt into shards and items into
   blocks. A bundle is one item in one shard; it carries the documents met so far with their scores.
3. In each owner's stage bundles meet the owner's postings by (shard, block) in a cogroup, add the
   contributions of the item's terms and move on. A stage drops documents which can't be among the
   shard's `top` any more, as even the most the later owners can add leaves them below documents that
   are there already; equal ones stay, so the result is exact.
4. The last stage leaves each shard's best documents; a window with a limit in every task ranks them.

A group is one shard of documents and one block of items, so its size doesn't grow with the corpus. A
term of every document is spread over all shards.

Cases: null texts have no terms and aren't counted; a document without terms has no score. Rows that
share a doc_id are documents of their own. Documents with a null doc_id come after others of equal
score. Items that share an item_id (or have none) are one item with the terms of all; an item without
a known term has no rows. Empty tables give no rows. Other columns are left out. doc_ids and
item_ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts, written
from .text import LOWER, U64, Words, column, row_blocks

TOP, OWNERS, MAP_BITS = 10, 4, 25
#: Documents of a shard, and items of a block.
SHARD, ITEMS = 2048, 256
TERM = np.zeros(256, np.uint8)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: A document without an id sorts last; its row number is kept complemented, which is negative.
_LAST = np.iinfo(np.int64).max


def _strings(words: Words, which: np.ndarray) -> pa.Array:
    """The lower-cased words at these places, as an Arrow column."""
    size = words.end[which] - words.start[which]
    ends = np.cumsum(size)
    at = np.repeat(words.start[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(LOWER[words.buf[at]])).cast(pa.string())


def _counted(words: Words, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, counts and one place of each distinct (row, term) of the words `among`, by rows."""
    row, code = words.row()[among], words.code[among]
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else np.zeros(0, np.int64)
    return row[first], np.diff(np.append(first, len(row))), among[order[first]]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = Words(*column(b["text"]), lower=True, classes=TERM)
        row, _, where = _counted(words, np.arange(len(words.code)))
        yield pa.RecordBatch.from_arrays([b["item_id"].take(pa.array(row)), _strings(words, where), pa.array(words.code[where].view(np.int64))], ["item_id", "term", "code"])


def _doc_terms(bits: np.ndarray):
    top = U64(64 - MAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = column(b["text"])
            for lo, hi in row_blocks(at, 1 << 21):
                words = Words(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lower=True, classes=TERM)
                place = (words.code >> top).astype(np.int64)
                row, count, where = _counted(words, np.flatnonzero((bits[place >> 6] >> (place & 63).astype(U64)) & U64(1)))
                cut = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
                names, number = np.unique(words.code[where], return_index=True, return_inverse=True)[1:]
                terms = _strings(words, where[names]).take(pa.array(number))
                yield pa.RecordBatch.from_arrays([
                    b["doc_id"].slice(lo, hi - lo), pa.array(words.count), pa.ListArray.from_arrays(cut, terms), pa.ListArray.from_arrays(cut, pa.array(count)),
                ], ["doc_id", "n", "terms", "counts"])

    return run


def _bit_map(terms: DataFrame) -> np.ndarray:
    place = F.shiftrightunsigned("code", 64 - MAP_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(code, {64 - MAP_BITS}) & 63 as int))")
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in terms.select(F.shiftright(place, 6).alias("w"), bit.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bit")).toLocalIterator():  # at most 2**(MAP_BITS - 6) rows
        bits[r["w"]] = r["bit"]
    return bits.view(U64)


class Bundles:
    """The items of one block in one shard: sparse scores of documents, and the terms still to come."""

    def __init__(self, table: pa.Table):
        self.items = table["item_id"]
        self.terms = [np.frombuffer(x, "<i8").reshape(-1, 3) for x in table["terms"].to_pylist()]  # term, owner, weight
        self.rows, self.ids, self.scores = ([np.frombuffer(x, "<i8") for x in table[c].to_pylist()] for c in ("rows", "ids", "scores"))

    def add(self, owner: int, postings: pa.Table, top: int) -> None:
        """Add the owner's contributions; drop documents that can't be among the best `top` of the shard."""
        term, row, key, tf, m = (postings[c].to_numpy() for c in ("term", "row", "id", "tf", "m"))
        known = [np.empty(0, np.int64), row, *self.rows]
        every, first = np.unique(np.concatenate(known), return_index=True)
        ids = np.concatenate([np.empty(0, np.int64), key, *self.ids])[first]
        at = np.searchsorted(every, row)
        order = np.argsort(term, kind="stable")
        sorted_terms = term[order]
        share = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
        for i, terms in enumerate(self.terms):
            score = np.zeros(len(every), np.int64)
            score[np.searchsorted(every, self.rows[i])] = self.scores[i]
            for t, _, w in terms[terms[:, 1] == owner].tolist():
                own = order[slice(*np.searchsorted(sorted_terms, [t, t + 1]).tolist())]
                score[at[own]] += w * share[own]
            live = np.flatnonzero(score)
            ahead = 1_000_000 * int(terms[terms[:, 1] > owner, 2].sum())  # a share is less than 1,000,000
            if len(live) > top:
                least = np.partition(score[live], -top)[-top]
                live = live[score[live] + ahead >= least]
                if not ahead and len(live) > top:  # no owner follows: the ids decide between equal scores
                    live = live[np.lexsort((every[live], ids[live], -score[live]))[:top]]
            self.rows[i], self.ids[i], self.scores[i] = every[live], ids[live], score[live]

    def table(self, shard: int, block: int) -> pa.Table:
        raw = [pa.array([x.astype("<i8").tobytes() for x in c], pa.binary()) for c in (self.terms, self.rows, self.ids, self.scores)]
        n = len(self.terms)
        return pa.table([pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), self.items, *raw], names=["shard", "block", "item_id", "terms", "rows", "ids", "scores"])


BUNDLE = "shard int, block int, item_id long, terms binary, rows binary, ids binary, scores binary"


def _stage(owner: int, top: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        bundles = Bundles(left)
        bundles.add(owner, right, top)
        return bundles.table(key[0].as_py(), key[1].as_py())

    return run


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, ids, scores = ([np.frombuffer(x, "<i8") for x in b[c].to_pylist()] for c in ("rows", "ids", "scores"))
        item = b["item_id"].take(pa.array(np.repeat(np.arange(len(rows)), [len(x) for x in rows])))
        row, key, score = (np.concatenate([np.empty(0, np.int64), *x]) for x in (rows, ids, scores))
        yield pa.RecordBatch.from_arrays([item, pa.array(row), pa.array(key, pa.int64(), mask=row < 0), pa.array(score)], ["item_id", "row", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, top: int = TOP, owners: int = OWNERS, shard: int = SHARD, item_block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best `top` of (doc_id, text) for each of (item_id, text)."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, term string, code long")
    asked = written(asked.distinct(), "item-terms")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_doc_terms(_bit_map(asked)), "doc_id long, n long, terms array<string>, counts array<long>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "doc-terms")
    figures = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.count("*").alias("rows")).first()
    if not figures["docs"]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    # terms: number, weight and owner; the weights' range is cut evenly, so that the rarest terms come first
    named = asked.groupBy("term").agg(F.min("code").alias("code"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * figures["docs"] + 2) / (2 * F.col("df") + 1)))
    highest = 1000 * np.log((2.0 * figures["docs"] + 2) / 3) + 1
    owner = F.greatest(F.lit(0), F.least(F.lit(owners - 1), F.floor((highest - F.col("w")) * owners / highest))).cast("int")
    counted = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms = counted.join(named, "term").withColumn("w", weight).where("w > 0").withColumn("owner", owner)
    terms = written(terms.select("term", F.monotonically_increasing_id().alias("number"), "w", "owner"), "terms")

    blocks = parts(asked.select("item_id").distinct().count(), item_block)
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    own = asked.join(terms, "term").select("item_id", block.alias("block"), "number", "owner", "w")
    shards = parts(figures["rows"], shard)

    def pack(table: pa.Table) -> pa.Table:
        raw = np.stack([table[c].to_numpy().astype("<i8") for c in ("number", "owner", "w")], 1)
        return pa.table([table["item_id"].slice(0, 1), table["block"].slice(0, 1), pa.array([raw.tobytes()], pa.binary())], names=["item_id", "block", "terms"])

    packed = own.groupBy("item_id", "block").applyInArrow(pack, "item_id long, block int, terms binary")
    none = F.lit(b"").alias
    bundles = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "item_id", "terms", none("rows"), none("ids"), none("scores"))

    length = F.expr(f"10 + (90L * n * {figures['docs']}L) div {figures['words']}L")
    doc = found.where("n > 0").select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.when(F.col("doc_id").isNull(), -1 - F.col("row")).otherwise(F.col("row")).alias("row"),
        F.coalesce("doc_id", F.lit(int(_LAST))).alias("id"), length.alias("m"), F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    posting = doc.select("shard", "row", "id", "m", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"))
    where = own.select("number", "block").distinct().join(terms, "number").select("term", F.col("number").alias("wanted"), "block", "owner")
    postings = written(posting.join(where, "term").select("shard", "block", "owner", F.col("wanted").alias("term"), "row", "id", "tf", "m"), "postings")

    for k in range(owners):
        owned = postings.where(F.col("owner") == k).drop("owner")
        bundles = bundles.groupBy("shard", "block").cogroup(owned.groupBy("shard", "block")).applyInArrow(_stage(k, top), BUNDLE)
    best = bundles.mapInArrow(_survivors, "item_id long, row long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
