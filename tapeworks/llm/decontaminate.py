"""Benchmark decontamination by template windows.

Words lose their outer punctuation, inner '.' and ',' and case; numbers, names (capitals inside a sentence)
and units (after a number) become typed placeholders. Windows of such tokens of every text are met with
those of the benchmark by a hash join. A window's first token is read as if a sentence began there, so
a template doesn't depend on what stands before it. Every window is met without names and units as well,
only numbers being placeholders, so that a copy in other case or without marks is found. Windows of one text
and item on the same diagonal (text place minus item place) must fill equal slots alike: one value of the
item, one value of the text; otherwise the diagonal doesn't count.

A document is contaminated by an item if windows found in it cover at least `share` of the item's tokens, or
a passage of `run` tokens in a row, counting there only windows with at most half placeholders. Windows have
`window` tokens, in an item of fewer than window / (1 - share) but at least `window` tokens (1 - share) of
them: one changed word then leaves at least `share` covered.

The join is made small beforehand by a bit map of the benchmark's hashes, of a fixed size (4 MB) however
large the benchmark is; what passes it is joined exactly, so the map changes no result.

Cases: null and empty texts or items match nothing; an item with fewer tokens than the window is one
window of its own length. Equal items are compared once and reported under each id's smallest twin and
`items` lists those. Repeated rows and doc_ids are judged by their own text. Empty tables are fine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text import U64, Words, column, mix, powers, row_blocks

WINDOW, SHARE, RUN, MAP_BITS = 8, 0.6, 13, 25
#: Unit words and spelled numbers.
UNITS = {w.encode() for w in (
    "km m cm mm mi mile miles ft feet foot inch inches yard yards kg g mg lb lbs oz ounce ounces pound pounds ton tons ton tonne tonnes l ml litre litres liter liters "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years kmh km/h mph "
    "dollar dollars euro euros cent cents usd eur gbp percent degrees celsius fahrenheit watt watts kw kwh volt volts".split())}  # fmt: skip
NUMBERS = {w.encode() for w in "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()}
_OUTER = b"\"'`.,;:!?()[]{}<>|*#%$&-_=~^/\\"
_NUMBER = re.compile(rb"[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?")
_QUANTITY = re.compile(rb"[+-]?\d[\d.,]*[a-z/%]{1,4}")
_PLAIN, _NUM, _UNIT, _CAPITAL, _NONE = range(5)
_CODE = {k: mix(np.array([k + 1], U64))[0] for k in (_NUM, _UNIT, _CAPITAL)}
_BASE = 0xD1342543DE82EF95


def read_word(word: bytes) -> tuple[bytes, int, bool]:
    """Bare lower-cased token, its kind, and whether it ends a sentence."""
    ends = word.rstrip(b"\"')]}").endswith((b".", b"!", b"?", b":"))
    bare = word.strip(_OUTER)
    low = bare.lower()
    if not bare:
        return low, _NONE, ends
    if low in NUMBERS or _NUMBER.fullmatch(low) or _QUANTITY.fullmatch(low):
        return low, _NUM, ends
    if low in UNITS:
        return low, _UNIT, ends
    text = bare.decode(errors="replace")
    name = len(text) > 1 and text[0].isupper() and not text[1:].isupper()
    return text.lower().replace(".", "").replace(",", "").encode(), _CAPITAL if name else _PLAIN, ends


class Templates:
    """Tokens of some rows with a code in context, a code as a window's first token, and their values."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        words = Words(buf, at)
        unique, first, where = np.unique(words.code, return_index=True, return_inverse=True)
        raw = buf.tobytes()
        seen = [read_word(raw[s:e]) for s, e in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
        own = Words(np.frombuffer(b" ".join(x[0] or b"_" for x in seen), np.uint8), np.array([0, sum(len(x[0] or b"_") + 1 for x in seen) - 1])) if seen else words
        kind = np.array([x[1] for x in seen], np.int8)[where] if seen else np.zeros(0, np.int8)
        ends = np.array([x[2] for x in seen], bool)[where] if seen else np.zeros(0, bool)
        code, row = own.code[where] if seen else words.code, words.row()
        use = kind != _NONE
        before_ends = np.concatenate(([True], ends[:-1]))
        before_ends[words.first[:-1][words.count > 0]] = True
        # marks between two tokens may end the sentence as well
        count = np.cumsum(before_ends)
        kept = np.flatnonzero(use)
        since = np.diff(np.concatenate(([0], count[kept]))) > 0
        self.value = [x[0] for x in seen]
        self.where, kind, code, self.row = where[kept], kind[kept], code[kept], row[kept]
        after_number = np.concatenate(([False], (kind[:-1] == _NUM) & (self.row[1:] == self.row[:-1])))
        self.free = np.where(kind == _NUM, _CODE[_NUM], code)
        self.code = np.where((kind == _CAPITAL) & ~since, _CODE[_CAPITAL], np.where((kind == _UNIT) & after_number, _CODE[_UNIT], self.free))
        self.slot = self.code != code
        self.free_slot = kind == _NUM
        self.first = np.searchsorted(self.row, np.arange(len(at)))
        self.count = np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows of k tokens in one row, their hashes, and their hashes without names and units (equal where there are none)."""
        n = len(self.code)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
        weight = powers(_BASE, k)
        m = n - k + 1
        h = self.free[:m] * weight[k - 1] + U64(k)
        bare = h.copy()
        for j in range(1, k):
            h += self.code[j : j + m] * weight[k - 1 - j]
            bare += self.free[j : j + m] * weight[k - 1 - j]
        start = np.flatnonzero(self.row[:m] == self.row[k - 1 :])
        return start, mix(h[start]), mix(bare[start])

    def slots(self, i: int, k: int, bare: bool) -> list[str]:
        """Values of a window's placeholders; of its numbers only if `bare`."""
        out = [self.value[self.where[i]].decode(errors="replace")] if self.free_slot[i] else []
        slot = self.free_slot if bare else self.slot
        return out + [self.value[self.where[j]].decode(errors="replace") for j in range(i + 1, i + k) if slot[j]]


def window_of(n: int, window: int, share: float) -> int:
    """Tokens in a window of an item of n tokens."""
    return n if n < window else min(window, max(2, int((1 - share) * n + 1e-9)))


def _item_windows(window: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = column(b["text"])
            t = Templates(buf, at)
            ids, rows, made = b["item_id"].to_pylist(), [], {}
            for r, n in enumerate(t.count.tolist()):
                k, a = window_of(n, window, share), int(t.first[r])
                if k:
                    start, h, bare = made[k] = made.get(k) or t.windows(k)
                    for x in range(*np.searchsorted(start, [a, a + n]).tolist()):
                        i = int(start[x])
                        for own, is_bare in ((h, False), (bare, True)) if h[x] != bare[x] else ((h, False),):
                            slots = t.slots(i, k, is_bare)
                            rows.append((ids[r], k, i - a, n, int(own[x].view(np.int64)), slots, 2 * len(slots) <= k))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], ["item_id", "k", "item_at", "of", "hash", "item_slots", "wordy"])

    return run


def _text_windows(lengths: list[int], bits: np.ndarray):
    top = U64(64 - MAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = column(b["text"])
            rows = []
            for lo, hi in row_blocks(at, 1 << 21):
                t = Templates(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                for k in lengths:
                    start, h, bare = t.windows(k)
                    for own, is_bare, among in ((h, False, None), (bare, True, np.flatnonzero(bare != h))):
                        own, begin = (own, start) if among is None else (own[among], start[among])
                        place = (own >> top).astype(np.int64)
                        for x in np.flatnonzero((bits[place >> 6] >> (place & 63).astype(U64)) & U64(1)).tolist():
                            i = int(begin[x])
                            r = int(t.row[i])
                            rows.append((lo + r, i - int(t.first[r]), int(own[x].view(np.int64)), t.slots(i, k, is_bare)))
            r, place, h, slots = zip(*rows, strict=True) if rows else [()] * 4
            take = pa.array(r, pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(take), b["row_key"].take(take), pa.array(place, pa.int32()), pa.array(h, pa.int64()), pa.array(slots, pa.list_(pa.string()))], ["doc_id", "row_key", "at", "hash", "slots"])

    return run


_FOLD = "aggregate(sort_array({places}), named_struct('last', -k - 1, 'n', 0, 'best', 0), (s, x) -> {step}, s -> s.{out})"


def _covered(places: str) -> str:
    """Tokens that windows of k tokens at these places cover."""
    return _FOLD.format(places=places, step="named_struct('last', x, 'n', s.n + least(k, x - s.last), 'best', 0)", out="n")


def _longest(places: str) -> str:
    """Tokens of the longest passage without a gap that windows at these places cover, none left out."""
    n = "if(x = s.last + 1, s.n + 1, k)"
    return _FOLD.format(places=places, step=f"named_struct('last', x, 'n', {n}, 'best', greatest(s.best, {n}))", out="best")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """doc_id, row_key (xxhash64 of the text), items: one row for each contaminated text."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null").groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
    own = written(items.select("item_id", "text").mapInArrow(_item_windows(window, share), "item_id long, k int, item_at int, of int, hash long, item_slots array<string>, wordy boolean"), "item-windows")
    place = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    word = own.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bit"))
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in word.toLocalIterator():  # at most 2**(MAP_BITS - 6) rows
        bits[r["w"]] = r["bit"]
    lengths = sorted(r["k"] for r in own.select("k").distinct().collect())  # at most `window` rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    hits = texts.mapInArrow(_text_windows(lengths, bits.view(U64)), f"doc_id {kind}, row_key long, at int, hash long, slots array<string>").distinct()
    met = written(hits.join(own, "hash"), "met") if lengths else spark.createDataFrame([], f"doc_id {kind}, row_key long, at int, hash long, slots array<string>, item_id long, k int, item_at int, of int, item_slots array<string>, wordy boolean")
    pair = ["doc_id", "row_key", "item_id"]
    aligned = met.withColumn("diagonal", F.col("at") - F.col("item_at"))
    filled = aligned.withColumn("slot", F.explode(F.arrays_zip("item_slots", "slots"))).select(*pair, "diagonal", "slot.item_slots", "slot.slots")
    clashes = filled.groupBy(*pair, "diagonal", "item_slots").agg((F.min("slots") != F.max("slots")).alias("bad")).where("bad").select(*pair, "diagonal").distinct()
    same = [aligned[c].eqNullSafe(clashes[c]) for c in (*pair, "diagonal")]
    sound = aligned.join(clashes, same[0] & same[1] & same[2] & same[3], "left_anti")
    line = sound.groupBy(*pair, "k", "of", "diagonal").agg(F.collect_set("item_at").alias("all"), F.collect_set(F.when(F.col("wordy"), F.col("item_at"))).alias("wordy"))
    line = line.select(*pair, "k", "of", "all", F.expr(_longest("wordy")).alias("long"))
    found = line.groupBy(*pair, "k", "of").agg(F.array_distinct(F.flatten(F.collect_set("all"))).alias("all"), F.max("long").alias("long"))
    found = found.where((F.expr(_covered("all")) >= share * F.col("of")) | (F.col("long") >= run))
    return found.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def mark(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, contaminated, items (ids of items, null if none) of every row of `docs`."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"))
    hit = found.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("row_key", "hit_key")
    out = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key")), "left")
    return out.select("doc_id", F.col("hit_key").isNotNull().alias("contaminated"), "items")


def drop_contaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that no item contaminates."""
    hit = found.select(F.col("doc_id").alias("__hit_id"), F.col("row_key").alias("__hit_key"))
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("__hit_id")) & (F.xxhash64(docs["text"]) == F.col("__hit_key")), "left_anti")
