"""Line dedup with a log-template tree, in DataFrame functions only.

A line is cut at single spaces; a token with a digit becomes a wildcard. The tree has a fixed depth: number
of tokens, then the leading tokens. In a leaf the line found in most documents is a template, and lines
that agree with it in at least `similar` of all places belong to it, their other places being variable
fields; what is left is treated likewise until every line has a template or too few for one are left. A round
does this for the first `TOPS` forms of every leaf at once, with the same result. A template in at
least `min_docs` documents is recurring, and its lines are dropped everywhere.

A document that would lose more than `most` of its characters is a copy, not a page with boilerplate:
it keeps its text, for document dedup to judge.

Only leaves that enough rows reach can hold such a template. They are kept as a bit map of fixed size
(2**22 bits, at most 65,536 words of it broadcast), by which other lines are left behind before any text moves;
a line that passes by chance changes nothing. Hot templates are counted after (template, document) is made
distinct with partial aggregation, and joins on them are left to Spark's skew join.

Cases: null texts stay null; blank lines never recur and stay; rows are told apart by doc_id and text, so
equal rows count as one document and get the same answer. Null doc_ids are documents like others. All columns
are kept, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

LEAD, SIMILAR, TOPS, MIN_DOCS, MOST = 3, 0.7, 64, 5, 0.5
MAP_BITS = 22
_DOC = ["doc", "row_key"]


_BLANKS = " \t\r\x0b\x0c"


def masked(raw: Column) -> Column:
    """The line with single wildcards for tokens with digits; rare steps run only where they change something."""
    odd = raw.contains("\t") | raw.contains("\r") | raw.contains("\x0b") | raw.contains("\x0c")
    flat = F.trim(F.when(odd, F.translate(raw, _BLANKS[1:], "    ")).otherwise(raw))
    return F.when(flat.rlike("[0-9]"), F.regexp_replace(flat, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(flat)


def parsed(docs: DataFrame, lead: int) -> DataFrame:
    """doc, row_key, at, line, tokens, leaf, form of every line with a word."""
    rows = docs.where("text is not null").select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row_key"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    rows = rows.where(F.ltrim("raw", F.lit(_BLANKS)) != "")  # on `raw`, so that `line` is computed once
    lines = rows.select(*_DOC, "at", masked(F.col("raw")).alias("line"))
    tokens = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return lines.withColumn("tokens", tokens).withColumn("leaf", F.xxhash64("tokens", F.substring_index("line", " ", lead))).withColumn("form", F.xxhash64("line"))


def _slot(leaf: str = "leaf") -> tuple[Column, Column]:
    place = F.shiftrightunsigned(leaf, 64 - MAP_BITS)
    return F.shiftright(place, 6).cast("int"), (place % 64).cast("int")


def _in_map(df: DataFrame, bitmap: DataFrame) -> DataFrame:
    word, bit = _slot()
    hit = F.broadcast(bitmap)  # at most 2**(MAP_BITS - 6) rows
    return df.join(hit, word == F.col("w")).where(F.expr(f"shiftrightunsigned(bits, cast(shiftrightunsigned(leaf, {64 - MAP_BITS}) % 64 as int)) & 1 = 1")).drop("w", "bits")


def templates(docs: DataFrame, bitmap: DataFrame, min_docs: int, lead: int, similar: float, tops: int = TOPS) -> DataFrame:
    """(form, template) for the lines of busy leaves that share a template with another form."""
    busy = _in_map(parsed(docs, lead), bitmap).groupBy("leaf", "form").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    left, out = written(busy, "forms"), None
    agrees = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) >= similar * F.size(b)
    first = Window.partitionBy("leaf").orderBy(F.desc("n"), F.desc("line"), F.desc("form"))
    while True:
        # a leaf with one form, or with fewer lines than a recurring template has, is done
        open_leaves = left.groupBy("leaf").agg(F.count("*").alias("k"), F.sum("n").alias("lines")).where((F.col("k") > 1) & (F.col("lines") >= min_docs)).select("leaf")
        top = left.withColumn("r", F.row_number().over(first)).where(F.col("r") <= tops)
        top = top.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("r", "form", F.split("line", " ").alias("words")))).alias("top"))
        none = F.expr("cast(array() as array<struct<r: int, form: bigint, words: array<string>>>)")
        shapes = F.aggregate("top", none, lambda s, x: F.when(F.exists(s, lambda t: agrees(t["words"], x["words"])), s).otherwise(F.array_append(s, x)))
        shapes = top.join(open_leaves, "leaf").select("leaf", shapes.alias("shapes"))
        words = F.split("line", " ")
        judged = left.join(shapes, "leaf").withColumn("template", F.get(F.filter("shapes", lambda t: agrees(t["words"], words)), F.lit(0))["form"])
        done = written(judged.select("leaf", "form", "template", "n", "line"), "judged")
        found = done.where("template is not null").select("form", "template")
        out = found if out is None else out.union(found)
        left = done.where("template is null").drop("template")
        if left.isEmpty():
            return out


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, lead: int = LEAD, similar: float = SIMILAR) -> DataFrame:
    """doc, row_key, at: every line of a recurring template."""
    lines = written(parsed(docs, lead).select(*_DOC, "at", "leaf", "form"), "lines")
    word, bit = _slot()
    busy = lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    bitmap = written(busy.select(word.alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(leaf, {64 - MAP_BITS}) % 64 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")), "map")
    known = written(templates(docs, bitmap, min_docs, lead, similar).distinct(), "templates")
    named = _in_map(lines, bitmap).join(known, "form", "left").select(*_DOC, "at", F.coalesce("template", "form").alias("template"))
    named = written(named, "named")
    recurring = named.select("template", *_DOC).distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    recurring = written(recurring.select("template"), "recurring")  # a table of its own, so that a hot template's lines can be split
    return named.join(recurring, "template").select(*_DOC, "at")


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, most: float = MOST, report: bool = False, **tree) -> DataFrame:
    """`docs` with recurring lines cut from `text`; `report` adds n_lines, n_dropped and is_copy."""
    drops = recurring_lines(docs.select("doc_id", "text"), min_docs, **tree).groupBy(*_DOC).agg(F.collect_set("at").alias("__gone"))
    drops = drops.select(F.col("doc").alias("__doc"), F.col("row_key").alias("__key"), "__gone")
    both = docs.join(drops, docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__key")), "left")
    lines = F.split(docs["text"], "\n")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: F.get(lines, i)), "\n")
    # array_join's text comes first, then its length decides; both stay within one row
    both = both.withColumn("__kept", F.when(F.col("__gone").isNotNull(), kept))
    copy = F.coalesce(F.length("__kept") < (1 - most) * F.length(docs["text"]), F.lit(False))
    text = F.when(F.col("__kept").isNotNull() & ~copy, F.col("__kept")).otherwise(docs["text"])
    cols = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    if report:
        gone = F.coalesce(F.size("__gone"), F.lit(0))
        cols += [F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.when(copy, 0).otherwise(gone).alias("n_dropped"), copy.alias("is_copy")]
    return both.select(*cols)
