"""PII: every detected entity gets a surrogate of its own kind, the same one wherever it is mentioned.

1. Entities are found in whole texts by patterns for each type. A mention is reduced to a canonical
   value (case, spaces and separators dropped), so that mentions of one entity agree: coreference.
2. Distinct entities are drawn surrogates by a keyed hash: digits for digits and letters for letters of
   the same case and script, valid check digits, octets and prefixes, names of the same gender. Draws
   are checked in Spark: where two entities of a type drew the same surrogate, or one that occurs as an
   entity itself, all but the smallest draw again, until no draw collides. So distinct entities stay
   distinct in the result.
3. Surrogates go back to their mentions by a join on the entity and are written in the mention's format.
   Hot entities are one row in step 2, and skew joins split their mentions here.

The key is a parameter; without it surrogates can't be computed again. Types: email, phone, card, ip, ssn,
iban, access key, secret (password, token and long hex values) and person (a title and a name).

Cases: null and empty texts come back as they are; equal texts get equal answers (rows are told apart by
doc_id and text). Overlapping matches: the earlier, then the longer one. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

KEY = b"corpus-surrogates"
#: Given names by gender, titles by gender, syllables of family names by script.
GIVEN = {
    "f": "Anna Maria Laura Julia Sophie Clara Elena Emma Alice Nora Lucia Sara Ines Marta Hanna Olga Irene Paula Vera Diana".split(),
    "m": "Peter Paul Martin Thomas David Simon Lukas Felix Oscar Hugo Marco Bruno Pablo Jorge Karl Otto Victor Daniel Adam Leo".split(),
    "n": "Robin Alex Kim Sasha Toni Jordan Charlie Jamie Noel Dominique".split(),
}
TITLES = {"mrs": "f", "ms": "f", "miss": "f", "mme": "f", "mlle": "f", "frau": "f", "señora": "f", "sra": "f", "madame": "f", "mr": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "dr": "n", "prof": "n"}
SYLLABLES = {
    "LATIN": "ba del fin gor hal ker lam mon nor per ras sel tor van wil zan ber cor dan els".split(),
    "CYRILLIC": "бар вел гор дан зор кал лев мир нов пав рас сел тур фед хар".split(),
    "GREEK": "αλ βασ γιαν δημ ελ θεο καλ λαμ μιχ νικ παπ ραλ σταυ τασ".split(),
}
_NAME = r"[^\W\d_a-zß-öø-ÿа-яα-ω](?:[^\W\d_]|['’-])*"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "secret": r"(?i:(?:(?<=password=)|(?<=passwd=)|(?<=token=)|(?<=secret=)|(?<=api_key=)|(?<=apikey=))[^\s\"'&;,]{6,}|\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}\b)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.])(?:\d[ -]?){12,18}\d(?![\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "phone": r"(?<![\w.])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
    "person": rf"\b(?i:{'|'.join(TITLES)})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
_ALL = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_LOOK = re.compile(rf"[@\d]|\b(?i:{'|'.join(TITLES)})\b")
_ENTITY = "array<struct<start:int,end:int,type:string,value:string>>"


def canonical(kind: str, mention: str) -> str:
    if kind == "email":
        return mention.lower()
    if kind in ("card", "ssn", "phone"):
        return ("+" if mention.startswith("+") else "") + re.sub(r"\D", "", mention)
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "person":
        title, *name = mention.split()
        return f"{TITLES[title.rstrip('.').lower()]} {' '.join(name).lower()}"
    return mention


def entities(text: str | None) -> list[dict]:
    """Mentions in order: start, end, type, canonical value."""
    if not text or not _LOOK.search(text):
        return []
    return [{"start": m.start(), "end": m.end(), "type": m.lastgroup, "value": canonical(m.lastgroup, m.group())} for m in _ALL.finditer(text)]


def _stream(key: bytes, *parts: str) -> Iterator[int]:
    """Endless keyed bytes."""
    n = 0
    while True:
        yield from hmac.digest(key, "\x1f".join((*parts, str(n))).encode(), hashlib.sha256)
        n += 1


def _like(text: str, draw: Iterator[int], hexadecimal: bool = False) -> str:
    """Digits for digits and letters for letters of the same case; other marks stay."""
    out = []
    for c in text:
        n = next(draw) * 256 + next(draw)
        if c.isdigit():
            out.append(str(n % 10))
        elif c.isalpha():
            abc = "abcdef" if hexadecimal and c in "abcdefABCDEF" else _alphabet(c)
            d = abc[n % len(abc)]
            out.append(d.upper() if c.isupper() else d)
        else:
            out.append(c)
    return "".join(out)


def _script(c: str) -> str:
    return next((s for s in SYLLABLES if unicodedata.name(c, "").startswith(s)), "LATIN")


def _alphabet(c: str) -> str:
    return {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}[_script(c)]


def luhn(digits: str) -> int:
    """The check digit that completes `digits`."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The `attempt`-th draw for an entity, in canonical form."""
    draw = _stream(key, kind, value, str(attempt))
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")[:-2]  # the domain itself becomes a reserved one
        return f"{_like(local, draw)}@{''.join(_like(x, draw) + '.' for x in labels)}example.{('com', 'net', 'org')[next(draw) % 3]}"
    if kind == "card":
        body = value[0] + _like(value[1:-1], draw)
        check = luhn(body)
        return body + str(check if luhn(value[:-1]) == int(value[-1]) else (check + 1 + next(draw) % 9) % 10)
    if kind == "ip":
        first, *rest = value.split(".")
        private = first in ("10", "127", "0") or value.startswith("192.168.")
        keep = 2 if value.startswith("192.168.") else 1 if private else 0
        octets = [first, *rest][:keep] + [str(1 + next(draw) % (223 if i == 0 and not keep else 254)) for i in range(4 - keep)]
        return ".".join(octets)
    if kind == "phone":
        keep = 2 if value.startswith("+") else 0
        return value[:keep] + _like(value[keep:], draw)
    if kind == "access_key":
        return value[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[next(draw) % 32] for _ in value[4:])
    if kind == "iban":
        body = _like(value[4:], draw)
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "person":
        gender, *name = value.split(" ")
        script = _script(name[0][0])
        out = []
        for i, _ in enumerate(name):
            if i == 0 and len(name) > 1 and script == "LATIN":
                out.append(GIVEN[gender][(next(draw) * 256 + next(draw)) % len(GIVEN[gender])].lower())
            else:
                out.append("".join(SYLLABLES[script][next(draw) % len(SYLLABLES[script])] for _ in range(2 + next(draw) % 2 + attempt // 4)))
        return f"{gender} {' '.join(out)}"
    return _like(value, draw, hexadecimal=bool(re.fullmatch("[0-9a-fA-F]+", value)))


def render(kind: str, mention: str, new: str) -> str:
    """A canonical surrogate in the format of a mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(new.lstrip("+"))
        return "".join(next(rest) if c.isalnum() else c for c in mention)
    if kind == "person":
        title, *name = mention.split()
        words = new.split(" ")[1:]
        return " ".join([title, *(w.upper() if len(o) > 1 and o.isupper() else w.capitalize() for o, w in zip(name, words, strict=True))])
    if kind == "email":
        return new.upper() if mention.isupper() else new
    return new


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("value", pa.string())]))
    for b in batches:
        found = [entities(t) for t in b["text"].to_pylist()]
        some = pa.array([i for i, f in enumerate(found) if f], pa.int64())
        yield pa.RecordBatch.from_arrays([b["doc_id"].take(some), b["row_key"].take(some), pa.array([f for f in found if f], kind)], ["doc_id", "row_key", "found"])


def _draw(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, k, v, a) for k, v, a in zip(b["type"].to_pylist(), b["value"].to_pylist(), b["attempt"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["type"], b["value"], b["attempt"], pa.array(new, pa.string())], ["type", "value", "attempt", "surrogate"])

    return run


def assign(found: DataFrame, key: bytes = KEY, max_rounds: int = 50) -> DataFrame:
    """(type, value, surrogate) of distinct entities; no two surrogates of a type are equal and none is an entity."""
    names = written(found.select("type", "value").distinct(), "entities")
    schema = "type string, value string, attempt int, surrogate string"
    drawn = written(names.withColumn("attempt", F.lit(0)).mapInArrow(_draw(key), schema), "draws")
    for _ in range(max_rounds):
        least = drawn.groupBy("type", "surrogate").agg(F.min("value").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
        real = names.select("type", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        judged = drawn.join(least, ["type", "surrogate"], "left").join(real, ["type", "surrogate"], "left")
        again = F.coalesce("real", F.lit(False)) | F.coalesce(F.col("value") != F.col("least"), F.lit(False))
        judged = written(judged.select("type", "value", "attempt", "surrogate", again.alias("again")), "judged")
        if judged.where("again").isEmpty():
            return judged.select("type", "value", "surrogate")
        anew = judged.where("again").select("type", "value", (F.col("attempt") + 1).cast("int").alias("attempt")).mapInArrow(_draw(key), schema)
        drawn = written(judged.where("not again").drop("again").unionByName(anew), "draws")
    raise RuntimeError("surrogates still collide; their formats leave too few values")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, counts = [], []
        for text, news in zip(b["text"].to_pylist(), b["news"].to_pylist(), strict=True):
            parts, at = [], 0
            for n in sorted(news or [], key=lambda n: n["start"]):
                parts += [text[at : n["start"]], render(n["type"], text[n["start"] : n["end"]], n["surrogate"])]
                at = n["end"]
            out.append(text if text is None or not parts else "".join(parts) + text[at:])
            counts.append(len(news or []))
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(counts, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_entities", "text"])


def replace_pii(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, n_entities and the text with surrogates, for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    found = written(rows.mapInArrow(_find, f"doc_id {kind}, row_key long, found {_ENTITY}").distinct(), "found")
    mentions = found.select("doc_id", "row_key", F.explode("found").alias("m")).select("doc_id", "row_key", "m.*")
    news = mentions.join(assign(mentions, key), ["type", "value"]).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "end", "type", "surrogate")).alias("news"))
    news = news.withColumnRenamed("doc_id", "id").withColumnRenamed("row_key", "key")
    both = rows.join(news, rows["doc_id"].eqNullSafe(news["id"]) & (rows["row_key"] == news["key"]), "left")
    return both.select("doc_id", "text", "news").mapInArrow(_rewrite, f"doc_id {kind}, n_entities long, text string")
