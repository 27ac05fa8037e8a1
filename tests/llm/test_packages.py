"""ZIP-packaged WARC records: round trips, ZIP64 directories, ranges."""

import hashlib
import io
import struct
import zipfile

import pytest

from tapeworks.llm import warc, zip_ranges
from tapeworks.llm.shared import folder

LONG = "<html>" + "é" * 60 + "</html>"
PAGES = [
    (5, "http://a/", LONG), (3, "http://b/\r\nX: y", LONG), (9, None, LONG), (None, "http://n/", LONG), (3, "http://b2/", LONG), (1, "http://s/", "short"), (2, "", "short"),
    (4, "http://e/", ""), (6, "http://e/", None), (7, "http://x/", "x" * 99), (8, "http://x/", "x" * 99), (10, "u", "y" * 100), (11, "u", "y" * 100),
    (None, "v", "only without an id " * 9), (None, "v", "only without an id " * 9), (12, "http://h/", "\r\n\r\nWARC/1.1\r\n" * 50), (13, "http://l/", "long é\x00 " * 200_000), (14, "http://l/", "long é\x00 " * 200_000),
]


def _frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, path string, offset int")


def _brute(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        to = first.get(html)
        revisit = to is not None and to != page_id
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def _rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize("package_bytes, package_records", [(warc.PACKAGE_BYTES, warc.PACKAGE_RECORDS), (200, 3)])
def test_pages_come_back_from_packages(spark, package_bytes, package_records):
    path = folder(spark, "warc")
    warc.write(_frame(spark), path, package_bytes=package_bytes, package_records=package_records)
    listed = warc.index(spark, path)
    assert _rows(warc.fetch(listed)) == _brute(PAGES)
    out = {(r.page_id, r.url): r for r in warc.fetch(listed).collect()}
    for page_id, url, html in PAGES:
        r = out[page_id, None if url is None else url.replace("\r\nX: y", "%0D%0AX:%20y")]
        assert r.payload is None if r.record_type == "revisit" else r.payload.decode() == (html or "")
    assert {r.page_id for r in warc.fetch(listed.where("page_id in (13, 1)")).collect()} == {1, 13}  # a few ranges only
    if package_records == 3:
        assert listed.select("path").distinct().count() > 4


def test_no_pages_and_one_hot_payload(spark):
    path = folder(spark, "warc")
    warc.write(_frame(spark).limit(0), path)
    assert warc.fetch(warc.index(spark, path)).count() == 0
    rows = [(i, f"http://h/{i}", LONG if i % 2 else f"{i} " * 60) for i in range(4000)]
    path = folder(spark, "warc")
    warc.write(_frame(spark, rows).repartition(7), path)
    assert _rows(warc.fetch(warc.index(spark, path))) == _brute(rows)


def test_a_lost_attempt_leaves_nothing(spark):
    path = folder(spark, "warc")
    warc.write(_frame(spark), path)
    package = warc._Package()
    package.add(99, "http://lost/", b"lost", "0", None, False)
    package.save(f"{path}/packages", True)  # of a task whose rows were never committed
    assert _rows(warc.fetch(warc.index(spark, path))) == _brute(PAGES)


def test_packages_are_plain_archives_and_damage_is_seen(spark, tmp_path):
    path = folder(spark, "warc")
    warc.write(_frame(spark).coalesce(1), path)
    name = warc.index(spark, path).first()["path"].removeprefix("file:")
    with zipfile.ZipFile(name) as z:
        assert z.testzip() is None and z.namelist() == ["archive/data.warc.gz", "indexes/index.cdxj"]
    raw = bytearray(open(name, "rb").read())
    place = zip_ranges.data_place(lambda a, n: raw[a : a + n], zip_ranges.members(lambda a, n: raw[a : a + n], len(raw))[1])
    raw[place + 3] ^= 1
    open(name, "wb").write(raw)
    with pytest.raises(Exception, match="the index is damaged"):
        warc.index(spark, path).collect()


@pytest.mark.parametrize("limit", [None, 1, 40])
@pytest.mark.parametrize("comment", [b"", b"PK\5\6 a comment with a signature" + b"x" * 40, b"z" * 65535])
def test_directories_agree_with_the_standard_library(monkeypatch, limit, comment):
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", limit)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for i in range(45):
            with z.open(zipfile.ZipInfo(f"méth/{i}"), "w", force_zip64=True) as f:
                f.write(b"%d " % i * i)
        z.writestr(zipfile.ZipInfo("packed"), b"0" * 999, zipfile.ZIP_DEFLATED)
        z.comment = comment
    raw = out.getvalue()
    read = lambda a, n: raw[a : a + n]
    if limit:
        assert b"PK\6\6" in raw
    found = {m.name: m for m in zip_ranges.members(read, len(raw))}
    assert len(found) == 46
    for i in range(45):
        m = found[f"méth/{i}"]
        at = zip_ranges.data_place(read, m)
        assert raw[at : at + m.size] == b"%d " % i * i and m.packed == m.size
    with pytest.raises(ValueError, match="compressed"):
        zip_ranges.data_place(read, found["packed"])
    with pytest.raises(ValueError, match="no end"):
        zip_ranges.members(read, len(raw) - 1)


def test_fields_of_64_bits():
    """An entry whose sizes and place need 64 bits, built by hand."""
    extra = struct.pack("<HHQQQ", 1, 24, 7 << 33, 7 << 33, 5 << 33)
    entry = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0, 1, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra) + 6, 0, 0, 0, 0, 0xFFFFFFFF) + b"m" + b"\xff\xff\2\0ab" + extra
    start = 1 << 35
    end64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    locator = b"PK\6\7" + struct.pack("<IQI", 0, start + len(entry), 1)
    end = b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    tail = entry + end64 + locator + end

    def read(at, n):  # nothing but zeros before the directory
        zeros = min(n, max(0, start - at))
        return bytes(zeros) + tail[max(0, at - start) : at + n - start]

    assert zip_ranges.members(read, start + len(tail)) == [zip_ranges.Member("m", 0, 1, 7 << 33, 7 << 33, 5 << 33)]
