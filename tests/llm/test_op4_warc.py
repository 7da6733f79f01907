import struct

import pytest
import zstandard
from oracle import SMALL, check

from weirflow.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, payload string, first long, file string"


def frames_of(records):
    data = b"".join(warc.archive(iter(records)))
    parts = [data[k : k + 97] for k in range(0, len(data), 97)]
    return list(warc.frames(lambda: parts.pop(0) if parts else b""))


def test_query_equals_its_sql(spark):
    check(spark, SMALL, warc.op4_warc_zstd, warc.OP4_SQL)


def test_every_archive_leads_with_a_dictionary_that_its_frames_need():
    short = [warc.record(n, "http://a/", b"x" * n, "d" * 64, None) for n in range(3)]
    many = [warc.record(n, f"http://a/{n}", (f"<p>page {n} about {n % 7}</p>" * 60).encode(), "d" * 64, None) for n in range(900)]
    for records in ([], short[:1], short, many, [b"a", b""]):
        data = b"".join(warc.archive(iter(records)))
        assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
        assert frames_of(records) == records
        if len(records) > 2:
            with pytest.raises(zstandard.ZstdError):
                zstandard.ZstdDecompressor().decompress(data[8 + struct.unpack("<I", data[4:8])[0] :])


def archives(spark, monkeypatch, folder):
    """The first bytes of all archives that the query writes, read before it deletes them."""
    import glob

    heads = []
    monkeypatch.setattr(warc, "remove", lambda spark, path: heads.extend(open(f, "rb").read(4) for f in glob.glob(path.removeprefix("file://") + "/*")))
    warc.op4_warc_zstd(spark, folder)
    return heads


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_the_query_reads_dictionaries(spark, monkeypatch, folder):
    heads = archives(spark, monkeypatch, folder)
    assert heads and set(heads) == {struct.pack("<I", warc.DICTIONARY_MAGIC)}


def test_broken_archives_are_noticed():
    records = [warc.record(1, "u", b"y" * 300, "d" * 64, None)] * 2
    data = b"".join(warc.archive(iter(records)))
    without = zstandard.ZstdCompressor().compress(records[0])
    for broken in (data[: len(data) - 3], data[: len(data) - 50], struct.pack("<II", warc.DICTIONARY_MAGIC, 500) + b"short", b"", without, data[:-9] + b"x" * 9):
        parts = [broken]
        with pytest.raises(ValueError):
            list(warc.frames(lambda: parts.pop(0) if parts else b""))


def test_bad_records_are_returned_where_asked(spark, tmp_path):
    import hashlib

    good = [warc.record(n, "u", b"p%d" % n, hashlib.sha256(b"p%d" % n).hexdigest(), None) for n in range(4)]
    data = [b"".join(warc.archive(iter(r))) for r in ([good[0], good[1].replace(b"p1", b"q1"), good[2]], good[3:])]
    files = []
    for k, raw in enumerate((data[0], data[1][:-5])):
        (tmp_path / f"{k}.warc.zst").write_bytes(raw)
        files.append((str(tmp_path / f"{k}.warc.zst"), 1, 1))
    manifest = spark.createDataFrame(files, warc.MANIFEST)
    rows = sorted(warc.read_archives(manifest, f"file://{tmp_path}", strict=False).collect(), key=lambda r: (r.file, r.number))
    assert [(r.page_id, r.number, r.error is None) for r in rows] == [(0, 0, True), (None, 1, False), (2, 2, True), (None, 0, False)]
    assert "digest" in rows[1].error and "frame" in rows[3].error
    with pytest.raises(Exception, match="digest|frame"):
        warc.read_archives(manifest, f"file://{tmp_path}").collect()


def test_records_are_validated():
    import hashlib

    payload = b"hello"
    good = warc.record(7, "http://a/\r\nX: 1 é", payload, hashlib.sha256(payload).hexdigest(), None)
    assert warc.parse(good)[:5] == (7, 5, hashlib.sha256(payload).hexdigest(), "response", None)
    assert b"\r\nX: 1" not in good
    revisit = warc.record(8, None, payload, hashlib.sha256(payload).hexdigest(), 7)
    assert warc.parse(revisit) == (8, 5, hashlib.sha256(payload).hexdigest(), "revisit", 7, None)
    for bad in (
        good.replace(b"WARC/1.1", b"WARX/1.1"),
        good.replace(b"hello", b"hellO"),
        good[:-1],
        good + b"x",
        good.replace(b"WARC-Date", b"WARC-Dat"),
        good.replace(b"\r\nContent-Length: 5", b"\r\nContent-Length: 6"),
        good.replace(b"WARC-Type: response", b"WARC-Type: metadata"),
        good.replace(b"sha256:", b"md5:"),
        revisit.replace(b"WARC-Refers-To", b"WARC-Refers-Xo"),
        b"nothing",
    ):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_awkward_pages(spark, folder):
    same = "<p>" + "z" * 200
    rows = [(5, "u", same), (3, None, same), (9, "u", same), (None, "u", same), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (3, None, same), (7, "é" * 3000, "é" * 60), (8, "u", "é" * 60)]
    pages = spark.createDataFrame([(*r, "d", "p", 1, "f") for r in rows], SCHEMA)
    manifest = warc.write(warc.plan_records(pages), folder + "/w", archive_bytes=300)
    assert manifest.count() > 2 and manifest.groupBy().sum("records").first()[0] == len(rows)
    got = sorted((((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(manifest, folder).collect()), key=str)
    assert got == sorted([
        (5, 203, "revisit", 3), (3, 203, "response", None), (3, 203, "response", None), (9, 203, "revisit", 3), (0, 203, "revisit", 3), (1, 0, "response", None),
        (2, 0, "response", None), (4, 5, "response", None), (6, 5, "response", None), (7, 120, "response", None), (8, 120, "revisit", 7),
    ], key=str)
    payloads = {r.page_id: r.payload for r in warc.read_archives(manifest, folder, payload=True).collect()}
    assert bytes(payloads[7]).decode() == "é" * 60 and payloads[8] is None
    none = warc.write(warc.plan_records(pages.limit(0)), folder + "/none")
    assert none.count() == 0 and warc.read_archives(none, folder).count() == 0
