import gzip
import hashlib
import random
import uuid

from layerflow.llm import warc
from layerflow.llm.common import scratch_dir


def plain(pages):
    data = {i: (h or "").encode() for i, h in pages}
    first = {}
    for i, d in sorted(data.items()):
        first.setdefault(d, i)
    result = {}
    for i, d in data.items():
        to = first[d] if len(d) >= 100 and first[d] != i else None
        result[i] = (len(d), hashlib.sha256(d).hexdigest(), "response" if to is None else "revisit", to)
    return result


def got(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def test_round_trip_equals_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    result = warc.round_trip(pages)
    assert result.count() == pages.count()
    assert got(result) == plain([(r.page_id, r.html) for r in pages.collect()])


def test_odd_rows(spark):
    long_text = "é<p>" * 300000
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u\r\nWARC/1.1", "a" * 99, "x"), (4, "u", "a" * 99, "x"), (9, "u", "b" * 100, "x"),
            (5, "u", "b" * 100, "y"), (6, None, long_text, "z"), (7, "ü", long_text, None), (8, "u", "WARC/1.1\r\n\r\n\r\n\x1f\u008b\x08", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    assert got(warc.round_trip(pages)) == plain([(r[0], r[2]) for r in rows])
    assert warc.round_trip(pages.where("false")).count() == 0
    twice = warc.round_trip(pages.union(pages)).collect()
    assert len(twice) == 18 and sum(r.record_type == "revisit" for r in twice) == 4


def test_files_are_plain_gzip_and_bound(spark):
    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(50)], "page_id long, url string, html string").coalesce(1)
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.planned(pages).coalesce(1), path, file_records=20)
    files = spark.read.format("binaryFile").load(path).collect()
    assert len(files) == 3
    text = b"".join(gzip.decompress(f.content) for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type: response") == 50


def ids(found):
    return [f["warc-record-id"] for _, _, x in found if isinstance(x, list) for f, _ in x]


def test_salvage_recovers_later_records_and_logs_gaps(spark):
    raw = [warc.record(k, "u", f"payload {k}".encode() * 20) for k in range(6)]
    packed = [gzip.compress(r, mtime=0) for r in raw]
    every = [f"<urn:x-page:{k}>" for k in range(6)]
    cases = {}
    for name, parts in (("gz", packed), ("plain", raw)):
        whole = b"".join(parts)
        begin, end = sum(map(len, parts[:2])), sum(map(len, parts[:3]))
        cases[name] = whole
        assert ids(warc.salvage(whole)) == every
        flipped = bytearray(whole)
        flipped[end - 20] ^= 0xFF  # inside the third record
        found = list(warc.salvage(bytes(flipped)))
        assert ids(found) == every[:2] + every[3:]
        assert [(a, b) for a, b, x in found if isinstance(x, str)] == [(begin, end)]
        cut = whole[: end - 30] + whole[end:]  # bytes lost
        assert ids(warc.salvage(cut)) == every[:2] + every[3:]
        noise = b"junk WARC/1.1 junk \x1f\x8b\x08 junk"
        found = list(warc.salvage(noise + whole[:begin] + noise + whole[begin:] + noise))
        assert ids(found) == every and sum(isinstance(x, str) for _, _, x in found) == 3
        assert sum(b - a for a, b, x in found if isinstance(x, str)) == 3 * len(noise)
        # Cut off at the end: a packed record is whole without the last byte of its member's length.
        assert ids(warc.salvage(whole[: end - 1])) == (every[:3] if name == "gz" else every[:2])
        assert ids(warc.salvage(whole[: end - 30])) == every[:2]
    assert list(warc.salvage(b"")) == [] and [x[:2] for x in warc.salvage(b"\x00" * 9)] == [(0, 9)]
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    blobs = spark.createDataFrame([(bytearray(b"xx" + cases["gz"]),)], "b binary").selectExpr("cast(b as string)")
    blobs.write.text(path)
    rows = warc.read(spark, path, payloads=True).collect()
    assert [r.page_id for r in rows if r.gap is None] == list(range(6)) and rows[0].gap and (rows[0].start, rows[0].end) == (0, 2)
    assert bytes(rows[1].payload) == b"payload 0" * 20 and rows[1].stated_digest == rows[1].payload_digest


def test_members_of_many_records_lose_only_the_bad_ones():
    raw = [warc.record(k, "u", random.Random(k).randbytes(3000)) for k in range(5)]
    every = [f"<urn:x-page:{k}>" for k in range(5)]
    begin, end = len(raw[0] + raw[1]), len(raw[0] + raw[1] + raw[2])
    whole = bytearray(b"".join(raw))
    whole[end - 100] ^= 0xFF  # in the block of the third record, before it was packed
    next_one = gzip.compress(warc.record(9, "u", b"later" * 9), mtime=0)
    found = list(warc.salvage(gzip.compress(bytes(whole), mtime=0) + next_one))
    assert ids(found) == [*every[:2], *every[3:], "<urn:x-page:9>"]
    (gap,) = [x for _, _, x in found if isinstance(x, str)]
    assert f"bytes {begin} to {end} " in gap
    # Stored bytes, so that one that is turned later is one byte of the content.
    stored = bytearray(gzip.compress(b"".join(raw), 0, mtime=0))
    at = stored.index(raw[3][-500:])
    stored[at] ^= 0xFF
    found = list(warc.salvage(bytes(stored) + next_one))
    assert ids(found) == [*every[:3], every[4], "<urn:x-page:9>"]
    assert any("member" in x for _, _, x in found if isinstance(x, str))
    cut = gzip.compress(b"".join(raw), 0, mtime=0)[: end + 700]
    found = list(warc.salvage(cut + next_one))
    assert ids(found) == [*every[:3], "<urn:x-page:9>"]
    # Without a digest nothing tells whether a record of a broken member is whole.
    plain_text = [warc.record(k, "u", f"payload {k} ".encode() * 200) for k in range(5)]
    for parts, kept in ((plain_text, every), ([r.replace(b"WARC-Block-Digest", b"X-Digest") for r in plain_text], [])):
        packed = bytearray(gzip.compress(b"".join(parts), mtime=0))
        assert ids(warc.salvage(bytes(packed))) == every
        packed[-6] ^= 0xFF  # the member's own check
        assert ids(warc.salvage(bytes(packed) + next_one)) == [*kept, "<urn:x-page:9>"]


def test_long_urls_are_read_back(spark):
    rows = [(1, "data:" + "u" * 100_000, "a" * 500), (2, "u", "a" * 500), (3, "u", "b" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert got(warc.round_trip(pages)) == plain([(r[0], r[2]) for r in rows])
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.planned(pages), path)
    assert {r.page_id: r.url for r in warc.read(spark, path).collect()} == {r[0]: r[1] for r in rows}


def test_files_are_bound_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    rows = [(k, "u", random.Random(k).randbytes(10_000 if k % 3 else 100).hex()) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.planned(pages).coalesce(1), path)
    sizes = [len(f.content) for f in spark.read.format("binaryFile").load(path).collect()]
    largest = max(len(gzip.compress(warc.record(k, u, h.encode()), 6)) for k, u, h in rows)
    # Rows end with an empty member each.
    assert len(sizes) > 3 and max(sizes) <= 100_000 + largest + warc.FILE_RECORDS * len(warc._EMPTY)
    assert sorted(r.page_id for r in warc.read(spark, path).collect()) == list(range(60))
