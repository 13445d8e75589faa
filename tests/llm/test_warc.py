import base64
import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from gristmill.llm import warc


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/warc"


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def plain(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by the rule."""
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        of = first.get(html or "")
        revisit = len(data) >= least and of is not None and of != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", of if revisit else None))
    return sorted(out, key=repr)


ODD = [(5, "http://a", "same"), (3, "http://b", "same"), (3, "http://b", "same"), (None, "u", "same"), (None, None, "lonely"), (9, None, None), (8, "x y\r\nz", ""), (10, "é", "é\x00\r\n\r\nWARC/1.1\r\n"), (11, "", "x" * 3_000_000), (-4, "neg", "tt"), (12, "neg", "tt")]
KIND = "page_id long, url string, html string"


def test_pages_come_back(spark, pages):
    got = sorted((tuple(r) for r in warc.query(pages).collect()), key=repr)
    assert got == plain([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, KIND).select("*", *[F.lit(1).alias(c) for c in ("payload", "digest", "size", "first", "key", "file", "n")])
    assert sorted((tuple(r) for r in warc.query(df).collect()), key=repr) == plain(ODD)


def test_small_payloads_can_be_kept(spark, folder):
    df = spark.createDataFrame(ODD, KIND)
    got = warc.read(warc.write(df, folder, least_bytes=3), folder).collect()
    want = plain(ODD, 3)
    name = lambda x: "urn:page:none" if x is None else f"urn:page:{x}"
    assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(((name(a), b, c, d, None if e is None else name(e)) for a, b, c, d, e in want), key=repr)


def test_payloads_and_targets_are_read_whole(spark, pages, folder):
    some = pages.unionByName(pages.select(F.col("page_id") + 1_000_000, "url", "html").toDF("page_id", "url", "html"))
    archives = warc.write(some, folder, max_bytes=20_000)
    assert archives.count() > 2 * some.rdd.getNumPartitions()
    got = warc.read(archives, folder).collect()
    html = {r.page_id: (r.url, r.html) for r in some.collect()}
    assert len(got) == len(html) and not any(r.error for r in got)
    for r in got:
        url, text = html[int(r.record_id.removeprefix("urn:page:"))]
        assert r.target_uri == url
        if r.record_type == "response":
            assert r.payload.decode() == text and r.payload_bytes == len(r.payload)
        else:
            assert r.payload is None and html[int(r.refers_to.removeprefix("urn:page:"))][1] == text


def archive(*records, dictionary=b"", compressed=True):
    code = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    head = b"" if not dictionary else warc.dictionary_frame(dictionary) if compressed else warc.DICT_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary
    return head + b"".join(code.compress(r) for r in records)


GOOD = warc.record_bytes("urn:page:1", "http://x", b"payload " * 50)


@pytest.fixture(scope="module")
def dictionary():
    return zstandard.train_dictionary(2000, [warc.record_bytes(f"urn:page:{i}", f"http://x/{i}", f"some text {i * 7919}".encode() * 5) for i in range(200)]).as_bytes()


@pytest.mark.parametrize("compressed", [True, False])
def test_the_dictionary_comes_from_the_leading_frame(dictionary, compressed):
    data = archive(GOOD, GOOD, dictionary=dictionary, compressed=compressed)
    assert [(d, e) for _, d, e in warc.frames(io.BytesIO(data))] == [(GOOD, None)] * 2
    skip = b"\x50\x2a\x4d\x18" + (3).to_bytes(4, "little") + b"abc"
    assert [d for _, d, _ in warc.frames(io.BytesIO(archive(GOOD) + skip + archive(GOOD)))] == [GOOD, GOOD]
    without = data[data.index(warc.ZSTD_MAGIC, 8 + 8) :] if compressed else data[8 + len(dictionary) :]
    assert [d for _, d, _ in warc.frames(io.BytesIO(without))] != [GOOD, GOOD]


def test_a_frame_larger_than_a_chunk_and_many_in_one(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    big = warc.record_bytes("urn:page:1", None, bytes(range(256)) * 400)
    data = archive(big, GOOD, big)
    got = list(warc.frames(io.BytesIO(data)))
    assert [d for _, d, _ in got] == [big, GOOD, big]
    for offset, d, _ in got:  # each frame can be decoded by itself
        assert next(warc.frames(io.BytesIO(data[offset:])))[1] == d


def test_broken_archives(dictionary):
    data = archive(GOOD, GOOD, dictionary=dictionary)
    for cut in (2, 6, 30, len(data) - 1, len(data) - 40):
        got = list(warc.frames(io.BytesIO(data[:cut])))
        assert got[-1][2] and len(got) <= 2
    bad = bytearray(data)
    bad[-3] ^= 1  # the checksum
    assert [bool(e) for *_, e in warc.frames(io.BytesIO(bytes(bad)))] == [False, True]
    assert list(warc.frames(io.BytesIO(b""))) == [] and list(warc.frames(io.BytesIO(b"not an archive")))[0][2]


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9", 1), "no WARC header"), (lambda r: r.replace(b"WARC-Date: ", b"X-Date: "), "lacks warc-date"), (lambda r: r[:-4], "Content-Length"), (lambda r: r + GOOD, "Content-Length"),
        (lambda r: r.replace(b"payload payload", b"payl0ad payload", 1), "block digest"), (lambda r: r.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A"), "payload digest"), (lambda r: r.replace(b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Date"), "not a header field"),
        (lambda r: r.replace(b"response\r\n", b"revisit\r\n", 1), "revisit without"),
    ],
)
def test_records_are_validated(change, said):
    assert warc.parse_record(GOOD)["payload"] == b"payload " * 50
    with pytest.raises(ValueError, match=said):
        warc.parse_record(change(GOOD))


def test_a_bad_record_is_a_row_and_the_rest_is_read(spark, tmp_path, folder):
    (tmp_path / "warc").mkdir()
    (tmp_path / "warc/a").write_bytes(archive(GOOD, GOOD[:-4], GOOD))
    got = warc.read(spark.createDataFrame([("a",)], "file string"), folder).collect()
    assert [r.error is None for r in got] == [True, False, True] and got[2].offset > got[1].offset > 0


def test_empty_table(spark):
    assert warc.query(spark.createDataFrame([], KIND)).count() == 0
