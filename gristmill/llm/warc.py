"""WARC archives compressed with Zstandard: a dictionary frame in front, then one frame for each record.

Writing. Each task writes its pages into archives of about ``MAX_BYTES`` in a folder that all executors share. An archive
begins with a skippable frame that holds the (compressed) dictionary; each record is a frame of its own with a checksum.
The dictionary is trained on a bounded sample (the first ``SAMPLE`` pages that Spark comes to, of ``SAMPLE_BYTES`` / 200 at
most each and ``SAMPLE_BYTES`` in all); a corpus too small to train on is written without one. What is read back doesn't
depend on it. Archives have random names and count only once the table of archives, which is
checkpointed, names them, so what a lost task left behind is never read.

Equal payloads (length and SHA-256) are written once: the record with the smallest page_id is the response, the others
revisit it without a payload, keep its digest and length, and refer to it. Groups are made of digests and ids only.

Reading. A task reads an archive as a stream, one frame at a time, so that it holds one record: the dictionary comes from
the leading skippable frame (compressed or not), other skippable frames are passed over. A record is checked for its
version line, its mandatory fields, Content-Length against the frame, the blank line behind it, and its block and payload
digests. What is wrong is a row with ``error`` and the offset; a bad record ends its frame only, a broken frame its archive.

Null html counts as empty. A null page_id is written as ``none``, revisits what has an id, and is a response if nothing in
its group has. Repeated rows of the smallest page_id are all responses: they are the same page. A null url gives no target.
Control characters and blanks in a url are percent-encoded, as a header can't hold them. A payload of any length is one
record, held whole. Empty table: no archives, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import durable, join_small, shared_dir

MAX_BYTES = 64 << 20
SAMPLE, SAMPLE_BYTES, DICT_BYTES = 1000, 8 << 20, 64 << 10
#: Fixed values of the two formats.
DICT_MAGIC, ZSTD_MAGIC, SKIPPABLE = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd", range(0x184D2A50, 0x184D2A60)
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 18
RECORD = "file string, offset long, record_type string, record_id string, date string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def filesystem(address: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", address))


# --- records -------------------------------------------------------------------------------------------------------


def record_bytes(record_id: str, url: str | None, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit of ``refers_to`` with the payload's digest and length only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), url)))
    if refers_to:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def header_fields(head: bytes) -> dict[str, str]:
    """Fields by lower-case name; lines that begin with a blank go on with the field before."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"not a header field: {line[:60]!r}")
        out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def parse_record(data: bytes) -> dict:
    """The record that fills a frame; ValueError says what is wrong with it."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, _, head = head.partition(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", version) or not blank:
        raise ValueError("no WARC header")
    f = header_fields(head)
    if lacking := [k for k in NEEDED if k not in f]:
        raise ValueError(f"lacks {', '.join(lacking)}")
    if not re.fullmatch(r"\d+", f["content-length"]):
        raise ValueError("bad Content-Length")
    size = int(f["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the frame has {len(rest) - 4}")
    block = rest[:size]
    digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
    if (said := f.get("warc-block-digest")) and said != f"sha1:{sha1_base32(block)}":
        raise ValueError("block digest differs")
    payload, length = block, size
    if f.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        own = header_fields(http.partition(b"\r\n")[2])
        length = int(own["content-length"]) if own.get("content-length", "").isdigit() else len(payload)
    if f["warc-type"] == "revisit":
        payload = None
        if "warc-refers-to" not in f or not digest:
            raise ValueError("a revisit without what it refers to")
    else:
        if length != len(payload):
            raise ValueError(f"the payload's length is {length}, the record has {len(payload)}")
        if digest and digest != sha1_base32(payload):
            raise ValueError("payload digest differs")
    return {
        "record_type": f["warc-type"], "record_id": f["warc-record-id"].strip("<>"), "date": f["warc-date"], "target_uri": f.get("warc-target-uri"), "refers_to": f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None,
        "payload_digest": digest or sha1_base32(payload), "payload_bytes": length, "payload": payload,
    }


# --- frames --------------------------------------------------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICT_MAGIC + len(packed).to_bytes(4, "little") + packed


def frames(stream) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, content, error) of each frame of an archive; a frame that can't be decoded is the last."""
    held, at, dictionary, ended = bytearray(), 0, None, False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            part = stream.read(max(CHUNK, n - len(held)))
            ended = not part
            held.extend(part)
        return len(held) >= n

    def drop(n: int) -> None:
        nonlocal at
        del held[:n]
        at += n

    while fill(1):
        if not fill(4):
            yield at, None, "cut off in a frame's magic number"
            return
        if int.from_bytes(held[:4], "little") in SKIPPABLE:
            if not fill(8) or not fill(8 + int.from_bytes(held[4:8], "little")):
                yield at, None, "cut off in a skippable frame"
                return
            size = int.from_bytes(held[4:8], "little")
            if held[:4] == DICT_MAGIC and at == 0:
                data = bytes(held[8 : 8 + size])
                try:
                    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(data) if data[:4] == ZSTD_MAGIC else data)
                except zstandard.ZstdError as e:
                    yield at, None, f"dictionary: {e}"
                    return
            drop(8 + size)
            continue
        one, parts, begin = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), [], at
        try:
            while not one.eof:
                if not fill(1):
                    yield begin, None, "cut off in a frame"
                    return
                n = len(held)
                parts.append(one.decompress(bytes(held)))
                rest = one.unused_data if one.eof else b""
                drop(n - len(rest))
        except zstandard.ZstdError as e:
            yield begin, None, str(e)
            return
        yield begin, b"".join(parts), None


# --- Spark ---------------------------------------------------------------------------------------------------------


def trained(pages: DataFrame, size: int = DICT_BYTES) -> bytes:
    """A dictionary for the pages' records; empty if the sample is too small to train on."""
    rows = pages.select("page_id", "html").where(F.octet_length("html").between(1, SAMPLE_BYTES // 200)).limit(SAMPLE).collect()
    samples, total = [], 0
    for r in rows:  # 42 MB at most
        data = record_bytes(f"urn:page:{r.page_id}", "", r.html.encode())
        if total + len(data) > SAMPLE_BYTES:
            break
        samples.append(data)
        total += len(data)
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 20)), samples).as_bytes() if len(samples) >= 10 else b""
    except zstandard.ZstdError:
        return b""


def referred(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and first: the smallest page_id with an equal payload of ``least_bytes`` or more, where another row has it."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    key = F.struct(F.unhex(F.sha2("payload", 256)).alias("digest"), F.octet_length("payload").alias("size"))
    ids = page.where(F.octet_length("payload") >= least_bytes).select(key.alias("key"), "page_id")
    repeated = durable(ids.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("key.*", "first"))
    keyed = page.select("*", F.unhex(F.sha2("payload", 256)).alias("digest"), F.octet_length("payload").alias("size"))
    return join_small(keyed, repeated, ["digest", "size"], "left").select("page_id", "url", "payload", "first")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, max_bytes: int = MAX_BYTES, level: int = 3) -> DataFrame:
    """Archive ``pages(page_id, url, html)``; returns (file, records, bytes) for each archive, checkpointed."""
    dictionary = trained(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        code = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        out, name, size, records = None, "", 0, 0

        def told() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

        for b in batches:
            for page_id, url, payload, first in zip(*(b.column(c) for c in ("page_id", "url", "payload", "first"))):
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}")
                    if dictionary:
                        size += out.write(dictionary_frame(dictionary))
                me, of = page_id.as_py(), first.as_py()
                record = record_bytes(f"urn:page:{'none' if me is None else me}", url.as_py(), payload.as_py(), f"urn:page:{of}" if of is not None and of != me else None)
                size += out.write(code.compress(record))
                records += 1
                if size >= max_bytes:
                    yield told()
                    out = None
        if out is not None:
            yield told()

    return durable(referred(pages, least_bytes).mapInArrow(run, "file string, records long, bytes long"))


def read(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of ``archives(file)`` in ``folder``, in columns ``RECORD``; ``payloads`` = False leaves them null once checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}") as stream:
                    for offset, data, error in frames(stream):
                        row = {"file": name, "offset": offset, "error": error}
                        if data is not None:
                            try:
                                row |= parse_record(data)
                            except ValueError as e:
                                row["error"] = str(e)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += 500 + len(row.get("payload") or b"")
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in RECORD.split(", ")))

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[t]) for c, t in zip(names, types)], names=list(names))

    return archives.select("file").mapInArrow(run, RECORD)


def query(pages: DataFrame) -> DataFrame:
    """Write all pages into archives, read these back, and say what is in them; a record that isn't whole ends the query."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = write(pages, folder)
    records = read(archives.repartition(max(1, archives.count())), folder, payloads=False)
    page = lambda of: F.nullif(F.regexp_extract(of, r"^urn:page:(\d+|-\d+)$", 1), F.lit("")).cast("long")
    whole = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(" ", "file", "offset", "error")).cast("string"))
    return records.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", whole.alias("record_type"), page(F.col("refers_to")).alias("refers_to"))
