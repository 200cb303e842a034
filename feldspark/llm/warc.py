"""Web archives in Zstandard: one frame per record, with the dictionary in a leading skippable frame.

Writing: of pages with equal payloads the first is a response and the others are revisits that refer
to it. Tasks write archives of a bounded size into a shared folder and report what they finished;
files of attempts that were lost are not in that report and are never read.
Reading: every archive is a row of Spark's binary file source. Its records are decoded one frame
at a time, and their headers, lengths and digests are checked.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

DICTIONARY_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
"""An archive is closed after this many bytes of records."""
LEAST_SHARED = 100
"""Payloads of fewer bytes are always stored."""
OFTEN = 100_000
"""A payload that more pages share is told to its rows by broadcast; there are at most rows / OFTEN such payloads."""
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 8_192, 65_536
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {_DATE}", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page, url: str | None, payload: bytes, digest: str, first) -> bytes:
    """A response, or a revisit of ``first`` if that is another page."""
    revisit = first is not None and first != page
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", _name(page)),
        ("WARC-Target-URI", quote(url or "", safe="%/:?#[]@!$&'()*+,;=~-._")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Refers-To", _name(first)), ("WARC-Profile", _PROFILE)]
    return _record("revisit" if revisit else "response", headers, http if revisit else http + payload)


class _Archives:
    """Writes records to one archive after another and keeps a list of those finished."""

    def __init__(self, folder: str, dictionary: bytes):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.dictionary = dictionary
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True, write_content_size=True)
        self.finished: list[tuple[str, int]] = []
        self.out, self.bytes, self.records = None, 0, 0

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.file = f"part-{uuid.uuid4().hex}.warc.zst"
            self.out = self.store.open_output_stream(f"{self.folder}/{self.file}", compression=None)
            if self.dictionary:
                self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(self.dictionary)) + self.dictionary)
            self.out.write(self.compressor.compress(_record("warcinfo", [("WARC-Record-ID", f"<urn:file:{self.file}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
        self.out.write(self.compressor.compress(record))
        self.bytes += len(record)
        self.records += 1
        if self.bytes >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.finished.append((self.file, self.records))
            self.out, self.bytes, self.records = None, 0, 0


def _write_batches(folder: str, dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(folder, dictionary.value)
        for batch in batches:
            names = ("page", "url", "payload", "digest", "first")
            for row in zip(*[batch.column(c) for c in names]):
                archives.add(page_record(*[x.as_py() for x in row]))
        archives.close()
        files, counts = zip(*archives.finished) if archives.finished else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(counts, pa.int64())], names=["file", "records"])

    return run


def train_dictionary(payloads: DataFrame) -> bytes:
    """From the beginnings of at most about SAMPLE_ROWS payloads drawn by hash; empty if they are too few."""
    n = payloads.count()
    share = min(1.0, SAMPLE_ROWS / n) if n else 0
    drawn = payloads.where(F.pmod(F.xxhash64("payload"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.select(F.expr(f"substring(payload, 1, {SAMPLE_BYTES})").alias("p")).limit(2 * SAMPLE_ROWS).collect()
    samples = sorted(bytes(r["p"]) for r in rows if len(r["p"]) >= 8)
    if len(samples) < 16 or sum(map(len, samples)) < 4 * DICTIONARY_BYTES:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for every row and return ``file`` and ``records`` of each archive in ``folder``.

    The payload is the text in UTF-8; null is empty. Of equal payloads of at least LEAST_SHARED bytes the row
    with the smallest id is a response, as are rows that repeat that id; the others revisit it. Smaller ones are
    always responses, as are groups without an id. Null and odd addresses are written percent-encoded. Other columns
    are ignored; an empty table writes no file.
    """
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = cut_lineage(shared.where("n > 1"))
    often = shared.where(F.col("n") > OFTEN)
    rare = shared.where(F.col("n") <= OFTEN).select(F.col("digest").alias("key"), "first")
    dictionary = pages.sparkSession.sparkContext.broadcast(train_dictionary(rows))
    if often.isEmpty():
        marked = rows.withColumn("key", F.col("digest")).join(rare, "key", "left")
    else:
        held = F.broadcast(often.select("digest", F.col("first").alias("told")))
        # Rows that know their first page already are dealt by themselves, not by their payload.
        key = F.when(F.col("told").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page", "url").cast("string")))
        dealt = rows.join(held, "digest", "left").withColumn("key", key)
        marked = dealt.join(rare, "key", "left").withColumn("first", F.coalesce("told", "first"))
    files = marked.select("page", "url", "payload", "digest", "first").mapInArrow(_write_batches(folder, dictionary), "file string, records bigint")
    return cut_lineage(files)


def frames(data: bytes) -> Iterator[bytes]:
    """Contents of the frames of an archive, with the dictionary of the leading skippable frame if there is one."""
    view, at, dictionary = memoryview(data), 0, None
    if len(view) >= 8 and struct.unpack("<I", view[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", view[4:8])[0]
        held = bytes(view[8 : 8 + size])
        if len(held) != size:
            raise ValueError("the dictionary frame is cut short")
        if held[:4] == zstandard.FRAME_HEADER:
            held = zstandard.ZstdDecompressor().decompress(held, max_output_size=1 << 26)
        dictionary, at = zstandard.ZstdCompressionDict(held), 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at >= 8 and view[at + 1 : at + 4] == b"\x2a\x4d\x18" and 0x50 <= view[at] <= 0x5F:
            at += 8 + struct.unpack("<I", view[at + 4 : at + 8])[0]
            continue
        frame, out = decoder.decompressobj(), io.BytesIO()
        while not frame.eof:
            part = view[at : at + (1 << 16)]
            if not len(part):
                raise ValueError("the last frame is cut short")
            out.write(frame.decompress(part))
            at += len(part)
        at -= len(frame.unused_data)
        yield out.getvalue()


def parse(record: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Headers by lower-case name, the block, and what is wrong with them, if anything."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not gap or not lines[0].startswith("WARC/1."):
        return headers, b"", "no WARC header"
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in headers]
    if missing:
        return headers, b"", f"no {missing[0]}"
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return headers, b"", "wrong length"
    return headers, rest[:-4], None


def _page_of(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def page_of_record(record: bytes) -> dict | None:
    """The row of a response or revisit; None for other kinds of record."""
    headers, block, problem = parse(record)
    kind = headers.get("warc-type")
    if problem is None and kind not in ("response", "revisit"):
        return None
    row = {"page_id": _page_of(headers.get("warc-record-id")), "record_type": kind, "refers_to": _page_of(headers.get("warc-refers-to")),
           "url": headers.get("warc-target-uri"), "payload": None, "payload_bytes": None, "payload_digest": None, "problem": problem}
    if problem:
        return row
    http, gap, payload = block.partition(b"\r\n\r\n")
    lengths = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if not gap or len(lengths) != 1 or not lengths[0].isdigit():
        return row | {"problem": "no payload length"}
    size = int(lengths[0])
    if kind == "response":
        if len(payload) != size:
            return row | {"problem": "wrong payload length"}
        if hashlib.sha256(payload).hexdigest() != digest:
            return row | {"problem": "wrong payload digest"}
        row["payload"] = payload
    elif payload or row["refers_to"] is None:
        return row | {"problem": "not a revisit"}
    return row | {"payload_bytes": size, "payload_digest": digest}


_TYPES = {"page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary(),
          "payload_bytes": pa.int64(), "payload_digest": pa.string(), "problem": pa.string()}


def _read_batches(payloads: bool, counted: bool):
    wanted = [c for c in _TYPES if payloads or c != "payload"]

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _TYPES[c]) for c in wanted], names=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected = batch.column("records").to_pylist() if counted else [None] * batch.num_rows
            for content, records in zip(batch.column("content"), expected):
                rows, held, seen = [], 0, 0
                for record in frames(content.as_py()):
                    row = page_of_record(record)
                    if row is not None:
                        if counted and row["problem"]:
                            raise ValueError(f"record of page {row['page_id']}: {row['problem']}")
                        seen += 1
                        rows.append(row)
                        held += len(record) if payloads else 0
                    if len(rows) >= 1000 or held > 1 << 22:
                        yield out(rows)
                        rows, held = [], 0
                if counted and seen != records:
                    raise ValueError(f"an archive holds {seen} records, not the {records} written")
                yield out(rows)

    return run


def read(spark: SparkSession, folder: str, files: DataFrame | None = None, payloads: bool = True, strict: bool = False) -> DataFrame:
    """Responses and revisits of the archives in ``folder``, or of those that ``files`` names.

    ``problem`` says what is wrong with a record, else null. A frame that cannot be decoded is an error. With
    ``strict``, which needs ``files`` and their ``records``, so are a record with a problem, an archive that holds more or fewer
    records than were written, and a missing archive. A null payload was written as an empty one; rows of equal ids are all
    returned; a folder or ``files`` without archives gives no rows.
    """
    if strict and files is None:
        raise ValueError("strict reading needs the list of files")
    columns = "page_id bigint, record_type string, refers_to bigint, url string, payload binary, payload_bytes bigint, payload_digest string, problem string"
    if not payloads:
        columns = columns.replace("payload binary, ", "")
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    wanted = ["content", "records"] if strict else ["content"]
    if files is not None:
        named = held.withColumn("file", F.element_at(F.split("path", "/"), -1))
        if strict:
            # Names only: contents are not read for this.
            lost = files.select("file").join(named.select("file"), "file", "left_anti").take(1)
            if lost:
                raise ValueError(f"archive {lost[0]['file']} is missing")
            held = named.join(files.select("file", "records"), "file")
        else:
            held = named.join(files.select("file"), "file", "left_semi")
    return held.select(*wanted).mapInArrow(_read_batches(payloads, strict), columns)
