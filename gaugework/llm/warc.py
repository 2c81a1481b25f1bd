"""WARC archives of page tables: written once per payload, indexed, and read by ranges.

Every task writes archives of its own into the shared folder, one gzip member per
record, and returns the index: archive, offset, length, URL and digest.  Only the index
of tasks that ended well is kept, so archives of lost attempts are never looked at.
Readers sort the wanted index rows by place and join neighbouring ranges into one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.staging import keep, own_folder

INDEX = (
    "archive string, offset long, length long, page_id long, url string, payload_digest string, "
    "payload_bytes long, record_type string, refers_to long"
)
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: A new archive begins beyond this size; ranges nearer than GAP are read together, up to READ.
ARCHIVE, GAP, READ = 1 << 30, 1 << 16, 8 << 20
DATE = "1970-01-01T00:00:00Z"
_URL_BREAKS = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(value: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hex digits, five at a time, make four base32 digits each."""
    digits = F.sha1(value)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _url(url: str | None) -> str:
    return _URL_BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:unknown"


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress(head.encode() + block + b"\r\n\r\n") + press.flush()


def _record(row: dict, date: str) -> bytes:
    body = (row["html"] or "").encode()
    revisit = row["first"] is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(row["page_id"])),
        ("WARC-Date", date), ("WARC-Target-URI", _url(row["url"])), ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if row["page_id"] is not None:
        fields.append(("WARC-Page-ID", str(row["page_id"])))
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(row["first"])), ("WARC-Refers-To-Target-URI", _url(row["first_url"])),
            ("WARC-Refers-To-Page-ID", str(row["first"])),
        ]
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return _member(fields, answer if revisit else answer + body)


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = open_folder(folder)
        disk.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        names = [f.split()[0] for f in INDEX.split(", ")]
        try:
            for whole in batches:
                for i in range(0, whole.num_rows, 256):
                    index = []
                    for row in whole.slice(i, 256).to_pylist():
                        if out is None or at > ARCHIVE:
                            if out:
                                out.close()
                            name = f"{uuid.uuid4().hex}.warc.gz"
                            out = disk.open_output_stream(f"{root}/{name}", compression=None)
                            info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                                            ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                            at = out.write(info)
                        member = _record(row, date)
                        out.write(member)
                        kind = "response" if row["first"] is None else "revisit"
                        index.append((name, at, len(member), row["page_id"], row["url"], row["digest"], row["size"], kind, row["first"]))
                        at += len(member)
                    form = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), form)], names)
        finally:
            if out:
                out.close()

    return run


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = DATE) -> tuple[str, DataFrame]:
    """Write a record per row of ``pages (page_id, url, html)``; the folder and the index.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the
    smallest ``page_id`` is a response and the others revisit it.  A null html is an
    empty payload.  Rows equal in id and payload are all written alike.  A row without
    id revisits the smallest id with its payload; where no row has one, all are
    responses.  A null URL is written as ``urn:unknown``.  Other columns are not read.
    """
    folder = folder or own_folder(pages.sparkSession, "warc")
    body = F.coalesce("html", F.lit(""))
    sized = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", base32_sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("size")
    )
    narrow = sized.select("page_id", "url", "digest", "size").filter(F.col("size") >= least_bytes)
    first = narrow.groupBy("digest").agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1 and f is not null").select("digest", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url"))
    again = narrow.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first", "first_url").distinct()
    rows = sized.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")
    return folder, keep(rows.mapInArrow(_writer(folder, date), INDEX), "warc-index")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if line)


def _parse(member: bytes) -> tuple:
    data = zlib.decompress(member, 31)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    answer, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(_fields(answer)["Content-Length"])
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != size:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        digest = found
    page_id, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
    return (
        int(page_id) if page_id else None, fields["WARC-Target-URI"], kind, int(refers) if refers else None, size, digest,
        payload if kind == "response" else None,
    )


def ranges(places: list[tuple[str, int, int]], gap: int = GAP, most: int = READ) -> list[list[int]]:
    """Runs of sorted (archive, offset, length) that one read serves."""
    runs: list[list[int]] = []
    for i, (archive, offset, length) in enumerate(places):
        if runs:
            start, before = places[runs[-1][0]], places[runs[-1][-1]]
            if start[0] == archive and offset - before[1] - before[2] <= gap and offset + length - start[1] <= most:
                runs[-1].append(i)
                continue
        runs.append([i])
    return runs


def read(folder: str, index: DataFrame) -> DataFrame:
    """The records that ``index`` names, each checked against its digest.

    A revisit has no payload of its own; ``refers_to`` names the response that has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = open_folder(folder)
        form = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in RECORDS.split(", ")]
        opened: tuple[str, pa.NativeFile] | None = None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))))
            for taken in ranges(places):
                archive, begin, _ = places[taken[0]]
                end = places[taken[-1]][1] + places[taken[-1]][2]
                if opened is None or opened[0] != archive:
                    opened = archive, disk.open_input_file(f"{root}/{archive}")
                data = opened[1].read_at(end - begin, begin)
                for i in range(0, len(taken), 256):
                    rows = [_parse(data[places[k][1] - begin : places[k][1] - begin + places[k][2]]) for k in taken[i : i + 256]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), form)], names)

    wanted = index.select("archive", "offset", "length").repartitionByRange("archive", "offset")
    return wanted.sortWithinPartitions("archive", "offset").mapInArrow(run, RECORDS)
