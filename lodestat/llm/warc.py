"""WARC archives: a writer of gzip members, one for each record, and a splittable reader.

The reader's tasks take byte ranges of the archives. A task looks for the gzip magic in its range, takes a place for a
member when the header that it decodes to is that of a WARC record, and owns the records that start inside its range,
to the end of the last one, which may lie beyond. From a record it goes on to the next without searching: what follows
a record, also the last one it owns, must be a record or the end of the file, and a record must decode to its end, or
the archive is damaged, which is an error. Splits are dealt to as many tasks as there are splits (MAX_TASKS at most).

Archives lie in the shared folder; they are opened with pyarrow's file systems, so any of its URIs will do. A task
writes to a name of its own and renames the file when it is whole, so that a task that runs again does no harm.

Verdicts are found on narrow rows and carried back by page, so that a common payload does not gather its pages.

Payloads: the html in UTF-8, null as empty. Of equal payloads of MIN_REVISIT bytes or more, the page with the largest
id has a response record, the others revisits of it (a null id is smaller than all; if no page has an id, all are
responses). Repeated rows: equal rows of one id are responses of their own. A table without rows has no archives and
gives no rows. Very long payloads are read whole. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shared_folder

MIN_REVISIT = 1000
MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES, READ_BYTES = 16 << 20, 1 << 20
MAX_TASKS = 100_000
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    revisit = refers_to is not None
    name = "none" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {url}"] if url and not any(c in url for c in "\r\n") else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    pack = zlib.compressobj(6, wbits=31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n") + pack.flush()


def parse(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a response's payload is held against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    page = lambda key: None if key not in fields or fields[key].endswith(":none>") else int(fields[key].rsplit(":", 1)[1][:-1])
    size, kind = int(fields["Content-Length"]), fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if len(rest) != size + 4 or kind == "response" and (hashlib.sha1(rest[:size]).hexdigest() != digest or size != int(fields["X-Payload-Length"])):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return page("WARC-Record-ID"), int(fields["X-Payload-Length"]), digest, kind, page("WARC-Refers-To")


def with_verdicts(pages: DataFrame, id_column: str = "page_id", html: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """The pages' ids, urls and payloads with digest and refers_to."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.col("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    large = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    again = large.distinct().join(first, "digest").where(~F.col("refers_to").eqNullSafe(F.col("page_id")))
    of = [F.coalesce("page_id", F.lit(0)).alias("_id"), F.col("page_id").isNull().alias("_none"), F.col("digest")]
    return rows.select("*", *of[:2]).join(again.select(*of, "refers_to"), ["_id", "_none", "digest"], "left").drop("_id", "_none")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes an archive for each partition; (path, bytes) of each, saved."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}"
        size = 0
        with files.open_output_stream(f"{name}.tmp") as out:
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    known = lambda x: None if pd.isna(x) else int(x)
                    size += out.write(record_bytes(known(page_id), url, html.encode("utf-8", "surrogatepass"), digest, known(refers_to)))
        files.move(f"{name}.tmp", f"{name}.warc.gz")
        if size:
            yield pd.DataFrame({"path": [f"{name}.warc.gz"], "bytes": [size]})

    return saved(rows.select("page_id", "url", "html", "digest", "refers_to").mapInPandas(write, "path string, bytes long"))


class Window:
    """Bytes of a file from `start` on, read as far as asked for."""

    def __init__(self, file, start: int, size: int):
        self.file, self.base, self.size, self.data = file, start, size, b""

    def upto(self, end: int) -> None:
        have = self.base + len(self.data)
        if end > have and have < self.size:
            self.data += self.file.read_at(min(max(end - have, READ_BYTES), self.size - have), have)

    def drop(self, start: int) -> None:
        self.data, self.base = self.data[start - self.base :], start


def starts_record(window: Window, at: int) -> bool:
    """Whether a member starts at this place whose header decodes to that of a record."""
    unpack = zlib.decompressobj(wbits=31)
    out, pos = bytearray(), at
    try:
        while not unpack.eof and b"\r\n\r\n" not in out:
            window.upto(pos + 4096)
            part = window.data[pos - window.base : pos - window.base + 4096]
            if not part:
                return False
            out += unpack.decompress(part)
            pos += len(part)
            if len(out) >= 10 and not out.startswith(b"WARC/"):
                return False
    except zlib.error:
        return False
    return out.startswith(b"WARC/")


def member_at(window: Window, at: int) -> tuple[bytes, int]:
    """The member that starts at a place, whole, and where it ends."""
    unpack = zlib.decompressobj(wbits=31)
    out, pos = [], at
    try:
        while not unpack.eof:
            window.upto(pos + 4096)
            part = window.data[pos - window.base : pos - window.base + READ_BYTES]
            if not part:
                raise ValueError(f"record at {at} is cut short")
            out.append(unpack.decompress(part))
            pos += len(part)
    except zlib.error as error:
        raise ValueError(f"record at {at} is damaged") from error
    return b"".join(out), pos - len(unpack.unused_data)


def records_between(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records of members that start in [start, end)."""
    window, at, found = Window(file, start, size), start, start == 0
    while not found and at < end:
        window.upto(min(size, at + READ_BYTES))
        magic = window.data.find(MAGIC, at - window.base)
        if magic < 0:
            at = max(at + 1, window.base + len(window.data) - len(MAGIC) + 1)
            if window.base + len(window.data) >= size:
                return
            window.drop(at)
        else:
            at = window.base + magic
            found = at < end and starts_record(window, at)
            at += not found
    while found and at < size:
        if not starts_record(window, at):
            raise ValueError(f"no record at {at}, where one should start")
        if at >= end:
            return
        record, at = member_at(window, at)
        yield record
        window.drop(at)


def read_archives(archives: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each record of the archives (path, bytes)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"], batch["start"]):
                with files.open_input_file(path) as file:
                    rows = []
                    for record in records_between(file, int(size), int(start), min(int(size), int(start) + split_bytes)):
                        rows.append(parse(record))
                        if len(rows) >= 5000:
                            yield _table(rows)
                            rows = []
                    if rows:
                        yield _table(rows)

    splits = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    tasks = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return splits.repartition(min(int(tasks), MAX_TASKS)).mapInPandas(read, RECORD)


def _table(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, id_column: str = "page_id", html: str = "html", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes archives of the pages and reads them back: a row for each record."""
    folder = shared_folder(pages.sparkSession) + "-warc"
    return read_archives(write_archives(with_verdicts(pages, id_column, html), folder), folder, split_bytes)
