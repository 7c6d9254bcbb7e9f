"""WARC archives of page payloads, written and read as a stream of chunks.

Payloads become rows of a record id and chunk number, of at most ``CHUNK``
characters. A payload of one chunk is one record; longer ones continue in
segment records, as the format provides, each carrying the digest of the payload
up to its end. Neither writer nor reader holds more of a payload than a chunk.

Archives are written by Spark's text writer with the format's record end as line
end, one gzip stream a file; so they go to any store Spark writes, and a lost
task is simply written again. Such files are not split when read, so each is
parsed from its start as a stream, by content lengths: a payload may hold record
ends and record heads itself.

Equal payloads of at least ``least_bytes`` bytes are stored once: the row with
the largest ``page_id`` is the response, all others revisit it.

**Defined results.** A null payload is an empty one. A null url has no target
field. Rows repeated with one ``page_id`` are records of their own; the last of
them is the response. A null ``page_id`` counts as the smallest. A payload that
doesn't fit its digest when read raises an error. An empty table gives no rows.
Other columns are not looked at. ``pages`` must give its rows in the same order
each time, as files do: a row's place tells equal rows apart.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import staged
from contractflow.session import scratch_path

#: Characters of a chunk at most.
CHUNK = 65_536
DATE = "2026-01-01T00:00:00Z"
END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(raw).decode("ascii")


def _placed(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url",
        F.coalesce("html", F.lit("")).alias("html"))


def record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(row, page_id, digest, payload_bytes, first, first_row): the response that each row is or revisits."""
    facts = staged(_placed(pages).select(
        "row", "page_id", F.sha1(F.col("html").cast("binary")).alias("digest"),
        F.octet_length("html").cast("long").alias("payload_bytes")), "payloads")
    firsts = staged(
        facts.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "row")).alias("first")), "responses")
    return facts.join(firsts, ["digest", "payload_bytes"], "left").select(
        "row", "page_id", "digest", "payload_bytes", F.coalesce("first.row", "row").alias("first_row"),
        F.when(F.col("first").isNull(), F.col("page_id")).otherwise(F.col("first.page_id")).alias("first"))


def chunk_table(pages: DataFrame, types: DataFrame) -> DataFrame:
    """(row, page_id, url, digest, payload_bytes, first, first_row, chunks, chunk_no, chunk), in order of row and chunk.

    Rows that revisit have one empty chunk.
    """
    held = _placed(pages).select("row", "url", "html").join(staged(types, "records"), "row")
    cut = F.regexp_extract_all("html", F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))
    pieces = F.when((F.col("first_row") == F.col("row")) & (F.col("html") != ""), cut).otherwise(F.array(F.lit("")))
    whole = held.withColumn("pieces", pieces).drop("html").sortWithinPartitions("row")
    return whole.select(
        "row", "page_id", "url", "digest", "payload_bytes", "first", "first_row",
        F.size("pieces").alias("chunks"), F.posexplode("pieces").alias("chunk_no", "chunk"))


def _urn(page_id, row) -> str:
    return f"<urn:page:{page_id}:{row}>"


def _field(text: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def write_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows to WARC records (without their record end), carrying the digest from chunk to chunk."""
    running = hashlib.sha1()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            data, number, digest = r["chunk"].encode("utf-8"), r["chunk_no"], base32_sha1(bytes.fromhex(r["digest"]))
            own, head = _urn(r["page_id"], r["row"]), [f"WARC-Date: {DATE}"]
            if r["url"] is not None and not number:
                head.append(f"WARC-Target-URI: {_field(r['url'])}")
            if r["first_row"] != r["row"]:
                kind, block = "revisit", b""
                head += [f"WARC-Record-ID: {own}", f"WARC-Refers-To: {_urn(r['first'], r['first_row'])}",
                         f"WARC-Profile: {REVISIT}", f"WARC-X-Payload-Length: {r['payload_bytes']}",
                         f"WARC-Payload-Digest: sha1:{digest}"]
            else:
                http = b""
                if number == 0:
                    running = hashlib.sha1()
                    kind = "response"
                    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                            f"Content-Length: {r['payload_bytes']}\r\n\r\n").encode()
                    head += [f"WARC-Record-ID: {own}", f"WARC-Payload-Digest: sha1:{digest}",
                             "Content-Type: application/http; msgtype=response"]
                else:
                    kind = "continuation"
                    head += [f"WARC-Record-ID: {own[:-1]}:{number}>", f"WARC-Segment-Origin-ID: {own}"]
                running.update(data)
                if r["chunks"] > 1:
                    head += [f"WARC-Segment-Number: {number + 1}",
                             f"WARC-X-Running-Digest: sha1:{base32_sha1(running.digest())}"]
                    if number + 1 == r["chunks"]:
                        head.append(f"WARC-Segment-Total-Length: {r['payload_bytes']}")
                block = http + data
            lines = "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", *head, f"Content-Length: {len(block)}"])
            out.append(lines + "\r\n\r\n" + block.decode("utf-8"))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


class Reader:
    """Parses one archive fed in pieces; keeps counters and digests, never a payload."""

    def __init__(self):
        self.pending, self.state, self.left = b"", "head", 0
        self.head: dict[str, str] = {}
        self.http = False
        self.record: dict | None = None
        self.running = hashlib.sha1()
        self.length = 0

    def feed(self, piece: bytes) -> Iterator[tuple]:
        data = self.pending + piece if self.pending else piece
        at = 0
        while True:
            if self.state == "head":
                end = data.find(END, at)
                if end < 0:
                    break
                self._begin(data[at:end].decode("utf-8"))
                at = end + len(END)
            elif self.state == "http":
                end = data.find(END, at)
                if end < 0:
                    break
                self.left -= end + len(END) - at
                at, self.state = end + len(END), "block"
            elif self.state == "block":
                part = data[at:at + self.left]
                self.running.update(part)
                self.length += len(part)
                at += len(part)
                self.left -= len(part)
                if self.left:
                    break
                self.state = "end"
            else:
                if len(data) - at < len(END):
                    break
                if data[at:at + len(END)] != END:
                    raise ValueError(f"no record end after {self.head.get('WARC-Record-ID')}")
                at, self.state = at + len(END), "head"
                yield from self._finish()
        self.pending = data[at:]

    def _begin(self, text: str) -> None:
        first, *lines = text.split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"not a record head: {first[:60]!r}")
        self.head = dict(line.split(": ", 1) for line in lines)
        self.left = int(self.head["Content-Length"])
        kind = self.head["WARC-Type"]
        if kind != "continuation":
            self.record, self.running, self.length = self.head, hashlib.sha1(), 0
        self.state = "http" if kind == "response" else "block"

    def _finish(self) -> Iterator[tuple]:
        head, record = self.head, self.record
        if "WARC-X-Running-Digest" in head and head["WARC-X-Running-Digest"] != f"sha1:{base32_sha1(self.running.digest())}":
            raise ValueError(f"chunk digest differs in {head['WARC-Record-ID']}")
        if "WARC-Segment-Number" in head and "WARC-Segment-Total-Length" not in head:
            return
        digest = record["WARC-Payload-Digest"].removeprefix("sha1:")
        page = _page(record["WARC-Record-ID"])
        if record["WARC-Type"] == "revisit":
            yield page, int(record["WARC-X-Payload-Length"]), digest, "revisit", _page(record["WARC-Refers-To"])
        else:
            if base32_sha1(self.running.digest()) != digest:
                raise ValueError(f"payload digest differs in {record['WARC-Record-ID']}")
            yield page, self.length, digest, "response", None

    def close(self) -> Iterator[tuple]:
        """The last record: a line reader keeps back the record end that ends the file."""
        if self.state == "end" and not self.pending:
            self.state = "head"
            yield from self._finish()
        if self.pending or self.state != "head":
            raise ValueError("the archive ends within a record")


def _page(urn: str) -> int | None:
    page = urn.split(":")[2]
    return None if page == "None" else int(page)


def read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of archives (value, file), each file's in order, to one row for each record."""
    reader, name = Reader(), None
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], columns)

    for batch in batches:
        found = []
        for piece, file in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
            if file == name:
                found.extend(reader.feed(END + piece.as_py()))
            else:
                found.extend(reader.close())
                reader, name = Reader(), file
                found.extend(reader.feed(piece.as_py()))
        yield out(found)
    yield out(list(reader.close()))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write one record for every row of ``pages`` to archives below ``path``."""
    records = chunk_table(pages, record_types(pages, least_bytes)).mapInArrow(write_records, "value string")
    records.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives below ``path``; payloads are checked against their digests."""
    pieces = spark.read.schema("value string").option("lineSep", END.decode()).text(path)
    return pieces.select("value", F.col("_metadata.file_path").alias("file")).mapInArrow(read_records, RESULT)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
