"""WARC archives: one gzip member for each record, written and read in sequence.

Writing: every task writes its rows as records to archives of a bounded size in a shared
folder, under a name of its own attempt, so a task that runs twice leaves a file that no
manifest lists. Of the rows with equal payloads of some size the one with the largest id is
the response; the others are revisits that carry no payload.

Reading: an archive is a stream of gzip members. Each is decompressed a piece at a time; the
WARC header ends at the empty line, and Content-Length says how many bytes of block follow.
The block's digest and the payload's digest are computed on the way and compared with the
header's. Damage ends the archive with a row that says what was wrong.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import cut, fresh_path

#: Payloads of fewer bytes are never revisits. Bytes at which an archive ends.
LEAST_REVISIT, ARCHIVE_BYTES = 1000, 256 << 20
PIECE = 64 << 10
#: A longer WARC or HTTP header is taken for damage.
HEADER_BYTES = 1 << 20
_DATE = "1970-01-01T00:00:00Z"
_ENDS = {"\r": "%0D", "\n": "%0A"}


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """One record; a revisit, without payload, if refers_to is given."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(_ENDS.get(c, c) for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_base32(block)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        own = f"{task.partitionId():06d}-{uuid.uuid4().hex}"
        out, files, written = None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    files.append([f"{own}-{len(files):04d}.warc.gz", 0, 0])
                    out = store.open_output_stream(f"{path}/{files[-1][0]}", compression=None)
                payload = (r["html"] or "").encode() if r["refers_to"] is None else None
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = member.compress(record(r["page_id"], r["url"], payload, r["size"], r["sha1"], r["refers_to"])) + member.flush()
                out.write(data)
                written += len(data)
                files[-1][1:] = [files[-1][1] + 1, written]
                if written >= archive_bytes:
                    out.close()
                    out, written = None, 0
        if out is not None:
            out.close()
        cols = list(zip(*files, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in cols[0]], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_revisit: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of pages; returns the manifest (archive, records, bytes).

    folder is a URI that Arrow's file systems can open on every executor. The payload is the
    html in UTF-8, null as empty. id_col must be a long. Rows that repeat an id are all written,
    each with the digests of its own html; they share a record's name. Rows with a null id are
    left out, as they can't be named. Of the rows with equal payloads of least_revisit bytes, that
    with the largest id is the response, and so are rows that repeat its id. An empty table gives
    an empty manifest.
    """
    rows = pages.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keys = cut(rows.select("page_id", F.sha1(data).alias("sha1"), F.octet_length(data).cast("long").alias("size")))
    first = keys.where(f"size >= {least_revisit}").groupBy("sha1", "size").agg(F.max("page_id").alias("head"), F.min("page_id").alias("least"))
    copied = first.where("head <> least").drop("least")
    named = keys.join(copied, ["sha1", "size"], "left").select("page_id", "sha1", "size", F.when(F.col("head") != F.col("page_id"), F.col("head")).alias("refers_to"))
    whole = rows.withColumn("sha1", F.sha1(data)).join(named.dropDuplicates(["page_id", "sha1"]), ["page_id", "sha1"]).select("page_id", "url", "html", "size", "sha1", "refers_to")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return cut(whole.mapInArrow(_write(folder, archive_bytes), "archive string, records long, bytes long"))


class Damaged(Exception):
    pass


class Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, stream: BinaryIO, held: bytes):
        self.stream, self.raw, self.out = stream, held, bytearray()
        self.zip = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.zip.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(PIECE)
            if not self.raw:
                raise Damaged("the archive ends within a member")
        try:
            self.out += self.zip.decompress(self.raw, PIECE)
        except zlib.error as e:
            raise Damaged(f"not gzip: {e}") from e
        self.raw = self.zip.unconsumed_tail or self.zip.unused_data
        return True

    def header(self) -> bytes:
        """Up to the first empty line."""
        while (at := self.out.find(b"\r\n\r\n")) < 0:
            if len(self.out) > HEADER_BYTES or not self._more():
                raise Damaged("a header doesn't end")
        head = bytes(self.out[:at])
        del self.out[: at + 4]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """n bytes, in pieces."""
        while n:
            if not self.out and not self._more():
                raise Damaged("a member ends within its block")
            piece = bytes(self.out[:n])
            del self.out[: len(piece)]
            n -= len(piece)
            if piece:
                yield piece

    def finish(self) -> bytes:
        """The rest, which must be the two line ends; returns the raw bytes of the next member."""
        while self._more():
            if len(self.out) > 4:
                break
        if bytes(self.out) != b"\r\n\r\n":
            raise Damaged("a member holds more than its record")
        return self.raw


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _number(urn: str | None) -> int | None:
    if urn is None or not urn.startswith("<urn:page:"):
        return None
    try:
        return int(urn[10:-1])
    except ValueError as e:
        raise Damaged("a record's name isn't a number") from e


def _hex(digest: str) -> str:
    try:
        return base64.b32decode(digest.removeprefix("sha1:")).hex()
    except ValueError as e:
        raise Damaged("a digest isn't base32") from e


def read_stream(stream: BinaryIO, keep_payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order; a last one with `error` where it is damaged."""
    held = stream.read(PIECE)
    while held:
        try:
            member = Member(stream, held)
            head = member.header()
            if not head.startswith(b"WARC/1."):
                raise Damaged("no WARC version line")
            f = _fields(head)
            if not f.get("content-length", "").isdigit():
                raise Damaged("no Content-Length")
            block = hashlib.sha1()
            left = int(f["content-length"])
            http = bytearray()
            pieces = member.take(left)
            payload, size, kept = hashlib.sha1(), 0, []
            in_http = f.get("content-type", "").startswith("application/http")
            for piece in pieces:
                block.update(piece)
                if in_http:
                    http += piece
                    at = http.find(b"\r\n\r\n")
                    if at < 0:
                        if len(http) > HEADER_BYTES:
                            raise Damaged("an HTTP header doesn't end")
                        continue
                    piece, in_http = bytes(http[at + 4 :]), False
                    del http[at + 4 :]
                payload.update(piece)
                size += len(piece)
                if keep_payload:
                    kept.append(piece)
            if "warc-block-digest" in f and _hex(f["warc-block-digest"]) != block.hexdigest():
                raise Damaged("the block's digest differs")
            kind = f.get("warc-type", "")
            said = _hex(f["warc-payload-digest"]) if "warc-payload-digest" in f else payload.hexdigest()
            if kind == "revisit":
                length = _fields(bytes(http)).get("content-length", "0")
                size = int(length) if length.isdigit() else 0
            elif said != payload.hexdigest():
                raise Damaged("the payload's digest differs")
            row = {
                "page_id": _number(f.get("warc-record-id")), "url": f.get("warc-target-uri"), "payload_bytes": size, "payload_digest": said,
                "record_type": kind, "refers_to": _number(f.get("warc-refers-to")), "payload": b"".join(kept) if keep_payload and kind != "revisit" else None, "error": None,
            }
            held = member.finish() or stream.read(PIECE)
            yield row
        except Damaged as e:
            yield {"error": str(e)}
            return


_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string()),
])


def _read(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for r in read_stream(stream, keep_payload):
                        rows.append(r)
                        held += len(r.get("payload") or b"")
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


def read_archives(manifest: DataFrame, keep_payload: bool = False, n_tasks: int | None = None) -> DataFrame:
    """The records of the archives that the manifest's column `archive` names.

    One task reads an archive from its start to its end; archives have a bounded size.
    Damaged archives give the records before the damage and a row with `error`.
    """
    spark = manifest.sparkSession
    n = n_tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string"
    return manifest.select("archive").repartition(n, "archive").mapInArrow(_read(keep_payload), kinds)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    out = read_archives(write_archives(pages, fresh_path(spark, "warc")))
    return out.where(F.assert_true(F.col("error").isNull(), F.col("error")).isNull()).drop("payload", "error")
