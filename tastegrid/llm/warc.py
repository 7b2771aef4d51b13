"""WARC archives: a writer that dedupes payloads, and a sequential reader.

Every row becomes a record in a gzip member of its own. Of rows with equal payloads (by SHA-1) of at least
min_revisit_bytes the one with the smallest id is a response, the others are revisits that refer to it and carry
HTTP headers only. Each task writes the rows it reads, to files in the shared folder; a file is named after its
task attempt and counts only if the manifest, written when the attempt succeeded, names it.

The reader takes a file from start to end: it inflates one member at a time from small chunks, frames the block
by its content length, and checks the digests and that each member holds one whole record.

Cases: a null payload is empty; rows that repeat the smallest id are all responses; a null id or URL leaves its
field out; a long payload is deflated and inflated in pieces, and held whole only as a row; an empty table gives no archives and no rows; extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, parts, released, shared_dir, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6
CHUNK = 1 << 16
FILE_BYTES = 256 << 20
BATCH_BYTES = 1 << 20
#: Payloads that stand more than once, up to which their digests are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit")]
    if page_id is not None:
        fields.append(("WARC-Record-ID", f"<urn:x-page:{page_id}>"))
    fields.append(("WARC-Date", DATE))
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    out = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


def with_revisits(pages: DataFrame, *, id: str = "page_id", payload: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """pages with refers_to: the smallest id with an equal payload, null on that row itself. Digests and ids are
    shuffled, payloads stay where they are: few repeated digests go to them, many find their rows by id and digest,
    so that copies of one page are spread by their ids."""
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    light = pages.filter(F.length(data) >= min_revisit_bytes).select(F.col(id).alias("_id"), F.unhex(F.sha1(data)).alias("_digest"))
    firsts = written(light.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_digest", "_first"), "repeated")
    digest, same, first = fresh(pages, "_digest", "_same", "_first")
    keyed = pages.withColumn(digest, F.when(F.length(data) >= min_revisit_bytes, F.unhex(F.sha1(data))))
    if firsts.count() <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(firsts.toDF(same, first)), F.col(digest) == F.col(same), "left").drop(same)
        refers = F.when(F.col(first) < F.col(id), F.col(first))
    else:
        (number,) = fresh(pages, "_number")
        later = light.join(firsts, "_digest").filter(F.col("_first") < F.col("_id")).select("_id", "_digest", "_first").distinct().toDF(number, same, first)
        joined = keyed.join(later, (F.col(id) == F.col(number)) & (F.col(digest) == F.col(same)), "left").drop(number, same)
        refers = F.col(first)
    return joined.withColumn("refers_to", refers).drop(digest, first)


def write_archives(pages: DataFrame, *, id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder. Gives the manifest: path, n_records, n_bytes."""
    target = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = with_revisits(pages, id=id, payload=payload, min_revisit_bytes=min_revisit_bytes).select(F.col(id).cast("long"), url, payload, F.col("refers_to").cast("long"))

    def run(batches):
        store, folder = fs.FileSystem.from_uri(target)
        store.create_dir(folder, recursive=True)
        task, n, out, done = TaskContext.get(), 0, None, []

        def close():
            out.close()
            done.append((path, records, size))

        for batch in batches:
            for part in parts(batch, 2):
                for page_id, uri, text, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None:
                        path, records, size = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz", 0, 0
                        out, n = store.open_output_stream(path), n + 1
                    data = member(record(page_id, uri, (text or "").encode("utf-8", "surrogatepass"), first))
                    out.write(data)
                    records, size = records + 1, size + len(data)
                    if size >= FILE_BYTES:
                        close()
                        out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "n_records": [d[1] for d in done], "n_bytes": [d[2] for d in done]}, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    manifest = written(rows.mapInArrow(released(run), "path string, n_records long, n_bytes long"), "warc-manifest")
    return manifest.withColumn("store", F.lit(target))


class Corrupt(ValueError):
    """An archive breaks the format or a digest."""


def members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as its inflated pieces. A member must be read before the next."""
    pending = stream.read(CHUNK)
    while pending:

        def pieces():
            nonlocal pending
            inflate = zlib.decompressobj(31)
            while not inflate.eof:
                if not pending and not (pending := stream.read(CHUNK)):
                    raise Corrupt("the file ends inside a gzip member")
                piece = inflate.decompress(pending, CHUNK)
                pending = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if piece:
                    yield piece

        yield pieces()
        pending = pending or stream.read(CHUNK)


def _head(buffer: bytearray, pieces: Iterator[bytes]) -> list[str]:
    """Takes header lines up to the empty line off the buffer, reading on as needed."""
    while (end := buffer.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise Corrupt("a record ends inside its header")
        buffer += piece
    lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
    del buffer[: end + 4]
    return lines


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_record(pieces: Iterator[bytes], keep_payload: bool) -> dict:
    """One record from one member: fields, payload length and digests, all checked."""
    buffer = bytearray()
    lines = _head(buffer, pieces)
    if not lines[0].startswith("WARC/1."):
        raise Corrupt("a member does not begin with a record")
    fields = _fields(lines)
    left = int(fields["content-length"])
    block, payload, kept, seen, http = hashlib.sha1(), hashlib.sha1(), [], 0, bytearray()
    inner: dict[str, str] | None = None
    while left:
        if not buffer:
            piece = next(pieces, None)
            if piece is None:
                raise Corrupt("a record ends inside its block")
            buffer += piece
        part = bytes(buffer[:left])
        del buffer[: len(part)]
        left -= len(part)
        block.update(part)
        if inner is None:
            http += part
            if (end := http.find(b"\r\n\r\n")) < 0:
                continue
            inner, part = _fields(bytes(http[:end]).decode("latin-1").split("\r\n")), bytes(http[end + 4 :])
        payload.update(part)
        seen += len(part)
        if keep_payload:
            kept.append(part)
    for piece in pieces:
        buffer += piece
    if buffer != b"\r\n\r\n":
        raise Corrupt("a record is not followed by two line ends alone")
    if inner is None:
        raise Corrupt("a block has no HTTP header")
    if fields["warc-block-digest"] != f"sha1:{base32(block.digest())}":
        raise Corrupt("a block does not have its digest")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (fields["warc-payload-digest"] != f"sha1:{base32(payload.digest())}" or seen != int(inner["content-length"])):
        raise Corrupt("a payload does not have its digest or length")
    number = lambda k: int(fields[k].removeprefix("<urn:x-page:").removesuffix(">")) if k in fields else None
    return {
        "page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "payload_bytes": int(inner["content-length"]),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "record_type": fields["warc-type"],
        "refers_to": number("warc-refers-to"), "payload": b"".join(kept) if keep_payload and not revisit else None,
    }


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(manifest: DataFrame, *, keep_payload: bool = False) -> DataFrame:
    """A row per record of the manifest's archives; a broken archive fails the job."""
    n = max(1, manifest.count())
    spread = manifest.select("path", "store").repartition(min(n, 10_000), "path")

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for path, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, _ = fs.FileSystem.from_uri(target)
                with store.open_input_stream(path) as stream:
                    for pieces in members(stream):
                        rows.append(read_record(pieces, keep_payload))
                        held += 200 + len(rows[-1]["payload"] or b"")
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=RECORD)

    return spread.mapInArrow(released(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
