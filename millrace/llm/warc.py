"""WARC archives: write whole-file gzip streams, normalise them to one gzip member a record with an offset index, read back.

Archives are files in the shared folder, reached through ``pyarrow.fs`` by URI. A task writes files under names of its own
attempt and returns a manifest row for each; only files in a manifest are read, so a lost executor leaves nothing half done.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files, map_arrow, materialise, new_path, table

#: Payload bytes after which a task starts its next archive.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
WARC_DATE = "2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def safe(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_name(page_id) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(name: str | None) -> str | None:
    return None if name is None or name == "<urn:page>" else unquote(name[len("<urn:page:") : -1])


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the response's record and carries none."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {safe(url) if url else record_name(page_id)[1:-1]}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflate(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The text of a gzip file of one or many members, read once in bounded pieces."""
    unzip = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            out = unzip.decompress(data, 4 * chunk)
            if out:
                yield out
            data = unzip.unconsumed_tail
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(31)


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of an inflated stream; one record is held at a time."""
    buffer = bytearray()
    chunks = iter(chunks)
    more = lambda: (x := next(chunks, None)) is not None and (buffer.extend(x) or True)
    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer:
                    raise ValueError("the archive ends within a record")
                return
        head = bytes(buffer[:end]).decode()
        size = end + 4 + next(int(x.split(":", 1)[1]) for x in head.split("\r\n") if x.lower().startswith("content-length:")) + 4
        while len(buffer) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield bytes(buffer[:size])
        del buffer[:size]


def fields(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, v in named.items()}, rest[:-4]


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and ``first``: the least page_id of the records with this payload where several have it.

    Equal payloads are those of equal SHA-1 and length. Only digests that repeat are joined; Spark broadcasts their table where its file size is under the session's threshold.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    digest = F.concat_ws(":", F.sha1("payload"), F.length("payload"))
    repeated = rows.groupBy(digest.alias("digest")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    return rows.withColumn("of", digest).join(materialise(repeated, "repeated"), F.col("of") == F.col("digest"), "left").select("page_id", "url", "payload", "first")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write each partition's records as whole-file gzip streams; a manifest row (path, records) for each file."""

    def run(batches):
        out = zipper = path = None
        filled = count = 0

        def close():
            out.write(zipper.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

        for batch in batches:
            for page, url, payload, first in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if out is None:
                    path, filled, count = f"{folder}/whole-{uuid.uuid4().hex}.warc.gz", 0, 0
                    system, local = files(path)
                    system.create_dir(local.rpartition("/")[0], recursive=True)
                    out, zipper = system.open_output_stream(local, compression=None), zlib.compressobj(1, wbits=31)
                out.write(zipper.compress(record(page, url, payload, None if first is None or first == page else first)))
                filled, count = filled + len(payload), count + 1
                if filled >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialise(map_arrow(rows, run, "path string, records long"), "archives")


def normalise(archives: DataFrame, level: int = 6) -> DataFrame:
    """Inflate each archive's stream once and write every record as a gzip member of its own, with a sidecar index.

    The index has a line ``offset length record-id`` for each record. Manifest rows: path, index, records.
    """

    def run(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                system, local = files(source)
                path = source.replace("/whole-", f"/members-{uuid.uuid4().hex[:8]}-")
                target = files(path)[1]
                index, offset = [], 0
                with system.open_input_stream(local, compression=None) as stream, system.open_output_stream(target, compression=None) as out:
                    for raw in records(inflate(stream)):
                        zipper = zlib.compressobj(level, wbits=31)
                        member = zipper.compress(raw) + zipper.flush()
                        out.write(member)
                        index.append(f"{offset} {len(member)} {fields(raw)[0]['warc-record-id']}\n")
                        offset += len(member)
                with system.open_output_stream(target + ".idx", compression=None) as out:
                    out.write("".join(index).encode())
                yield pa.RecordBatch.from_pydict({"path": [path], "index": [path + ".idx"], "records": [len(index)]})

    parts = max(1, min(archives.count(), int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return materialise(archives.repartition(parts).mapInArrow(run, "path string, index string, records long"), "normalised")


def read_archives(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """Every record of normalised archives, read member by member at the index's offsets; a response's digest is made anew. Ids come back as ``id_type``."""

    def run(batches):
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, local = files(path)
                with system.open_input_stream(files(index)[1], compression=None) as stream:
                    entries = [x.split(" ") for x in stream.read().decode().splitlines()]
                rows: list[tuple] = []
                with system.open_input_file(local) as file:
                    for at, size, name in entries:
                        head, block = fields(zlib.decompress(file.read_at(int(size), int(at)), 31))
                        assert head["warc-record-id"] == name, (path, at)
                        length, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            length, digest = len(payload), payload_digest(payload)
                        rows.append((page_of(name), length, digest, head["warc-type"], page_of(head.get("warc-refers-to"))))
                        if len(rows) == 10_000:
                            yield made(rows)
                            rows = []
                yield made(rows)

    kinds = [("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

    parts = max(1, min(archives.count(), int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = archives.repartition(parts).mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_pages(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, keep: bool = False) -> DataFrame:
    """Write pages (page_id, url, html) to archives, normalise them, and return what reading them back gives.

    A null html is an empty payload; equal payloads, empty ones too, have one response, the record with the least
    page_id, and revisits. Null ids count as larger than any. Repeated rows of the least id are responses each.
    """
    folder = new_path(pages.sparkSession, "warc")
    whole = write_archives(with_first(pages), folder, archive_bytes)
    members = normalise(whole)
    read = materialise(read_archives(members, pages.schema["page_id"].dataType.simpleString()), "records")
    if not keep:
        path = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    return read


def op10_warc(spark, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))
