"""WARC archives: writing, normalising whole-file gzip streams, and reading through an offset index.

`write` puts a record for each row into archives of which each is one gzip stream over all its records (as careless
crawlers leave them). `normalise` inflates such a stream once from end to end, rewrites every record as a gzip member
of its own, and writes a sidecar index of offsets, so that any record can be read alone. `read` goes back from the
normalised archives and their indexes to rows.

Of records with equal payloads of at least `REVISIT_FROM` bytes, the one with the largest id is the response; the
others are revisit records, which carry no payload but its digest, its length and the response's id. Smaller payloads
are responses always. Equality is that of SHA-1 digests and lengths. The largest id per digest is found by partial
aggregation; digests that occur once, which is nearly all, never join anything.

Archives lie in a folder that driver and executors share (any that pyarrow.fs knows by its URI, or a plain path). File
names hold the task attempt that wrote them, and only the names that a committed attempt returns are read on, so lost
executors, repeated tasks and speculation can leave stray files but no wrong or half archive in the result.

A null payload counts as empty and a null url as the empty target. Rows with a null id or equal ids are records all the
same; among equal rows of the largest id, all are responses. Payloads may be of any length; one over `ARCHIVE` is an archive
alone. Columns besides id, url and payload take no part, whatever their names. An empty table writes no archive and reads back no row.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm import storage

REVISIT_FROM = 1000
#: Bytes of records, before compression, at which an archive is closed; one longer record is an archive alone.
ARCHIVE = 32 << 20
LEVEL = 1
#: Digests that occur more than once are broadcast up to this number of rows (about 40 bytes each), else joined by shuffle.
BROADCAST_ROWS = 200_000

#: Characters of a URL that a header shows as they are; all others, the percent sign among them, are escaped and come back.
_PLAIN = ":/?#[]@!$&()*+,;=-._~"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _files(folder: str) -> tuple[Callable, Callable]:
    """Opening for writing and for reading, by paths below folder."""
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")

    def local(path: str) -> str:
        return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")[1]

    def create(path: str):  # noqa: ANN202
        system.create_dir(local(path).rpartition("/")[0], recursive=True)
        return system.open_output_stream(local(path), compression=None)

    return create, lambda path: system.open_input_file(local(path))


def classified(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """pages with _digest (hex SHA-1), _bytes, _type and _refers_to."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    known = pages.withColumns({"_digest": F.sha1(body), "_bytes": F.octet_length(body).cast("long")})
    shared = known.where(F.col("_bytes") >= REVISIT_FROM).groupBy("_digest", "_bytes").agg(F.max(key).alias("_response"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    shared = storage.kept(shared, "warc-shared")
    side = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    joined = known.join(side, ["_digest", "_bytes"], "left")
    revisit = F.col("_response").isNotNull() & ~F.col(key).eqNullSafe(F.col("_response"))
    return joined.withColumns({"_type": F.when(revisit, "revisit").otherwise("response"), "_refers_to": F.when(revisit, F.col("_response"))}).drop("_response")


def record(page_id: int | None, url: str, kind: str, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    """One record of the WARC 1.1 format."""
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {quote(url, safe=_PLAIN)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if kind == "revisit" else payload
    head += ["Content-Type: text/html;charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}


def _number(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes all pages into single-stream archives; returns their table (archive, records), written already."""
    rows = classified(pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html")))
    rows = rows.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), "_digest", "_bytes", "_type", "_refers_to")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        create, _ = _files(folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        number, out, gz, size, count = 0, None, None, 0, 0
        done: list[tuple[str, int]] = []

        def name() -> str:
            return f"{folder}/crawl-{part:06d}-{number:04d}-{attempt}.warc.gz"

        def close() -> None:
            nonlocal out, gz, size, count, number
            out.write(gz.flush())
            out.close()
            done.append((name(), count))
            out, size, count, number = None, 0, 0, number + 1

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:2]] + [batch.column(2).cast(pa.binary())] + [c.to_pylist() for c in batch.columns[3:]]
            for i in range(batch.num_rows):
                page_id, address, digest, length, kind, refers = columns[0][i], columns[1][i], columns[3][i], columns[4][i], columns[5][i], columns[6][i]
                data = record(page_id, address, kind, digest, length, columns[2][i].as_py(), refers)
                if out is not None and size + len(data) > ARCHIVE:
                    close()
                if out is None:
                    out = create(name())
                    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(gz.compress(data))
                size += len(data)
                count += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"archive": pa.array([a for a, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})

    return storage.kept(rows.mapInArrow(put, "archive string, records long"), "warc-archives")


def inflated(stream, step: int = 1 << 20) -> Iterator[bytes]:  # noqa: ANN001
    """The records of a gzip file, of one member or of many, read once from end to end in bounded memory."""
    unzip, buffer, need, ended = zlib.decompressobj(31), bytearray(), None, False
    at = 0
    while True:
        while True:
            if need is None:
                head = buffer.find(b"\r\n\r\n", at)
                if head < 0:
                    break
                length = int(_headers(bytes(buffer[at:head]))["content-length"])
                need = head + 4 + length + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[at:need])
            at, need = need, None
        if at:
            del buffer[:at]
            need = None if need is None else need - at
            at = 0
        if ended:
            break
        data = stream.read(step)
        if not data:
            ended = True
            buffer += unzip.flush()
            continue
        while data:
            buffer += unzip.decompress(data)
            data = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
    if bytes(buffer).strip(b"\r\n\0"):
        raise ValueError("the archive ends within a record")


def _apart(archives: DataFrame) -> DataFrame:
    """The (written) table of archives with a partition for each, so that every archive is a task of its own."""
    return archives.repartitionByRange(max(archives.count(), 1), "archive")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites every archive with a member for each record and a sidecar index; returns (archive, index, records)."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        create, load = _files(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                final = f"{folder}/{name.rpartition('/')[2].removesuffix('.warc.gz')}-{attempt}.warc.gz"
                offset, lines = 0, []
                with load(name) as source, create(final) as out:
                    for data in inflated(source):
                        gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = gz.compress(data) + gz.flush()
                        head = _headers(data[: data.index(b"\r\n\r\n")])
                        lines.append(json.dumps({"offset": offset, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"], "url": head["warc-target-uri"], "digest": head["warc-payload-digest"]}))
                        out.write(member)
                        offset += len(member)
                with create(f"{final}.idx") as out:
                    out.write("".join(x + "\n" for x in lines).encode())
                yield pa.RecordBatch.from_pydict({"archive": [final], "index": [f"{final}.idx"], "records": [len(lines)]})

    return storage.kept(_apart(archives.select("archive")).mapInArrow(rewrite, "archive string, index string, records long"), "warc-normalised")


def read(normalised: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the normalised archives, each read through its index entry.

    Digests and lengths of responses are those of the payload bytes read; of revisits, those that the record states.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, load = _files(folder)
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with load(index) as f:
                    entries = [json.loads(x) for x in f.read().decode().splitlines()]
                out: list[tuple] = []
                with load(archive) as f:
                    for entry in entries:
                        f.seek(entry["offset"])
                        data = zlib.decompress(f.read(entry["length"]), 31)
                        head_end = data.index(b"\r\n\r\n")
                        head = _headers(data[:head_end])
                        body = data[head_end + 4 : head_end + 4 + int(head["content-length"])]
                        stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        kind = head["warc-type"]
                        digest = stated if kind == "revisit" else hashlib.sha1(body).hexdigest()
                        if digest != stated:
                            raise ValueError(f"{archive} at {entry['offset']}: the payload's digest isn't the stated one")
                        size = int(head["x-payload-length"]) if kind == "revisit" else len(body)
                        out.append((_number(head["warc-record-id"]), unquote(head["warc-target-uri"]), size, digest, kind, _number(head["warc-refers-to"]) if kind == "revisit" else None))
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _apart(normalised.select("archive", "index")).mapInArrow(parse, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes, normalises and reads back all pages, in new folders of the shared folder."""
    spark = pages.sparkSession
    raw, normal = storage.new_folder(spark, "warc-raw"), storage.new_folder(spark, "warc-normal")
    archives = write(pages, raw)
    done = normalise(archives, normal)
    storage.delete(spark, raw)
    return read(done, normal)
