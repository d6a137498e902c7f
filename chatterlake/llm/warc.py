"""WARC archives of pages, read by index.

Each task writes the records of its pages to one archive, every record compressed by itself, and hands
on one index row per record: file, offset, length, URL, digest.  The index is a table; reading starts
from any selection of it, sorts the selection by file and offset, joins neighbouring records to one
byte range, and reads only those ranges.

Of records with the same large payload one is the response and the others revisit it, that is, carry
its digest and no payload.  Archive names hold the task's attempt, and only a committed attempt's index
rows are ever seen, so a lost or repeated task does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.llm.storage import stored

LEAST_REVISITED = 1_000  # bytes; smaller payloads are written each time
BROADCAST_DIGESTS = 200_000  # of about 60 bytes
SALTS = 64
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
NO_KEY = (1 << 128) - 1
INDEX = "key long, url string, record_type string, digest string, payload_bytes long, file string, offset long, length long"
TASK_BYTES = 32 << 20  # of archives that one task reads
RECORD = "key long, url string, record_type string, digest string, payload_bytes long, refers_to long, payload binary"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system a path names: file, hdfs, s3, gs and others, or the local one without a scheme."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=NO_KEY if key is None else key & ((1 << 64) - 1))}>"


def _key_of(record_id: str) -> int | None:
    number = uuid.UUID(record_id.strip("<>")[9:]).int
    return None if number == NO_KEY else number - (1 << 64) * (number >> 63)


def _header(first: str, fields: dict[str, str]) -> bytes:
    return "".join([f"{first}\r\n", *[f"{k}: {v}\r\n" for k, v in fields.items()], "\r\n"]).encode()


def record_bytes(key: int | None, url: str | None, payload: bytes, payload_bytes: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; ``digest`` is the payload's SHA-1 in hex.  A revisit has the HTTP header only."""
    http = _header("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(payload_bytes)})
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(key),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="!#$&'()*+,/:;=?@[]~%-._")
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers_to)}
    return _header("WARC/1.1", fields) + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; a payload that does not match its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    kind = fields["WARC-Type"]
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != length:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its header")
    url = fields.get("WARC-Target-URI")
    return {
        "key": _key_of(fields["WARC-Record-ID"]),
        "url": None if url is None else unquote(url),
        "record_type": kind,
        "digest": digest,
        "payload_bytes": length,
        "refers_to": _key_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _write_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        store, path = _opened(name)
        out, offset = None, 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None:
                        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    raw = record_bytes(r["key"], r["url"], r["payload"], r["payload_bytes"], r["digest"], r["refers_to"], r["revisit"])
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    packed = packer.compress(raw) + packer.flush()
                    out.write(packed)
                    kind = "revisit" if r["revisit"] else "response"
                    rows.append((r["key"], r["url"], kind, r["digest"], r["payload_bytes"], name, offset, len(packed)))
                    offset += len(packed)
                schema = _schema(INDEX)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in rows], schema)
        finally:
            if out is not None:
                out.close()

    return run


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, offset, length) in that order -> records, one read for each run of near neighbours."""
    waiting: list[tuple[str, int, int]] = []

    def read():
        store, path = _opened(waiting[0][0])
        first, last = waiting[0][1], max(o + n for _, o, n in waiting)
        with store.open_input_file(path) as file:
            data = file.read_at(last - first, first)
        rows = [parse_record(zlib.decompress(data[o - first : o - first + n], 31)) for _, o, n in waiting]
        waiting.clear()
        return pa.RecordBatch.from_pylist(rows, _schema(RECORD))

    for batch in batches:
        for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
            if waiting:
                same, first, end = waiting[0][0], waiting[0][1], waiting[-1][1] + waiting[-1][2]
                if file != same or offset > end + GAP_BYTES or offset + length - first > RANGE_BYTES:
                    yield read()
            waiting.append((file, offset, length))
    if waiting:
        yield read()


def _with_originals(rows: DataFrame) -> DataFrame:
    """Adds ``best``: the largest key among rows of the same large payload, where there are several.

    Up to ``BROADCAST_DIGESTS`` such payloads are looked up in place; more are joined, each digest
    spread over ``SALTS`` parts, as one payload may be that of very many pages.
    """
    large = rows.where(F.col("payload_bytes") >= LEAST_REVISITED)
    best = large.groupBy("digest").agg(F.max("key").alias("best"), F.count("*").alias("n")).where("n > 1").select("digest", "best")
    best = stored(best, "originals")
    if best.count() <= BROADCAST_DIGESTS:
        return rows.join(F.broadcast(best), "digest", "left")
    spread = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["digest", "salt"], "left").drop("salt")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages below ``folder`` and returns the index, one row per page.

    Null html is an empty payload.  Of equal payloads of ``LEAST_REVISITED`` bytes or more, the row with
    the largest key is the response; rows that share that key are all responses, and rows without a
    key revisit it.  A missing URL has no header field.  Other columns are not read; no rows give no
    archives and an empty index.
    """
    raw = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})
    rows = _with_originals(rows)
    revisit = (F.col("payload_bytes") >= LEAST_REVISITED) & F.col("best").isNotNull() & ~F.col("key").eqNullSafe(F.col("best"))
    rows = rows.withColumn("revisit", revisit)
    rows = rows.select(
        "key", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "payload_bytes", "digest",
        F.col("best").alias("refers_to"), "revisit",
    )
    return stored(rows.mapInArrow(_write_batches(folder), INDEX), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """The records of the given index rows, with their payloads: key, url, type, digest, length, refers_to."""
    places = index.select("file", "offset", "length")
    n_bytes = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-n_bytes // TASK_BYTES))  # the rows are few bytes, the records behind them many
    ordered = places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_read_batches, RECORD)
