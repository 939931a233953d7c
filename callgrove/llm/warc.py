"""Operator 7: WARC archives, one gzip member per record, and a sequential reader.

Writing: records with equal payloads keep one full response, that of the largest page_id; the others become revisit
records that name it and keep only the HTTP head. Reading: one pass over the file with incremental decompression, one
member at a time; the content length frames each record, and block and payload digests are verified.

Defined results: a null html is the empty payload; a null url becomes an empty target; null page_ids count as smaller than
all others (and refer to nothing if no other page has the payload); rows that repeat the largest page_id with the same
payload are all responses; payloads shorter than min_bytes are always responses; an empty table gives no records; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove.llm.common import make_folder, new_folder, opened, put_file, sized, written

#: Compressed bytes at which an archive is closed, and that the reader takes at a time.
ARCHIVE, READ = 64 << 20, 1 << 16
#: Payloads of several pages up to which their table is broadcast (some 120 bytes each); more are joined by shuffling.
BROADCAST_GROUPS = 300_000
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WHEN = "2020-01-01T00:00:00Z"
FIELDS = "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record where refers_to is given."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {WHEN}", "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    lines += [f"Page-ID: {page_id}"] * (page_id is not None)
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zip_.compress(data) + zip_.flush()


def members(file) -> Iterator[Iterator[bytes]]:
    """For each gzip member the pieces of its plain bytes; a member must be taken to its end before the next."""
    rest = file.read(READ)
    while rest:
        unzip = zlib.decompressobj(31)
        state = {"rest": rest}

        def pieces(unzip=unzip, state=state) -> Iterator[bytes]:
            given = state["rest"]
            while not unzip.eof:
                if not given:
                    given = file.read(READ)
                    if not given:
                        raise ValueError("the archive ends inside a gzip member")
                yield unzip.decompress(given, READ)
                given = unzip.unconsumed_tail
            state["rest"] = unzip.unused_data or file.read(READ)

        yield pieces()
        rest = state["rest"]


def head_of(pieces: Iterator[bytes], held: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields up to the empty line, and the bytes taken beyond it."""
    while (at := held.find(b"\r\n\r\n")) < 0:
        more = next(pieces, None)
        if more is None:
            raise ValueError("a record ends inside its header")
        held += more
    lines = held[:at].decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, held[at + 4 :]


def read_records(file, with_payload: bool = False) -> Iterator[dict]:
    """Records of an archive, in order; holds a piece of a payload at a time unless payloads are asked for."""
    for pieces in members(file):
        fields, held = head_of(pieces, b"")
        length, block, body = int(fields["content-length"]), hashlib.sha1(), hashlib.sha1()
        got, http, size, kept = 0, b"", 0, []
        inner: dict[str, str] | None = None
        tail = b""
        while True:
            part = held[: length - got]
            tail += held[length - got :]
            got += len(part)
            block.update(part)
            if inner is None:
                http += part
                if (at := http.find(b"\r\n\r\n")) >= 0:
                    inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http[:at].decode("latin-1").split("\r\n")[1:])}
                    part = http[at + 4 :]
            if inner is not None:
                body.update(part)
                size += len(part)
                kept += [part] * with_payload
            held = next(pieces, None)
            if held is None:
                break
        if got != length or tail != b"\r\n\r\n":
            raise ValueError("a record's length differs from its content length")
        full = fields["warc-type"] == "response"
        if inner is None or fields["warc-block-digest"] != "sha1:" + base64.b32encode(block.digest()).decode():
            raise ValueError("a record fails its block digest")
        if full and (fields["warc-payload-digest"] != "sha1:" + base64.b32encode(body.digest()).decode() or size != int(inner["content-length"])):
            raise ValueError("a record fails its payload digest")
        number = lambda name: int(fields[name]) if name in fields else None
        yield {
            "page_id": number("page-id"), "target_uri": fields["warc-target-uri"], "payload_bytes": int(inner["content-length"]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
            "record_type": fields["warc-type"], "refers_to": number("refers-to-page-id"), "payload": b"".join(kept) if with_payload and full else None,
        }


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, and as refers_to the response that a page with the same payload revisits."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = keyed.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = keyed.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = keyed.join(sized(written(groups, "warc-groups"), BROADCAST_GROUPS), "digest", "left")
    return joined.select("page_id", "url", "html", F.when(F.coalesce(F.col("page_id") < F.col("original"), F.col("original").isNotNull()), F.col("original")).alias("refers_to"))


def write_warc(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> str:
    """Writes archives of pages (page_id, url, html) and a manifest of their paths; returns the folder."""
    folder = folder or new_folder(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, done = TaskContext.get().partitionId(), [], 0, []

        def close() -> None:
            nonlocal held, size
            if held:
                uri = f"{folder}/part-{part:06d}-{len(done):04d}.warc.gz"
                put_file(uri, lambda out, data=held: [out.write(x) for x in data])
                done.append((uri, len(held)))
                held, size = [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                    payload = html.encode()
                    held.append(member(record(page_id, url, payload, base32_sha1(payload), refers_to)))
                    size += len(held[-1])
                    if size >= ARCHIVE:
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["uri", "n_records"])

    make_folder(folder)
    with_originals(pages, min_bytes).mapInArrow(write, "uri string, n_records long").write.parquet(f"{folder}/manifest")
    return folder


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in the folder's manifest."""
    files = spark.read.schema("uri string, n_records long").parquet(f"{folder}/manifest")
    files = files.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "uri")
    schema = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *[("payload", pa.binary())] * with_payload])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = opened(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as file:
                    for x in read_records(file, with_payload):
                        rows.append(x)
                        held += len(x["payload"] or b"")
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)

    return files.select("uri").mapInArrow(read, FIELDS + ", payload binary" * with_payload)
