"""A deterministic sharded WARC writer, and its reader.

Records are sorted by page over ranges of page_id that depend on the data
alone. A task writes its range as gzip members, one for each record, and rolls
to a new file once the compressed size is reached. Headers and digests are made
anew. Files are written under temporary names; the driver renames those of the
tasks that succeeded and then writes a manifest. Of equal payloads the one with
the smallest page_id is stored, the others are revisits of it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, commit, cut, input_bytes, new_folder, one_each, ranges, store_of

#: Compressed bytes after which a file is full; payloads below this size are never revisits; a date, since pages have none.
ROLL, LEAST, DATE = 64 << 20, 100, "1970-01-01T00:00:00Z"
#: Fixed value of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = DATE) -> bytes:
    """One record, not compressed. Control characters and spaces of the URL are percent-encoded, so that no header can be forged."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
        "X-Page-Id": "" if page_id is None else page_id,
        "X-Payload-Length": len(payload),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-Id": refers_to}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", roll: int = ROLL, least: int = LEAST) -> str:
    """Write a record for every row; returns the folder (by default a new one in the shared folder).

    A null html is an empty payload. A null url is empty. Rows that repeat a
    page_id and payload are revisits of the first; a null page_id is written
    as empty and never referred to. An empty table gives a manifest without
    files. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # by the table's size alone, whatever the session's settings: a range fills about one file
    cuts = ranges(rows, "page_id", max(1, 2 * input_bytes(pages) // roll))
    # which page a copy refers to is settled on ids and digests alone; the writer finds it in a row before the page's own
    narrow = cut(rows.where(F.octet_length("payload") >= least).select("page_id", "digest"))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    notes = narrow.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    both = notes.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first").unionByName(
        rows.withColumn("first", F.lit(None).cast("long"))
    )
    dealt = both.withColumn("part", cuts.of(F.col("page_id"))).repartitionById(cuts.parts, "part")
    dealt = dealt.sortWithinPartitions(F.col("page_id"), F.col("digest"), F.col("first").isNull(), F.col("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        attempt, files, out, size, n, note, last = uuid.uuid4().hex, [], None, 0, 0, None, None
        for x in batches:
            for part, page, address, payload, digest, to in zip(*(x.column(c).to_pylist() for c in ("part", "page_id", "url", "payload", "digest", "first")), strict=True):
                if payload is None:
                    note = (page, digest, to)
                    continue
                if out is not None and size >= roll:
                    out.close()
                    files[-1] |= {"bytes": size, "records": n}
                    out = None
                if out is None:
                    name = f"part-{part:05d}-{len(files):04d}.warc.gz"
                    store.create_dir(f"{root}/_temporary", recursive=True)
                    files.append({"temp": f"_temporary/{attempt}-{name}", "name": name})
                    out, size, n = store.open_output_stream(f"{root}/{files[-1]['temp']}"), 0, 0
                again = last == (page, digest) and page is not None and len(payload) >= least
                target = note[2] if note and note[:2] == (page, digest) else page if again else None
                data = _member(record(page, address, payload, target, target is not None))
                out.write(data)
                size, n, last = size + len(data), n + 1, (page, digest)
        if out is not None:
            out.close()
            files[-1] |= {"bytes": size, "records": n}
        if files:
            yield pa.RecordBatch.from_pylist(files)

    files = [r.asDict() for r in arrow_map(dealt, run, "temp string, name string, bytes long, records long").collect()]
    store, root = store_of(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)
    commit(folder, sorted(files, key=lambda f: f["name"]))
    return folder


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of a stream."""
    data, held = stream.read(CHUNK), b""
    while data:
        z, parts = zlib.decompressobj(31), []
        while data and not z.eof:
            parts.append(z.decompress(data))
            data = z.unused_data if z.eof else stream.read(CHUNK)
        if not z.eof:
            raise ValueError("a record is cut off")
        data = data or stream.read(CHUNK)
        held = b"".join(parts)
        at = held.index(b"\r\n\r\n")
        head = dict(line.split(": ", 1) for line in held[:at].decode().split("\r\n")[1:])
        yield head, held[at + 4 : at + 4 + int(head["Content-Length"])]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the files in the manifest: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken from what was read, and have to
    equal the headers' or the read fails.
    """
    import json

    store, root = store_of(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        names = [x["name"] for x in json.loads(f.read())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        for x in batches:
            for name in x.column("name").to_pylist():
                rows: list[tuple] = []
                size = 0
                with store.open_input_stream(f"{root}/{name}") as f:
                    for head, block in _records(f):
                        kind, payload = head["WARC-Type"], None
                        digest, n = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
                            raise ValueError(f"{name}: block digest of {head['WARC-Record-ID']}")
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
                                raise ValueError(f"{name}: payload of {head['WARC-Record-ID']}")
                        page, to = head["X-Page-Id"], head.get("X-Refers-To-Page-Id")
                        rows.append((int(page) if page else None, head["WARC-Target-URI"], payload, n, digest, kind, int(to) if to else None))
                        size += len(payload or b"")
                        if size > 16 << 20 or len(rows) >= 10_000:
                            yield frame(rows)
                            rows, size = [], 0
                if rows:
                    yield frame(rows)

    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return arrow_map(one_each(spark, [(n,) for n in names], "name string"), run, schema)
