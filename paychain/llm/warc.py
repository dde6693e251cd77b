"""WARC archives behind an index.

Each task writes one archive, every record a gzip member of its own, and an index row for each
record: archive, offset, length, URL and digest. The index is a table in the shared folder. A
task that is run again writes a new archive under a new name, and only the archives that the index
names count.

Reading starts from index rows. Those selected are sorted by archive and offset, joined into byte
ranges where the gaps are small, and each range is read at once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paychain.llm.common import each_part, materialize, part_of, parts_held, shared_dir, small_batches

#: Ranges start in chunks of so many bytes; smaller gaps between selected records are read through.
CHUNK, GAP = 4 << 20, 64 << 10
#: Bytes of archives that a task reads: as few as the first if that makes no more than a few tasks a core, else up to the second.
TASK_BYTES, MOST_TASK_BYTES, TASKS_A_CORE = 8 << 20, 256 << 20, 3

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _name(page: object) -> bytes:
    return b"<urn:page:%s>" % (b"" if page is None else str(page).encode())


def _page(name: bytes | None) -> int | None:
    number = (name or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(number) if number else None


def record(page: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzipped WARC record: a response, or a revisit without payload."""
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + _name(page),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        *([b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "replace")] if url is not None else []),
        *([b"WARC-Refers-To: " + _name(refers_to), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        b"WARC-Payload-Digest: sha1:" + digest,
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def parse(raw: bytes) -> dict:
    """The record in plain bytes: page, url, type, refers_to, digest, payload_bytes and payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(b": ") for line in head.split(b"\r\n")[1:])}
    block = rest[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[16:]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: "))
    digest = fields[b"warc-payload-digest"].removeprefix(b"sha1:")
    revisit = fields[b"warc-type"] == b"revisit"
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"the payload of record {fields[b'warc-record-id']!r} is not what its digest says")
    url = fields.get(b"warc-target-uri")
    return {
        "page": _page(fields[b"warc-record-id"]), "url": None if url is None else url.decode("utf-8"), "record_type": "revisit" if revisit else "response",
        "refers_to": _page(fields.get(b"warc-refers-to")), "payload_digest": digest.decode(), "payload_bytes": size, "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str | None = None, page: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record for each row; the index as a table (page, url, archive, offset, length, payload_digest, record_type, refers_to).

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the smallest page are responses and the others
    revisits of it; rows with a smaller payload are all responses. A null payload is empty. Rows that repeat the smallest page are
    responses too. A null page never is the smallest unless all are null; all are responses then. No rows give no archive and an
    empty index.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).alias("url"), body.alias("payload"), F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("n"))
    rows = rows.withColumn("part", part_of("page"))  # a payload that a third of the pages have is joined in parts
    # only payloads that occur again; written so that Spark knows the size of what it joins
    again = materialize(
        rows.where(F.col("n") >= least_bytes).groupBy(F.col("sha").alias("_sha"), F.col("n").alias("_n")).agg(F.min("page").alias("first"), parts_held(F.col("part")).alias("held"), F.count("*").alias("c")).where("c > 1").drop("c")
    ).select("_sha", "_n", "first", each_part(F.col("held")).alias("_part"))
    told = rows.join(again, (F.col("sha") == F.col("_sha")) & (F.col("n") == F.col("_n")) & (F.col("part") == F.col("_part")), "left").select("page", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page")), F.col("first")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = None, 0
        store, top = pafs.FileSystem.from_uri(folder)
        name = f"{top}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(name, compression=None)  # records are compressed one by one
            index: dict[str, list] = {k: [] for k in ("page", "url", "archive", "offset", "length", "payload_digest", "record_type", "refers_to")}
            for p, u, body, first in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3)))):
                digest = base64.b32encode(hashlib.sha1(body).digest())
                raw = record(p, u, body, digest, first, first is not None)
                out.write(raw)
                for k, v in zip(index, (p, u, name.rpartition("/")[2], at, len(raw), digest.decode(), "response" if first is None else "revisit", first)):
                    index[k].append(v)
                at += len(raw)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(index.values(), kinds)], list(index))
        if out is not None:
            out.close()

    index = told.mapInArrow(write, "page long, url string, archive string, offset long, length long, payload_digest string, record_type string, refers_to long")
    return materialize(index.withColumn("archive", F.concat(F.lit(folder + "/"), "archive")))


def read_records(index: DataFrame, payloads: bool = True, chunk: int = CHUNK, gap: int = GAP) -> DataFrame:
    """The records of the selected ``index`` rows: page, url, record_type, refers_to, payload_digest, payload_bytes and, unless ``payloads`` is false, payload.

    Every response's digest is computed again and compared. Index rows that are selected twice are read twice.
    An empty index gives no rows.
    """
    total, cores = index.agg(F.sum("length")).first()[0] or 0, index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(-(-total // TASK_BYTES), TASKS_A_CORE * cores), -(-total // MOST_TASK_BYTES))
    # dealt by what they make tasks read, as the ranges themselves take few bytes
    ranges = index.groupBy("archive", F.floor(F.col("offset") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("spans")).repartition(tasks)
    kinds = {"page": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64()} | ({"payload": pa.binary()} if payloads else {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = pafs.FileSystem.from_uri(archive)
                with store.open_input_file(path) as f:
                    i, out = 0, []
                    while i < len(spans):
                        j, end = i, spans[i]["offset"] + spans[i]["length"]
                        while j + 1 < len(spans) and spans[j + 1]["offset"] <= end + gap:
                            j += 1
                            end = max(end, spans[j]["offset"] + spans[j]["length"])
                        start = spans[i]["offset"]
                        block = memoryview(f.read_at(end - start, start))
                        for s in spans[i : j + 1]:
                            at = s["offset"] - start
                            found = parse(zlib.decompress(block[at : at + s["length"]], 31))
                            out.append([found[k] for k in kinds])  # a payload is let go once it is verified
                        i = j + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], list(kinds))

    schema = "page long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads
    return ranges.select("archive", "spans").mapInArrow(read, schema)
