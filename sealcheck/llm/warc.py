"""WARC archives written and read index first.

Writing: pages with a payload of at least ``LEAST_BYTES`` bytes that an earlier page holds become revisit records; each task appends its
records, a gzip member each, to a file of its own in a shared folder and returns page id, URL, digest, file, offset and length of each. Only the
index rows of successful tasks are committed, so files of lost attempts are never read.

Reading: selected index rows are dealt by file and stretch, sorted by offset, and neighbouring byte ranges are read at once. Digests of
responses are checked against their payload.

A null html is the empty payload; null URLs have no target header; rows without an id or that share id and payload are responses of
their own. Files are opened through Arrow's file systems (local, S3, GCS, HDFS by URI), so any number of tasks can read them.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F, types as T

from sealcheck.llm import common

LEAST_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
#: Ranges less than GAP apart are read at once, up to RANGE bytes; a task reads about STRETCH bytes of a file in a row.
GAP, RANGE, STRETCH = 64 << 10, 4 << 20, 32 << 20
RECORD_ID = "urn:x-page:"


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder named by URI or local path."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def revisits(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page with a smaller id holds."""
    facts = (pages.where(F.col(id_column).isNotNull()).where(F.octet_length(html) >= LEAST_BYTES)
             .select(F.col(id_column).alias("page_id"), F.sha2(html, 256).alias("digest")))
    firsts = facts.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last")
    return facts.join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def record_bytes(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member. The block of a revisit is the HTTP head alone, which states the length of the payload it stands for."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~|\"<>"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return zlib.compress(record, 6, 31)


def parse_record(record: bytes) -> dict[str, str | bytes | int | None]:
    """Headers, payload length and payload (None for a revisit) of one record."""
    head, _, rest = zlib.decompress(record, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    revisit = fields["WARC-Type"] == "revisit"
    name = lambda key: (fields[key][1 + len(RECORD_ID):-1] or None) if key in fields else None
    return {"page_id": name("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": name("WARC-Refers-To"),
            "url": fields.get("WARC-Target-URI"), "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": size,
            "payload": None if revisit else payload}


INDEX = T.StructType([T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()),
                      T.StructField("file", T.StringType()), common.long_field("offset"), common.long_field("length")])


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every page into archives below ``folder``; the index, staged as a table."""
    known = revisits(pages, id_column, html).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    rows = (rows.join(known, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
            .select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to")))

    def write(batches):
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        name, out, at = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            index = []
            for page_id, link, payload, digest, refers in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                record = record_bytes(page_id, link, payload.encode(), digest, refers)
                out.write(record)
                index.append((page_id, link, digest, name, at, len(record)))
                at += len(record)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), [pa.string()] * 4 + [pa.int64()] * 2)], names=INDEX.names)
        if out is not None:
            out.close()

    return common.stage(rows.mapInArrow(write, INDEX), "warcindex")


RECORD = T.StructType([T.StructField("page_id", T.StringType()), T.StructField("record_type", T.StringType()),
                       T.StructField("refers_to", T.StringType()), T.StructField("digest", T.StringType()), common.long_field("payload_bytes"),
                       T.StructField("payload", T.BinaryType())])


def read_records(selected: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows; ``payload`` is null for revisits, or for all where it is not asked for."""
    rows = (selected.select("file", "offset", "length").withColumn("_stretch", F.floor(F.col("offset") / STRETCH))
            .repartition("file", "_stretch").sortWithinPartitions("file", "offset"))

    def read(batches):
        system, path = open_folder(folder)
        held: tuple[str, object] | None = None
        for batch in batches:
            found: list[dict] = []
            wanted = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
            first = 0
            while first < len(wanted):
                file, start, length = wanted[first]
                end, last = start + length, first + 1
                while last < len(wanted) and wanted[last][0] == file and wanted[last][1] - end <= GAP and wanted[last][1] + wanted[last][2] - start <= RANGE:
                    end = max(end, wanted[last][1] + wanted[last][2])
                    last += 1
                if held is None or held[0] != file:
                    if held is not None:
                        held[1].close()
                    held = (file, system.open_input_file(f"{path}/{file}"))
                stretch = held[1].read_at(end - start, start)
                for _, offset, size in wanted[first:last]:
                    record = parse_record(stretch[offset - start:offset - start + size])
                    if record["payload"] is not None and hashlib.sha256(record["payload"]).hexdigest() != record["digest"]:
                        raise ValueError(f"{file} at {offset}: the payload does not match its digest")
                    found.append(record if with_payload else record | {"payload": None})
                first = last
                if len(found) >= 512:
                    yield batch_of(found)
                    found = []
            if found:
                yield batch_of(found)
        if held is not None:
            held[1].close()

    def batch_of(records: list[dict]) -> pa.RecordBatch:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[name] for r in records], kind) for name, kind in zip(RECORD.names, kinds)], names=RECORD.names)

    return rows.mapInArrow(read, RECORD)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = common.shared_path(spark, "warc")
    index = write_archives(pages, folder)
    return read_records(index, folder, with_payload=False).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
WITH facts AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_page FROM facts WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_page THEN first_page END AS refers_to
FROM facts LEFT JOIN firsts USING (payload_digest)
"""
