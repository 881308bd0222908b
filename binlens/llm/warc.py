"""WARC archives with revisit resolution.

Headers (id, digest, length) are shuffled by payload digest; the smallest id of a digest keeps its payload
as a ``response`` record, the others become ``revisit`` records that name it. Payloads never meet in a
group: only headers do, and the smallest id is a map-side aggregate.

Archives are written by Spark's text writer, one record per row with the record end as separator, so they
go through the output committer to any store Spark can write, survive lost executors, and are whole
WARC/1.1 byte streams (gzip by default). They are read back as whole files, parsed by Content-Length, and
revisit records are joined to the response they refer to for their full payload length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binlens.llm.common import utf8
from binlens.session import scratch_path

END = b"\r\n\r\n"
#: Date of every record: archives of equal input are equal byte for byte.
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:binlens:page:%s>"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_digests(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, digest, bytes) of every row."""
    src = pages.select(F.col(id_col).alias("id"), F.col(payload_col).alias("payload"))

    def run(batches):
        for b in batches:
            payloads = [p or b"" for p in utf8(b, "payload")]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(payload_digest, payloads), pa.string()), pa.array(map(len, payloads), pa.int64())],
                names=["id", "digest", "bytes"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, digest string, bytes long")


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, digest, refers_to) of the revisits among (id, digest, bytes): payloads of at least ``min_bytes``
    bytes whose digest belongs to a smaller id. Null ids are never originals or revisits."""
    long = headers.where((F.col("bytes") >= min_bytes) & F.col("id").isNotNull())
    first = long.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (long.join(first, "digest").where("id > refers_to").select("id", "digest", "refers_to").distinct())


def _record(kind: str, rid: str, uri: str | None, digest: str, refers: str | None, payload: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {RECORD_ID % rid}", f"WARC-Date: {EPOCH}",
             f"WARC-Payload-Digest: sha1:{digest}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + quote(uri, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers is not None:
        lines += [f"WARC-Refers-To: {RECORD_ID % refers}", f"WARC-Profile: {PROFILE}"]
    lines.append("Content-Type: text/html" if kind == "response" else "Content-Type: application/octet-stream")
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + END + payload


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, compression: str = "gzip") -> None:
    """Write one record per row of ``pages`` under ``path``; one archive per write task.

    The payload is the string column in UTF-8 (null: empty). A null id or url leaves its header out.
    Rows that repeat an id are records of their own: with equal payloads they refer to the first by id
    only if their id is larger. Extra columns are not read.
    """
    revisits = resolve_revisits(with_digests(pages, id_col, payload_col), min_bytes)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("payload"))
    # an id that repeats with other payloads has an entry for each digest
    pair = F.struct("digest", F.col("refers_to").cast("string"))
    revisits = revisits.groupBy(F.col("id").alias("rid")).agg(F.map_from_entries(F.collect_list(pair)).alias("refers"))
    rows = rows.join(revisits, F.col("id") == F.col("rid"), "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload", "refers")

    def run(batches):
        for b in batches:
            out = []
            for rid, uri, payload, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b, "payload"),
                                                 b.column(3).to_pylist()):
                payload = payload or b""
                digest = payload_digest(payload)
                refers = dict(refers or ()).get(digest)
                # rows without an id get one of their own, so records keep the mandatory header
                tag = rid if rid is not None else "none-" + uuid.uuid5(uuid.NAMESPACE_URL, f"{uri} {digest}").hex
                out.append(_record("response" if refers is None else "revisit", tag, uri, digest, refers,
                                   payload if refers is None else b""))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    rows.mapInArrow(run, "value string").write.option("lineSep", END.decode()).option("compression", compression).text(path)


_FIELD = re.compile(rb"([\w-]+): ?([^\r]*)\r\n")


def records(data: bytes):
    """(headers, payload) of each record in an archive's bytes, gzip or plain."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:     # members one after the other
            d = zlib.decompressobj(31)
            plain.append(d.decompress(data))
            data = d.unused_data
        data = b"".join(plain)
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        head = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(data[at:stop] + b"\r\n")}
        start = stop + len(END)
        n = int(head["content-length"])
        yield head, data[start:start + n]
        at = start + n + len(END)


READ = "id string, kind string, digest string, bytes long, refers_to string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, digest, bytes, refers_to) of every record under ``path``, ids as text; digest and length
    of responses are recomputed from the payload read."""
    def run(batches):
        for b in batches:
            for data in b.column(0):
                out = []
                for head, payload in records(data.as_buffer().to_pybytes()):
                    rid = head["warc-record-id"].rpartition(":")[2][:-1]
                    kind = head["warc-type"]
                    refers = head.get("warc-refers-to", "").rpartition(":")[2][:-1] or None
                    digest = payload_digest(payload) if kind == "response" else head["warc-payload-digest"].removeprefix("sha1:")
                    out.append((None if rid.startswith("none-") else rid, kind, digest, len(payload), refers))
                cols = list(zip(*out)) or [()] * 5
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=["id", "kind", "digest", "bytes", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select("content").mapInArrow(run, READ)


def archive_index(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives (under ``path``, or a new folder of the shared checkpoint folder), read
    them back, and give (id, payload_bytes, payload_digest, record_type, refers_to) per record. Revisits
    get their length from the response they refer to. Empty input: no records."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archives(pages, path, id_col, url_col, payload_col, min_bytes)
    kind = pages.schema[id_col].dataType
    back = read_archives(spark, path).withColumns({"id": F.col("id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
    origin = (back.where("kind = 'response' and id is not null")
              .groupBy(F.col("id").alias("oid")).agg(F.max(F.struct("digest", "bytes")).alias("o")))
    revisit = back.where("kind = 'revisit'")
    full = revisit.join(origin, (F.col("refers_to") == F.col("oid")), "left").withColumn("bytes", F.col("o.bytes"))
    cols = ["id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
            F.col("kind").alias("record_type"), "refers_to"]
    return back.where("kind = 'response'").select(*cols).union(full.select(*cols))
