r"""Content-addressed WARC archive.

A payload's bytes are stored once, compressed, under their SHA-256; every record's exact header block is stored by itself
and names that digest.  Joining the two gives the records back byte for byte: ``read_records`` rebuilds every record that
way, ``read_index`` says what is in them.  The largest page_id of equal payloads is the response, the others are revisits
of it (identical-payload-digest profile); payloads under ``min_bytes`` are all responses.

``write_archive`` verifies the digest while storing: payloads of one digest must agree in length and in a second,
independent hash, otherwise it raises.  Reading verifies again, on the unpacked bytes of each record.  Payloads collapse
in map-side partial aggregation before they are moved, so a payload that a third of all pages share is no hot key; towards
the join such a payload goes in as many copies as its records fill parts of ``PART_ROWS``.

Definitions.  A null html is an empty payload; a null url gives an empty target URI.  Rows with a null page_id are
archived as responses of their own, named by a hash of what they hold, and read back with a null page_id.  Rows that
repeat a page_id are records of their own (of the same name); where such a row shares the largest page_id's payload, each
of them is a response.  A page is held whole in a task, however long.  An empty table gives an empty archive.  Only
page_id, url and html are read.  The pages don't say when they were fetched, so all records bear the date ``written``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import small_batches

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "2024-01-01T00:00:00Z"
PART_ROWS = 4096
HEADERS = "page_id bigint, digest string, part bigint, header string"
PAYLOADS = "digest string, bytes bigint, parts bigint, packed binary"


def payload_of(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _packed(batches: Iterator[pa.RecordBatch], pack: bool) -> Iterator[pa.RecordBatch]:
    """Of (page_id, url, check, payload): the payload's digests, length and, with ``pack``, its compressed bytes."""
    codec = pa.Codec("zstd")
    for batch in batches:
        bodies = [x.as_py() for x in batch["payload"]]
        arrays = {"page_id": batch["page_id"], "url": batch["url"], "check": batch["check"], "digest": pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string())}
        arrays |= {"bytes": pa.array([len(x) for x in bodies], pa.int64()), "sha1": pa.array([base32_sha1(x) for x in bodies], pa.string())}
        if pack:
            arrays["packed"] = pa.array([codec.compress(x, asbytes=True) for x in bodies], pa.binary())
        yield pa.RecordBatch.from_pydict(arrays)


def header_block(kind: Column, written: str) -> Column:
    """The header of a record with the columns page_id, url, digest, bytes, sha1, refers_to and a record type."""
    uid = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    nameless = F.concat(F.lit("<urn:content:"), F.sha2(F.concat(F.encode(clean, "UTF-8"), F.lit("\n"), F.col("digest")), 256), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.coalesce(uid(F.col("page_id")), nameless)),
        line("WARC-Date", F.lit(written)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(F.col("refers_to").isNotNull(), F.concat(line("WARC-Refers-To", uid(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, written: str = WRITTEN) -> None:
    """Write ``path/payloads`` (PAYLOADS) and ``path/headers`` (HEADERS) as Parquet."""
    body = payload_of(F.col("html"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64(body).alias("check"), body.alias("payload"))
    known = "page_id bigint, url string, check bigint, digest string, bytes bigint, sha1 string"
    packed, pages = (small_batches(pages).mapInArrow(partial(_packed, pack=pack), known + pack * ", packed binary") for pack in (True, False))
    # one copy of each payload, chosen before anything is moved
    groups = packed.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("bytes").alias("b0"), F.max("bytes").alias("b1"), F.first("packed").alias("packed"))
    sound = F.when((F.col("c0") == F.col("c1")) & (F.col("b0") == F.col("b1")), F.col("b0")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256")).cast("long"))
    groups.select("digest", sound.alias("bytes"), F.ceil(F.col("n") / PART_ROWS).alias("parts"), "packed", "keeper").write.option("compression", "none").parquet(f"{path}/payloads")
    kept = pages.sparkSession.read.parquet(f"{path}/payloads").select(F.col("digest").alias("g"), "parts", "keeper")
    named = pages.drop("check").join(kept, F.col("digest") == F.col("g"))
    named = named.withColumn("refers_to", F.when((F.col("bytes") >= min_bytes) & (F.col("page_id") != F.col("keeper")), F.col("keeper")))
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    part = F.pmod(F.xxhash64("page_id", "url"), F.col("parts"))
    named.select("page_id", "digest", part.alias("part"), header_block(kind, written).alias("header")).write.parquet(f"{path}/headers")


def parsed(header: Column) -> dict[str, Column]:
    """The fields of an exact header block."""
    field = lambda name: F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    page = lambda name: F.nullif(F.regexp_extract(header, rf"\r\n{name}: <urn:page:(-?[0-9]+)>\r\n", 1), F.lit("")).cast("long")
    return {"page_id": page("WARC-Record-ID"), "record_type": field("WARC-Type"), "payload_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""), "refers_to": page("WARC-Refers-To"), "url": field("WARC-Target-URI"), "date": field("WARC-Date")}


def _joined(spark: SparkSession, path: str) -> DataFrame:
    """(header, digest, bytes, packed) of every record: its header met with its payload by digest."""
    payloads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    payloads = payloads.select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "bytes", "packed")
    return small_batches(spark.read.schema(HEADERS).parquet(f"{path}/headers").join(payloads, ["digest", "part"]).select("header", "digest", "bytes", "packed"))


def _rebuilt(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Records with their payload unpacked and held against its digest and length, and against what the header says.

    Without ``whole`` the payload itself is not returned, only what was found of it.
    """
    codec = pa.Codec("zstd")
    for batch in batches:
        sizes, digests, bodies = [], [], []
        for header, digest, size, packed in zip(*(batch[c].to_pylist() for c in ("header", "digest", "bytes", "packed"))):
            payload = codec.decompress(packed, decompressed_size=size, asbytes=True)
            sha1 = base32_sha1(payload)
            length = f"Content-Length: {'0' if header[10:].startswith('WARC-Type: revisit') else len(payload)}\r\n"
            if hashlib.sha256(payload).hexdigest() != digest or f"\r\nWARC-Payload-Digest: sha1:{sha1}\r\n" not in header or length not in header:
                raise ValueError(f"the payload {digest} differs from its record")
            sizes.append(len(payload))
            digests.append(sha1)
            bodies.append(payload)
        found = [pa.array(bodies, pa.binary())] if whole else [pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays([batch["header"], *found], names=["header", "payload"] if whole else ["header", "payload_bytes", "payload_digest"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload): the original records."""
    rows = _joined(spark, path).mapInArrow(partial(_rebuilt, whole=True), "header string, payload binary")
    return rows.select(parsed(F.col("header"))["page_id"].alias("page_id"), "header", "payload")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per rebuilt record: page_id, payload_bytes and payload_digest of its payload, record_type and refers_to of its header."""
    rows = _joined(spark, path).mapInArrow(partial(_rebuilt, whole=False), "header string, payload_bytes bigint, payload_digest string")
    f = parsed(F.col("header"))
    return rows.select(f["page_id"].alias("page_id"), "payload_bytes", "payload_digest", f["record_type"].alias("record_type"), f["refers_to"].alias("refers_to"))


def export_warc(spark: SparkSession, path: str, to: str, per_file: int = 5000) -> None:
    """Standard WARC files of at most ``per_file`` records from an archive: a revisit's block is empty, a response's is its payload."""
    records = read_records(spark, path)
    block = F.when(parsed(F.col("header"))["record_type"] == "revisit", "").otherwise(F.decode("payload", "UTF-8"))
    records.select(F.concat("header", block).alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).text(to)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, block) of every record of WARC files, cut by Content-Length; any reader path works.  A task holds one file whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                data, at, heads, blocks = data.as_py(), 0, [], []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    head = data[at:end]
                    length = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    heads.append(head.decode())
                    blocks.append(data[end : end + length])
                    at = end + length + 4
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(blocks, pa.binary())], names=["header", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header string, block binary")
