"""WARC archives: written in segments with chunked transfer framing, read back, reassembled and verified.

An archive is a folder of gzip-compressed WARC/1.1 files of a bounded number of records each, written and read through
Spark's own file sources, so it can be in any store that Spark reaches. A response whose block is longer than a segment
is cut: its first record carries segment number 1, continuation records name it as their origin, and the last one states
the total length. Equal payloads of some length are stored once, and the other records of them are revisits that name
the payload's digest (profile identical-payload-digest).

Reading checks everything that the format states: record framing, segment numbers without gaps, the total length, the
chunked framing and the payload's digest. A record that fails keeps its row, with the reason in `problem`.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import byte_batches, materialize, scratch_path

SEGMENT, CHUNK, RECORDS_PER_FILE, SHARED_FROM = 16_384, 8_192, 2_000, 1_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\r\n]+")
_SIZE = re.compile(rb"([0-9A-Fa-f]{1,15})(?:;[^\r\n]*)?\r\n")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if its framing is broken or the body ends early."""
    out, at = [], 0
    while True:
        m = _SIZE.match(body, at)
        if not m:
            raise ValueError("chunk size")
        n, at = int(m[1], 16), m.end()
        if not n:
            if body.find(b"\r\n", at) < 0 or not body.endswith(b"\r\n"):
                raise ValueError("chunk end")
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk length")
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: dict[str, str], block: bytes) -> bytes:
    """Without its last line end, which the writer adds."""
    head = "".join(f"{k}: {_CONTROL.sub(' ', v)}\r\n" for k, v in fields.items())
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n"])


def _records(key: str, uri: str, payload: bytes, revisits: bool, segment: int) -> Iterator[bytes]:
    name = f"<urn:uuid:{uuid.uuid4()}>"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = {"WARC-Type": "revisit" if revisits else "response", "WARC-Record-ID": name, "WARC-Date": _DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": digest, "Record-Key": key}
    if revisits:
        yield _record(fields | {"WARC-Profile": _PROFILE, "Content-Type": "application/http; msgtype=response"}, _HTTP)
        return
    block = _HTTP + chunked(payload)
    fields["Content-Type"] = "application/http; msgtype=response"
    if len(block) <= segment:
        yield _record(fields, block)
        return
    last = (len(block) - 1) // segment + 1
    for number in range(1, last + 1):
        part = block[(number - 1) * segment : number * segment]
        if number == 1:
            yield _record(fields | {"WARC-Segment-Number": "1"}, part)
        else:
            own = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": _DATE, "WARC-Target-URI": uri, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": str(number)}
            yield _record(own | ({"WARC-Segment-Total-Length": str(len(block))} if number == last else {}), part)


def write_archive(records: DataFrame, path: str, segment: int = SEGMENT, shared_from: int = SHARED_FROM) -> None:
    """Writes records(key, uri, payload) under path.

    key is a number or null, uri a string or null, payload binary or null (empty). Of the records with one payload of at
    least shared_from bytes, those with the largest key are responses and the others revisit them; records with a null
    key are responses.
    """
    rows = records.select(F.col("key").cast("long").alias("key"), F.coalesce(F.col("uri").cast("string"), F.lit("")).alias("uri"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= shared_from, F.sha1("payload")))
    # counted within tasks first; only payloads that come again need a join
    shared = rows.where("digest is not null").groupBy("digest").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("times"))
    shared = materialize(shared.where("times > 1").select("digest", "first"), "shared")
    # a payload below the size joins under a name of its own, so that nulls don't meet in one task
    rows = rows.withColumn("digest", F.coalesce("digest", F.concat(F.lit("-"), F.coalesce(F.col("key").cast("string"), "uri"))))
    rows = rows.join(shared, "digest", "left").select("key", "uri", "payload", F.coalesce(F.col("key") < F.col("first"), F.lit(False)).alias("revisits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "payload", 8_000_000):
            made = []
            for key, uri, payload, revisits in zip(*(batch.column(c).to_pylist() for c in ("key", "uri", "payload", "revisits")), strict=True):
                made += _records("" if key is None else str(key), uri, payload, revisits, segment)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    # the text source writes a string's bytes as they are
    made = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """The fields, block and problem of each record of an archive file's bytes; a broken record ends the file."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/1.", at) or end < 0:
            yield {}, b"", "record framing"
            return
        fields = {}
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        stop = end + 4 + int(size) if re.fullmatch("[0-9]{1,15}", size) else -1
        if stop < 0 or raw[stop : stop + 4] != b"\r\n\r\n":
            yield fields, b"", "record framing"
            return
        yield fields, raw[end + 4 : stop], None
        at = stop + 4


def payload_of(block: bytes, digest: str) -> tuple[bytes | None, str | None]:
    """The decoded payload of a response block and, if something is wrong, what."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None, "http header"
    try:
        payload = unchunked(body) if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head) else body
    except ValueError as broken:
        return None, str(broken)
    if digest and "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        return payload, "digest"
    return payload, None


#: The problem of a record whose key can't be read; its payload can.
UNREAD_KEY = "record key"
_FIELDS = ("record_id", "record_type", "key", "target_uri", "digest")
_HEAD = T.StructType().add("record_id", "string").add("record_type", "string").add("key", "long").add("target_uri", "string").add("digest", "string")
_WHOLE = T.StructType([*_HEAD.fields]).add("payload", "binary").add("problem", "string")
_PART = T.StructType([T.StructField("origin", T.StringType()), *_HEAD.fields]).add("unread", "string").add("number", "long").add("total", "long").add("block", "binary")


def _key(text: str) -> tuple[int | None, str | None]:
    """A record's key, null if it states none, and a problem if what it states is no 64-bit number."""
    if re.fullmatch("-?[0-9]{1,19}", text) and -(1 << 63) <= (key := int(text)) < 1 << 63:
        return key, None
    return None, UNREAD_KEY if text else None


def _named(f: dict[str, str], key: int | None) -> tuple:
    return f.get("warc-record-id"), f.get("warc-type"), key, f.get("warc-target-uri"), f.get("warc-payload-digest")


def _inflated(content: bytes) -> bytes:
    """All members of a gzip file, or the file itself."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join([*out, content]) if out else content


def _scan(files: DataFrame, parts: bool) -> DataFrame:
    """Whole records with their payloads, or the parts of segmented ones."""
    number = lambda text: int(text) if re.fullmatch("[0-9]{1,15}", text or "") else None
    schema = _PART if parts else _WHOLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, block, problem in parse(_inflated(content.as_py())):
                    segmented = "warc-segment-number" in f
                    key, unread = _key(f.get("record-key", ""))
                    if segmented and parts and not problem:
                        rows.append((f.get("warc-segment-origin-id") or f.get("warc-record-id"), *_named(f, key), unread, number(f["warc-segment-number"]), number(f.get("warc-segment-total-length")), block))
                    elif problem and not parts or not segmented and not parts:
                        payload = None
                        if not problem and f.get("warc-type") == "response":
                            payload, problem = payload_of(block, f.get("warc-payload-digest", ""))
                        rows.append((*_named(f, key), payload, problem or unread))
                columns = zip(*rows) if rows else [()] * len(schema.fields)
                yield pa.RecordBatch.from_arrays([pa.array(x, kinds[field.dataType.simpleString()]) for x, field in zip(columns, schema.fields, strict=True)], schema.names)

    return files.mapInArrow(run, schema)


def _assembled(segments: DataFrame) -> DataFrame:
    """One record for each origin: its parts by number, verified against the stated total and decoded."""
    schema = T.StructType().add("payload", "binary").add("problem", "string")
    arrow = pa.struct([("payload", pa.binary()), ("problem", pa.string())])

    def join(parts: pa.Array, digests: pa.Array) -> pa.Array:
        out = []
        for row, digest in zip(parts.to_pylist(), digests.to_pylist(), strict=True):
            block = b"".join(p["block"] for p in row)
            totals = {p["total"] for p in row if p["total"] is not None}
            if [p["number"] for p in row] != list(range(1, len(row) + 1)) or len(totals) != 1:
                out.append({"payload": None, "problem": "segments"})
            elif totals != {len(block)}:
                out.append({"payload": None, "problem": "total length"})
            else:
                out.append(dict(zip(("payload", "problem"), payload_of(block, digest or ""), strict=True)))
        return pa.array(out, arrow)

    # the parts of one record are as large as that record; which of them is where in the files doesn't matter
    first = F.min(F.when(F.col("number") == 1, F.struct(*_FIELDS, "unread"))).alias("f")
    grouped = segments.groupBy("origin").agg(first, F.sort_array(F.collect_list(F.struct("number", "total", "block"))).alias("parts"))
    read = F.arrow_udf(join, schema)("parts", F.col("f.digest")).alias("r")
    return grouped.select("f.*", "origin", read).select(F.coalesce("record_id", "origin").alias("record_id"), *_FIELDS[1:], "r.payload", F.coalesce("r.problem", "unread").alias("problem"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, key, target_uri, digest (as stated), payload (decoded, null for revisits) and problem.

    A key that is no signed 64-bit number is null, with the problem "record key" unless there is a graver one.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return _scan(files, False).union(_assembled(_scan(files, True)))


def resolved(records: DataFrame) -> DataFrame:
    """key, payload_bytes, payload_digest (hex), record_type, refers_to and problem, revisits by the payload that they name.

    records: what read_archive returns. A revisit whose payload isn't there has the problem "refers to nothing".
    """
    facts = records.select("key", "record_type", "digest", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "problem")
    facts = materialize(facts, "records")
    responses = facts.where("record_type is null or record_type <> 'revisit'")
    held = responses.where(F.col("problem").isNull() | (F.col("problem") == UNREAD_KEY)).groupBy("digest").agg(F.max("key").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    revisits = facts.where("record_type = 'revisit'").select("key", "record_type", "digest", F.col("problem").alias("own"))
    named = materialize(revisits.select("digest").distinct().join(held, "digest"), "held")
    found = revisits.join(named, "digest", "left")
    problem = F.coalesce("own", F.when(F.col("payload_digest").isNull(), "refers to nothing"))
    return responses.select("key", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "problem").union(
        found.select("key", "payload_bytes", "payload_digest", "record_type", "refers_to", problem)
    )


def round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Archives pages(page_id, url, html, ...) and reads them back: one row for each page.

    A null html is an empty payload; rows that repeat a page_id have a record each. Other columns are not read.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages.select(F.col("page_id").alias("key"), F.col("url").alias("uri"), F.col("html").cast("string").cast("binary").alias("payload")), path, segment)
    return resolved(read_archive(spark, path)).withColumnRenamed("key", "page_id")
