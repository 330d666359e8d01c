"""Web archives: writing, reading, and assembling captures from their records.

Writing puts three records per page into gzip files below a folder every executor can reach:
the request, the response (or a revisit of an equal payload), and metadata, the others naming
the response's record as concurrent. The text sink writes them, with the two line ends that
close a record as its separator, so committing and retrying are Spark's.

Reading parses each file as a stream of bytes by the records' own lengths. Assembly groups
records by the capture they are concurrent to, one shuffle that carries all three kinds, and
emits one nested row per capture; records whose response is missing make a row without one.
A revisit takes its payload's length and digest from the response it refers to.

Defined results: a null payload is empty; of pages with equal payloads (by SHA-1 and length)
the one with the largest id is the response, of repeated ones the one read last; null ids come
before all others; a null url writes no target. Pages are read twice, so they must be a table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "struct<kind:string, id:string, concurrent_to:string, refers_to:string, uri:string, stated_digest:string, fields:map<string,string>, payload_bytes:bigint, payload_digest:string, payload:binary>"


# ---------------------------------------------------------------- writing


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1 of a binary column: 20 bits of hexadecimal make 4 letters."""
    hexadecimal, letters = F.sha1(payload), []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(hexadecimal, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, k).bitwiseAND(31) + 1, F.lit(1)) for k in (15, 10, 5, 0)]
    return F.concat(*letters)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, id: Column, date: str, extra: list[tuple[str, Column | None]], body: Column) -> Column:
    head = [("WARC-Type", kind if isinstance(kind, Column) else F.lit(kind)), ("WARC-Record-ID", id), ("WARC-Date", F.lit(date)), *extra]
    head.append(("Content-Length", F.octet_length(body).cast("string")))
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in head]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), body)


def write(pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z", per_file: int = 60_000) -> None:
    """Write the archives below `path`. Payloads of at least `least` bytes are written once; `date`
    goes into every record, so that reruns agree; a file holds `per_file` records at most."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(id).alias("page"), F.col(url).alias("url"), body.alias("body"), base32_sha1(body.cast("binary")).alias("digest"))
    rows = rows.withColumns({"bytes": F.octet_length("body"), "row": F.monotonically_increasing_id()})
    last = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max(F.struct("page", "row")).alias("last"))
    rows = rows.join(last, ["digest", "bytes"], "left").withColumn("again", F.coalesce(F.col("last.row") != F.col("row"), F.lit(False)))
    own = _urn(F.lit("response"), F.col("page"), F.col("digest"), F.col("row"))
    target = ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    near = ("WARC-Concurrent-To", own)
    first = F.when(F.col("again"), _urn(F.lit("response"), F.col("last.page"), F.col("digest"), F.col("last.row")))
    response = _record(
        F.when(F.col("again"), "revisit").otherwise("response"), own, date,
        [target, digest, ("WARC-Refers-To", first), ("WARC-Profile", F.when(F.col("again"), F.lit(PROFILE))), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(F.lit(HTTP), F.when(F.col("again"), "").otherwise(F.col("body"))),
    )
    request = _record(
        "request", _urn(F.lit("request"), F.col("page"), F.col("digest"), F.col("row")), date,
        [target, near, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(target[1], F.lit("/")), F.lit(" HTTP/1.1" + END)),
    )
    metadata = _record(
        "metadata", _urn(F.lit("metadata"), F.col("page"), F.col("digest"), F.col("row")), date,
        [target, near, ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page").cast("string"), F.lit("\r\n")), F.lit("\r\n")),
    )
    lines = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    options = {"lineSep": END, "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": per_file}
    lines.write.options(**options).text(path)


# ---------------------------------------------------------------- reading


def records(data: bytes, payload: bool) -> Iterator[dict]:
    """The records of one archive file, gzip members or plain, cut by their own lengths."""
    plain = bytearray()
    if data[:2] == b"\x1f\x8b":
        while data:
            member = zlib.decompressobj(31)
            plain += member.decompress(data)
            data = member.unused_data
    else:
        plain += data
    view, at = memoryview(plain), 0
    while (at := plain.find(b"WARC/", at)) >= 0:
        end = plain.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = {}
        for line in bytes(view[at:end]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        start, size = end + 4, int(head.get(b"content-length", 0))
        block = view[start : start + size]
        at = start + size
        kind = head.get(b"warc-type")
        row = {"kind": kind, "id": head.get(b"warc-record-id"), "concurrent_to": head.get(b"warc-concurrent-to"), "refers_to": head.get(b"warc-refers-to"), "uri": head.get(b"warc-target-uri")}
        row["stated_digest"] = (head.get(b"warc-payload-digest") or "").partition(":")[2] or None
        if kind == "response":
            cut = plain.find(b"\r\n\r\n", start, at)
            body = view[cut + 4 : at] if cut >= 0 else block
            row |= {"payload_bytes": len(body), "payload_digest": _letters(sha1(body).digest()), "payload": bytes(body) if payload else None}
        elif kind == "metadata":
            pairs = (line.partition(":") for line in bytes(block).decode("utf-8", "replace").splitlines())
            row["fields"] = [(n.strip().lower(), v.strip()) for n, _, v in pairs if n.strip()]
        yield row


def _letters(digest: bytes) -> str:
    from base64 import b32encode

    return b32encode(digest).decode()


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Archive files below `path` -> one row per record. Without `payload` only its length and digest
    leave the reader."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(RECORD[len("struct<") : -1])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def parse(batches):
        for batch in batches:
            for data in batch.column(0):
                part, size = [], 0
                for row in records(data.as_py(), payload):
                    part.append(row)
                    size += row.get("payload_bytes") or 0
                    if len(part) >= 5000 or payload and size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(part, schema=arrow)
                        part, size = [], 0
                yield pa.RecordBatch.from_pylist(part, schema=arrow)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(parse, schema)


# ---------------------------------------------------------------- assembly


def captures(found: DataFrame) -> DataFrame:
    """Records -> one nested row per capture: `capture` (the response's record id), `response`,
    `requests`, `metadata`, and, of the payload it shows, `payload_bytes`, `payload_digest` and the
    capture that holds it, `payload_of`."""
    record = F.struct(*found.columns)
    kind = lambda *names: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*names), record)), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    rows = found.groupBy(F.coalesce("concurrent_to", "id").alias("capture")).agg(
        kind("response", "revisit").alias("responses"), kind("request").alias("requests"), kind("metadata").alias("metadata")
    )
    rows = rows.where("size(responses) + size(requests) + size(metadata) > 0").withColumn("response", F.get("responses", F.lit(0))).drop("responses")
    held = found.where("kind = 'response'").select(F.col("id").alias("payload_of"), "payload_bytes", "payload_digest").dropDuplicates(["payload_of"])
    shown = F.when(F.col("response.kind") == "revisit", F.col("response.refers_to")).otherwise(F.col("capture"))
    return rows.withColumn("payload_of", shown).join(held, "payload_of", "left")
