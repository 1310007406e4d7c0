"""WARC records of captures, and transactions assembled from them (operator 7).

`write_archive` writes each page as request, response (or revisit) and metadata record in gzipped WARC/1.1 files: a
row of Spark's text writer is one record, and its line separator is the two line ends that close a record. Of
equal payloads from `least` bytes on, the capture with the largest id is the response and the others revisit it;
that is decided on digests alone, so payloads go from the scan into the files. `read_records` parses the files by
Content-Length and compares each payload with its digest. `assemble` joins request and metadata to their capture by
WARC-Concurrent-To, and gives one nested row per capture.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evkit.session import write_once

LEAST = 1000
END = "\r\n"
# Bytes of one archive before compression, about; a task writes one file after the other.
FILE_BYTES = 64 << 20
# Records given on at a time while a file is read.
BATCH = 200
PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = {"WARC-Type": "kind", "WARC-Record-ID": "record_id", "WARC-Concurrent-To": "concurrent_to",
         "WARC-Refers-To": "refers_to", "WARC-Payload-Digest": "digest", "WARC-Target-URI": "uri"}
RECORD = ("kind string, record_id string, concurrent_to string, refers_to string, digest string, uri string, "
          "head string, payload string, payload_bytes long")
# The header lines of each kind of record, in order.
HEADS = {
    "request": ("WARC-Concurrent-To", "WARC-Target-URI", "Content-Type"),
    "response": ("WARC-Target-URI", "WARC-Payload-Digest", "Content-Type"),
    "revisit": ("WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Profile", "Content-Type"),
    "metadata": ("WARC-Concurrent-To", "Content-Type"),
}


def _record(kind: str, name: Column, head: Column, payload: Column, **values: Column) -> Column:
    """A record whose block is `head` and then `payload`."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), name),
             F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{key}: "), values[key.replace("-", "_")]) for key in HEADS[kind]]
    size = F.octet_length(head) + F.octet_length(payload)
    lines.append(F.concat(F.lit("Content-Length: "), size.cast("string")))
    return F.concat(F.array_join(F.array(*lines), END), F.lit(END + END), head, payload)


def _http(first: str, *lines: Column) -> Column:
    return F.concat(F.lit(first + END), *[F.concat(line, F.lit(END)) for line in lines], F.lit(END))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                  least: int = LEAST) -> None:
    """Write `pages` below `path`. A null html is an empty payload, a null url an empty one.

    Ids are unique. Rows without an id get no record: nothing could name it. Other columns are not written.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.filter(F.col(page_id).isNotNull()).select(
        F.col(page_id).alias("id"),
        F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]+", "%0A").alias("url"), body.alias("body"),
        F.octet_length(body).cast("long").alias("bytes"), F.sha1(body.cast("binary")).alias("sha1"),
    )
    digests = write_once(rows.select("id", "bytes", "sha1"), "payload-digests")
    total = digests.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    long = digests.filter(F.col("bytes") >= least)
    groups = long.groupBy("sha1").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = long.join(groups, "sha1").filter("id <> last").select(F.col("id").alias("of"), "last")
    # As a table its size is known: below the threshold it is broadcast, else pages are dealt out by id, once.
    rows = rows.join(write_once(again, "revisits"), F.col("id") == F.col("of"), "left")
    key, nothing = F.col("id").cast("string"), F.lit("")
    urn = lambda kind, of: F.concat(F.lit(f"<urn:capture:{kind}:"), of.cast("string"), F.lit(">"))
    name, digest = urn("response", key), F.concat(F.lit("sha1:"), F.col("sha1"))
    asked = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + END + END))
    about = F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(END))
    answered = _http("HTTP/1.1 200 OK", F.lit("Content-Type: text/html; charset=utf-8"),
                     F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string")))
    http = lambda kind: F.lit(f"application/http;msgtype={kind}")
    common = {"WARC_Target_URI": F.col("url"), "WARC_Payload_Digest": digest, "Content_Type": http("response")}
    response = _record("response", name, answered, F.col("body"), **common)
    revisit = _record("revisit", name, answered, nothing, WARC_Refers_To=urn("response", F.col("last")),
                      WARC_Profile=F.lit(REVISIT), **common)
    request = _record("request", urn("request", key), asked, nothing, WARC_Concurrent_To=name,
                      WARC_Target_URI=F.col("url"), Content_Type=http("request"))
    metadata = _record("metadata", urn("metadata", key), about, nothing, WARC_Concurrent_To=name,
                       Content_Type=F.lit("application/warc-fields"))
    own = F.when(F.col("of").isNotNull(), revisit).otherwise(response)
    records = rows.select(F.explode(F.array(request, own, metadata)).alias("value"))
    per_file = max(1, 3 * total["rows"] * FILE_BYTES // max(1, total["bytes"] + 1000 * total["rows"]))
    writer = records.write.option("lineSep", END + END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", int(per_file)).text(path)


def _pieces(content: bytes) -> Iterator[bytes]:
    """The file unpacked, in pieces of bounded size; several gzip members may follow each other."""
    while content:
        unpack = zlib.decompressobj(wbits=31)
        while not unpack.eof:
            piece = unpack.decompress(content, PIECE)
            content = unpack.unconsumed_tail
            if not piece and not content and not unpack.eof:
                raise ValueError("the archive ends within a record")
            yield piece
        content = unpack.unused_data


def _blocks(content: bytes) -> Iterator[tuple[list[str], bytes]]:
    """(header lines, block) of each record."""
    held = bytearray()
    pieces = _pieces(content)
    needed = 0
    while True:
        head = held.find(b"\r\n\r\n")
        if head >= 0 and not needed:
            lines = held[:head].decode("utf-8").split(END)
            sizes = [line.partition(": ")[2] for line in lines if line.startswith("Content-Length: ")]
            needed = head + 4 + int(sizes[0]) + 4
        if needed and len(held) >= needed:
            yield lines[1:], bytes(held[head + 4 : needed - 4])
            del held[:needed]
            needed = 0
            continue
        piece = next(pieces, None)
        if piece is None:
            if held:
                raise ValueError("the archive ends within a record")
            return
        held += piece


def _parse(content: bytes) -> Iterator[dict]:
    for lines, block in _blocks(content):
        row: dict = dict.fromkeys(NAMES.values())
        for line in lines:
            key, _, value = line.partition(": ")
            if key in NAMES:
                row[NAMES[key]] = value
        head, payload = block, b""
        if row["kind"] in ("response", "revisit"):
            cut = block.index(b"\r\n\r\n") + 4
            head, payload = block[:cut], block[cut:]
        if row["kind"] == "response" and row["digest"] != "sha1:" + hashlib.sha1(payload).hexdigest():
            raise ValueError(f"the payload of {row['record_id']} does not have its digest")
        row.update(head=head.decode("utf-8"), payload=payload.decode("utf-8"), payload_bytes=len(payload))
        yield row


def read_records(spark, path: str) -> DataFrame:
    """One row per record of the archives below `path`; a payload that does not have its digest raises."""
    names = [field.strip().split(" ")[0] for field in RECORD.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for row in _parse(bytes(content)):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: `capture`, `request`, `metadata` (each a struct of the record; absent ones null).

    Records concurrent to no capture are left out; of several of one kind, that with the smallest id counts.
    """
    one = F.struct(*[F.col(c) for c in records.columns])
    own = records.filter("kind IN ('response', 'revisit')").select(F.col("record_id").alias("key"), one.alias("capture"))
    for kind in ("request", "metadata"):
        side = records.filter(F.col("kind") == kind).groupBy(F.col("concurrent_to").alias("key"))
        own = own.join(side.agg(F.min_by(one, "record_id").alias(kind)), "key", "left")
    return own.drop("key")


def payload_bytes() -> Column:
    """Bytes of a capture's full payload: its own, for a revisit those that its metadata states."""
    stated = F.regexp_extract("metadata.head", "payload-bytes: ([0-9]+)", 1).cast("long")
    return F.when(F.col("capture.kind") == "response", F.col("capture.payload_bytes")).otherwise(stated)
