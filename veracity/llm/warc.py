"""WARC archives in Zstandard: a writer and a validating reader.

An archive begins with a skippable frame (0x184D2A5D) that carries the dictionary; each
record is one frame of its own, so frames can be located from their headers alone and
decoded one at a time.  The writer goes through Spark's text sink, whose commit protocol
survives lost tasks and which reaches any store: each row is a frame, and the separator
that the sink puts after a row is itself an empty skippable frame.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.session import scratch_path

DICTIONARY, RECORD = 0x184D2A5D, 0xFD2FB528
#: An empty skippable frame; all its bytes are ASCII.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
#: Pages (least xxhash64 of the id first) and characters of each that train the dictionary.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 1_000, 8_192, 65_536
LEAST_REVISIT = 1_000
NO_ID = -(1 << 63)
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample; empty if there is too little text to train on.

    The ids are chosen first, so that only the chosen pages' text leaves its task.
    """
    pages = pages.where(F.col("html").isNotNull())
    order = F.xxhash64("page_id"), F.col("page_id")
    ids = pages.select("page_id").orderBy(*order).limit(SAMPLE_PAGES).distinct().select(F.col("page_id").alias("chosen"))
    rows = (pages.join(F.broadcast(ids), F.col("page_id").eqNullSafe(F.col("chosen")), "left_semi")  # SAMPLE_PAGES ids at most
            .select("page_id", F.substring("html", 1, SAMPLE_CHARS).alias("html")).orderBy(*order, "html").limit(SAMPLE_PAGES).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.html.encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _header(fields: dict[str, str]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode()


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = "none" if page_id is None else page_id
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{name}>", "WARC-Date": date,
              "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{name}"),
              "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        fields["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return _header(fields | {"Content-Length": str(len(block))}) + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write page_id, url, html as archives below ``path``, one file for each task.

    Null html is an empty payload.  Payloads of ``LEAST_REVISIT`` bytes or more that occur
    again become revisits of the copy with the largest page_id (null ids rank lowest; rows
    that repeat that id are responses as well).
    """
    spark = pages.sparkSession
    words = spark.sparkContext.broadcast(train_dictionary(pages))  # DICTIONARY_BYTES at most
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    again = (rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size")
             .agg(F.max(F.coalesce("page_id", F.lit(NO_ID))).alias("last"), F.count("*").alias("n")).where("n > 1").drop("n"))
    first = F.col("last").isNull() | (F.coalesce("page_id", F.lit(NO_ID)) == F.col("last"))
    ready = rows.join(again, ["digest", "size"], "left").select(
        "page_id", "url", "payload", "digest", F.when(~first, F.col("last")).alias("refers_to"))

    def frames(batches):
        data = zstandard.ZstdCompressionDict(words.value) if words.value else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True)
        if data:
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<II", DICTIONARY, len(words.value)) + words.value])], ["frame"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pack.compress(record(*x, date)) for x in zip(*(c.to_pylist() for c in b.columns))],
                                                       pa.binary())], ["frame"])

    (ready.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 0).option("compression", "none").text(path))
    return path


def frames(data: memoryview):
    """(offset, magic, bytes) of each frame, found from the frame and block headers."""
    at, end = 0, len(data)
    while at < end:
        if end - at < 8:
            raise ValueError(f"{end - at} stray bytes at {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            stop = at + 8 + size
        elif magic == RECORD:
            flags = data[at + 4]
            single, kind = flags >> 5 & 1, flags >> 6
            stop = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[kind]
            last = False
            while not last:
                if stop + 3 > end:
                    raise ValueError(f"frame at {at} is cut short")
                block = int.from_bytes(data[stop:stop + 3], "little")
                last, rle = block & 1, block >> 1 & 3 == 1
                stop += 3 + (1 if rle else block >> 3)
            stop += 4 * (flags >> 2 & 1)
        else:
            raise ValueError(f"no frame at {at}")
        if stop > end:
            raise ValueError(f"frame at {at} is cut short")
        yield at, magic, data[at:stop]
        at = stop


def parse(text: bytes) -> dict:
    """A record's fields, block and HTTP payload; raises ValueError where headers or lengths are wrong."""
    head, gap, rest = text.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header without colon: {line[:60]}")
        fields[name.strip().lower()] = value.strip()
    if missing := [x for x in REQUIRED if not fields.get(x)]:
        raise ValueError(f"missing {', '.join(missing)}")
    if not fields["content-length"].isdigit():
        raise ValueError("content-length is no number")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"block is not {n} bytes and two line ends")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    told = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    fields["payload-length"] = int(told[1]) if told else len(payload)
    if fields["warc-type"] == "response":
        if fields["payload-length"] != len(payload):
            raise ValueError("payload is not as long as its HTTP header says")
        if "warc-payload-digest" in fields and fields["warc-payload-digest"] != "sha1:" + hashlib.sha1(payload).hexdigest():
            raise ValueError("payload digest differs")
    return fields | {"payload": payload}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: file, position, record fields, payload (null for revisits) and error.

    A record that fails validation gives a row with ``error`` and no fields; where frames
    cannot be followed any more, the rest of that archive is one such row.
    """
    schema = ("file string, position long, record_type string, record_id string, target_uri string, record_date string, "
              "refers_to string, payload_digest string, payload_bytes long, payload binary, error string")
    names = [x.split()[0] for x in schema.split(", ")]

    def one(file: str, data: memoryview):
        unpack = zstandard.ZstdDecompressor()
        blank = dict.fromkeys(names) | {"file": file}
        at = 0
        try:
            for at, magic, frame in frames(data):
                if magic == DICTIONARY:
                    words = bytes(frame[8:])
                    words = zstandard.ZstdDecompressor().decompress(words) if words[:4] == struct.pack("<I", RECORD) else words
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
                elif magic == RECORD:
                    try:
                        f = parse(unpack.decompressobj().decompress(frame))
                        yield blank | {"position": at, "record_type": f["warc-type"], "record_id": f["warc-record-id"],
                                       "target_uri": f.get("warc-target-uri"), "record_date": f["warc-date"],
                                       "refers_to": f.get("warc-refers-to"), "payload_digest": f.get("warc-payload-digest"),
                                       "payload_bytes": f["payload-length"], "payload": f["payload"] if f["warc-type"] != "revisit" else None}
                    except (ValueError, zstandard.ZstdError) as e:
                        yield blank | {"position": at, "error": str(e)}
        except (ValueError, zstandard.ZstdError) as e:
            yield blank | {"position": at, "error": str(e)}

    def run(batches):
        kinds = pa.schema([(n, pa.int64() if n in ("position", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names])
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                held, size = [], 0
                for row in one(file, memoryview(content.as_buffer())):
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if size > 4 << 20 or len(held) >= 2_000:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, kinds)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc"))
    got = read_archives(spark, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return got.select(
        number("record_id").alias("page_id"), "payload_bytes",
        F.coalesce(F.sha1("payload"), F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.coalesce("record_type", F.raise_error(F.concat_ws(" ", "file", "position", "error")).cast("string")).alias("record_type"),
        number("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM q
"""
