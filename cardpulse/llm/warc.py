"""WARC archives with dictionary compression, written and read by Spark.

Each archive is one file: a skippable frame that holds a Zstandard dictionary, then one frame per
record, compressed on its own with that dictionary, so that any record can be read by itself.
The dictionary is built from a stated sample of the records being archived.  Between the records
stands an empty skippable frame, which every Zstandard reader passes over; it lets Spark's own
text writer lay the frames one after another, so the files are committed by Spark's commit
protocol on any file system, and an executor lost while writing leaves no half archive.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, that with the least id is
stored; the others are revisit records that name it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.llm.common import materialise, scratch_path, table

MIN_REVISIT = 100
DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS = 1000        # records the dictionary is built from, about
SAMPLE_BYTES = 8 << 10       # and of each so many bytes
ARCHIVE_BYTES = 32 << 20     # payload in one archive, about
LEVEL = 3
# Frame marks (little endian) of the Zstandard and WARC/1.1 formats.
DICTIONARY_MAGIC = b"\x5D\x2A\x4D\x18"
SKIP_MAGICS = tuple(bytes([0x50 + i]) + b"\x2A\x4D\x18" for i in range(16))
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
             min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to), one row per row of ``pages``.
    A null payload is empty.  Rows with a null id never stand for others."""
    body = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")) \
        .withColumn("payload_digest", F.sha2("payload", 256))
    first = (rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest")
             .agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(F.col("payload_digest").alias("_digest"), "least"))
    return rows.join(first, F.col("payload_digest") == F.col("_digest"), "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(F.col("least") < F.col("page_id"), F.col("least"))
        .when(F.col("page_id").isNull(), F.col("least")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, n: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP headers only."""
    import hashlib
    from urllib.parse import quote

    uri = quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(rows: DataFrame, stored: int, n: int, sample_bytes: int, size: int) -> bytes:
    """Built from the first bytes of about ``n`` of the ``stored`` payloads, chosen by a hash of id and digest;
    empty if they are too few."""
    import zstandard

    share = min(1.0, n / max(stored, 1))
    chosen = F.pmod(F.xxhash64("page_id", "payload_digest"), F.lit(1 << 40)) < int(share * (1 << 40))
    sample = (rows.where(F.col("refers_to").isNull() & (F.col("payload_bytes") > 0) & chosen)
              .select("payload_digest", F.substring("payload", 1, sample_bytes).alias("p")).collect())
    sample.sort(key=lambda r: r["payload_digest"])
    texts = [record(0, None, bytes(r["p"]), len(r["p"]), r["payload_digest"], None) for r in sample]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, texts)) // 8)), texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> None:
    """Write ``classify()`` rows as archives of about ``archive_bytes`` of payload under ``path``."""
    spark = rows.sparkSession
    found = rows.agg(F.sum(F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0) + F.lit(512)).alias("b"),
                     F.count_if(F.col("refers_to").isNull()).alias("n")).first()
    total = found["b"] or 0
    dictionary = _dictionary(rows, found["n"], SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES)
    shared = spark.sparkContext.broadcast(dictionary)
    leading = DICTIONARY_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        c = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True)
        first = True
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            frames = [leading] if first and batch.num_rows else []
            first = first and not batch.num_rows
            frames += [c.compress(record(*row)) for row in zip(*cols)]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    lean = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
                       "payload_bytes", "payload_digest", "refers_to")
    n = max(1, -(-int(total) // archive_bytes))
    dealt = lean.withColumn("_row", F.monotonically_increasing_id()).repartition(n, "_row").drop("_row")
    (dealt.mapInArrow(compress, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", EMPTY_FRAME).text(path))


def _frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at ``at`` ends: its blocks are walked by their three-byte headers."""
    import zstandard

    end, last = at + zstandard.frame_header_size(data[at:at + 18]), 0
    while not last:
        head = int.from_bytes(data[end:end + 3], "little")
        last, kind, size = head & 1, (head >> 1) & 3, head >> 3
        end += 3 + (1 if kind == 1 else size)
    return end + (4 if data[at + 4] & 4 else 0)


def parse(data: bytes) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of each record of one
    archive, digests checked."""
    import hashlib

    import zstandard

    at, d, view = 0, zstandard.ZstdDecompressor(), memoryview(data)
    while at < len(data):
        mark = data[at:at + 4]
        if mark in SKIP_MAGICS:
            size = int.from_bytes(data[at + 4:at + 8], "little")
            if mark == DICTIONARY_MAGIC and size:
                d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8:at + 8 + size]))
            at += 8 + size
            continue
        end = _frame_end(data, at)
        raw = d.decompress(view[at:end])
        at = end
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                      for line in head.decode().split("\r\n")[1:])
        block = rest[:int(fields["Content-Length"])]
        if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(http.rpartition(b"Content-Length: ")[2].split(b"\r")[0])
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
        if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
        ids = [fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To")]
        yield (int(ids[0]) if ids[0] else None, n, digest, kind, int(ids[1]) if ids[1] else None,
               payload if kind == "response" else None)


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the archives under ``path``; with ``payload`` also their bytes (null for revisits)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    keep = len(names) - (not payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for row in parse(data.as_py()):
                    rows.append(row[:keep])
                    held += len(row[5] or b"") if payload else 0
                    if len(rows) == 4096 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names[:keep])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names[:keep])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, schema + (", payload binary" if payload else ""))


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) to archives under ``path`` and read them back.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to), one row per row of
    ``pages``.  Null html is an empty payload, a null url an empty target; rows with a null id are
    written with an empty id, revisit an equal payload that has one, and are responses otherwise;
    of rows with equal id and payload all are responses.  No rows give no records.
    """
    write(materialise(classify(pages)), path)
    return read(pages.sparkSession, path)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"), scratch_path(spark))


OP8_SQL = """
with p as (
  select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as payload_bytes,
         sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as least from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
       case when f.least < page_id then 'revisit' else 'response' end as record_type,
       case when f.least < page_id then f.least end as refers_to
from p left join f using (payload_digest)
"""
