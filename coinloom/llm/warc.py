"""WARC archives by way of a chunked record table.

Writing: every page becomes rows (record, chunk number, text of about `chunk_chars`
characters); Spark's text sink streams them, CRLF after each row, into one gzip file a
task. The payload stands in HTTP chunked transfer coding, whose chunks end in CRLF
themselves, so a record of any size is written chunk by chunk. Of records with equal
payloads of at least `revisit_bytes` the one with the largest page id is the response, the
others are revisits of it without a payload. They are found from ids and digests alone;
payloads are not shuffled, but for those of pages that a bitmap of the revisits can't rule
out. A payload is cut into chunks in one pass.

Reading: gzip files aren't split, so a task meets a file's rows in order; a small state
machine turns them into the chunk table (record, chunk number, data, bytes so far, SHA-1
so far), never holding more than one batch of chunks. A record's last row has its whole
size and digest, checked against the header.

Null html is an empty payload; empty payloads have no chunk; pages that repeat the largest
page id of their group are all responses; rows without a page id write records without
one; an empty table writes no records. Only the id, url and html columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_by_count, materialize, maybe_flagged

REVISIT_BYTES = 1000
CHUNK_CHARS = 1 << 18
BATCH_BYTES = 4 << 20
CRLF = "\r\n"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

CHUNK_TABLE = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("last", T.BooleanType()),
    ]
)


def _lines(*lines: Column | str) -> Column:
    """The lines that aren't null, CRLF between them."""
    return F.concat_ws(CRLF, *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _clean(column: Column) -> Column:
    return F.regexp_replace(column.cast("string"), "[\r\n]", "")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, bytes, digest, refers_to): refers_to is set on revisits, whose payload is null."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    base = base.select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha1(F.encode("payload", "UTF-8")).alias("digest"))
    slim = materialize(base.drop("payload").where(F.col("bytes") >= revisit_bytes), "digests")
    groups = slim.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).where("n > 1 AND refers_to IS NOT NULL")
    revisits = join_by_count(slim, materialize(groups, "copies"), ["digest"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = materialize(revisits.select("page_id", "url", F.lit(None).cast("string").alias("payload"), "bytes", "digest", "refers_to"), "revisits")
    keys = revisits.select("page_id", "digest").distinct()
    flagged = maybe_flagged(base, keys, ("page_id", "digest"))
    listed = keys.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"))
    same = (F.col("digest") == F.col("__digest")) & F.col("page_id").eqNullSafe(F.col("__page"))
    unsure = flagged.where("__maybe").join(listed, same, "left_anti")
    responses = flagged.where("NOT __maybe").unionByName(unsure).drop("__maybe")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)


def record_rows(records: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """`value`: the archive's text, a header row, a row a chunk and an end row for each response; one row for each revisit."""
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length
    http = _lines(
        F.when(revisit, F.lit("HTTP/1.1 304 Not Modified")).otherwise(F.lit("HTTP/1.1 200 OK")),
        "Content-Type: text/html; charset=utf-8",
        F.concat(F.lit("X-Payload-Bytes: "), F.col("bytes").cast("string")),
        F.when(~revisit, F.lit("Transfer-Encoding: chunked")),
        "",
        "",
    )
    # an HTTP chunk: its size in hex, CRLF, the data, CRLF
    chunks = F.transform(F.expr(f"regexp_extract_all(coalesce(payload, ''), '(?s).{{1,{chunk_chars}}}', 0)"), lambda p: F.concat(F.hex(size(p)), F.lit(CRLF), p))
    body = F.aggregate("__chunks", F.lit(0).cast("long"), lambda acc, c: acc + size(c) + 2)
    length = size(F.col("__http")) + F.when(revisit, 0).otherwise(F.col("__body") + 5)
    head = _lines(
        "WARC/1.0",
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(":"), F.col("digest"), F.lit(">")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        f"WARC-Date: {DATE}",
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(":"), F.col("digest"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        "Content-Type: application/http; msgtype=response",
        F.concat(F.lit("Content-Length: "), F.col("__length").cast("string")),
        "",
        "",
    )
    planned = records.select("*", chunks.alias("__chunks"), http.alias("__http"))
    planned = planned.withColumn("__body", body).withColumn("__length", length).withColumn("__head", F.concat(head, F.col("__http")))
    # the sink ends each row with CRLF: two end a record; the header row's own ends the HTTP header
    whole = F.concat(F.array(F.expr("substring(__head, 1, length(__head) - 2)")), F.col("__chunks"), F.array(F.lit("0" + CRLF + CRLF + CRLF)))
    rows = F.when(revisit, F.array(F.concat("__head", F.lit(CRLF)))).otherwise(whole)
    return planned.select(F.explode(rows).alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, chunk_chars: int = CHUNK_CHARS) -> None:
    rows = record_rows(plan_records(pages, id_col, url_col, html_col, revisit_bytes), chunk_chars)
    rows.write.option("lineSep", CRLF).option("compression", "gzip").text(path)


class _Chunks:
    """Chunk rows gathered for one Arrow batch."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.bytes += len(row[5])

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        columns = [pa.array(c, k) for c, k in zip(zip(*self.rows), kinds)]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(columns, CHUNK_TABLE.names)


def _headers(lines: Iterator[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        if not line:
            return out
        name, _, value = line.decode("utf-8", "replace").partition(": ")
        out[name.lower()] = value
    raise ValueError("an archive ends inside a header")


def _page(urn: str | None) -> int | None:
    return int(urn.split(":")[2]) if urn else None


def parse_chunks(lines: Iterable[bytes], batch_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The chunk table of a stream of archive rows (without their CRLF)."""
    lines, out = iter(lines), _Chunks()
    for line in lines:
        if not line:  # the rows that end a record
            continue
        if line != b"WARC/1.0":
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = _headers(lines)
        page, kind = int(head["x-page-id"]) if "x-page-id" in head else None, head["warc-type"]
        to, told = _page(head.get("warc-refers-to")), head["warc-payload-digest"].removeprefix("sha1:")
        http = _headers(lines)
        key = (head["warc-record-id"].strip("<>"), page, kind, to)
        if kind == "revisit":
            out.add(*key, 0, b"", int(http["x-payload-bytes"]), told, True)
        else:
            digest, total, number = hashlib.sha1(), 0, 0
            while size := int(next(lines), 16):
                parts, left = [], size
                while True:  # a chunk that holds CRLF itself comes in several rows
                    parts.append(next(lines))
                    left -= len(parts[-1])
                    if left == 0:
                        break
                    left -= 2
                data = b"\r\n".join(parts)
                digest.update(data)
                total += size
                out.add(*key, number, data, total, digest.copy().hexdigest(), False)
                number += 1
                if out.bytes >= batch_bytes:
                    yield out.batch()
            if digest.hexdigest() != told or total != int(http["x-payload-bytes"]):
                raise ValueError(f"the payload of {key[0]} differs from its header")
            out.add(*key, number, b"", total, told, True)
        if len(out.rows) >= 10_000:
            yield out.batch()
    if out.rows:
        yield out.batch()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of all archives under path; a record ends with a row marked `last`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[bytes]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield from batch.column(0).slice(at, 256).cast(pa.binary()).to_pylist()

        yield from parse_chunks(rows())

    return spark.read.option("lineSep", CRLF).text(path).mapInArrow(run, CHUNK_TABLE)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record, with the whole payload's size and digest."""
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")
