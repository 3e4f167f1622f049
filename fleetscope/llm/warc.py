"""WARC archives as a chunked record table.

A payload of any size travels as rows (record id, chunk number, chunk); no task
holds a whole record. On disk a chunk is a WARC record of its own: the first has
``WARC-Segment-Number: 1``, the others are ``continuation`` records that name
their origin, as the format provides. Archives are written and read by Spark's
text files: written with a record's end as line end, read with a record's first
line as line end. So any store that Spark reaches will do, writes are committed per
task, and no task reads more than a segment at once.

Every segment carries its block digest. The payload digest is computed by a
running SHA-256 over a record's chunks in order.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.session import materialize

#: Bytes of payload in a segment, about; a segment ends between two characters.
CHUNK = 256 * 1024
#: Payloads below this are always responses.
LEAST = 100
#: Bytes of chunks that a task holds before it passes them on.
HELD = 4 << 20
_END = "\r\n\r\n"
_MARK = "WARC/1.1\r\n"
_CHUNKS = "record_id string, chunk int, chunks int, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, same_as string, payload string"
_FOLD = "record_id string, page_id bigint, record_type string, refers_to bigint, declared_bytes bigint, payload_bytes bigint, payload_digest string, chunks bigint, damaged boolean"


def first_of_equals(pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to, same_as): of equal payloads the smallest id is the response.

    ``same_as`` is the payload digest of a revisit, which names its response where an id is repeated.
    Payloads are compared by SHA-256. Only digests that occur more than once come
    back to the pages; where they are few they are broadcast by the planner.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    firsts = rows.where(F.col("digest").isNotNull()).groupBy("digest")
    firsts = firsts.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    firsts = materialize(firsts.select("digest", "first_id"), "warc-firsts")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    return rows.join(firsts, "digest", "left").select(
        "page_id",
        "url",
        "payload",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, F.lower(F.hex("digest"))).alias("same_as"),
    )


def _cuts(data: memoryview, size: int) -> list[tuple[int, int]]:
    """Bounds of chunks between characters, such that no chunk holds the line that begins a record."""
    sep = _MARK.encode()
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        inside = bytes(data[at:end]).find(sep)
        if inside >= 0:
            end = at + inside + len(sep) - 1
        if bytes(data[max(at, end - 8) : end]) == sep[:8]:  # the record's end would complete the line
            end -= 1
        out.append((at, end))
        at = end
    return out or [(0, 0)]


def chunk_table(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``first_of_equals`` as (record_id, chunk, ...) rows; a revisit has one row without payload."""

    def split(batches):
        rows, held = [], 0
        for batch in batches:
            for page_id, url, payload, kind, refers, same in zip(*batch.columns):
                data = memoryview(payload.as_buffer() or b"")
                total, record = len(data), str(uuid.uuid4())
                cuts = _cuts(data if kind.as_py() == "response" else data[:0], chunk)
                for number, (at, end) in enumerate(cuts, 1):
                    part = bytes(data[at:end])
                    row = (record, number, len(cuts), page_id.as_py(), url.as_py(), kind.as_py(), refers.as_py(), total, same.as_py())
                    rows.append((*row, part))
                    held += len(part)
                    if held > HELD or len(rows) == 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    return records.select("page_id", "url", "payload", "record_type", "refers_to", "same_as").mapInArrow(split, _CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.strip().split(" ")[0] for part in _CHUNKS.split(",")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)


def write_warc(chunks: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the chunk table as gzip-compressed archives, one file a task.

    ``date`` is the WARC-Date of all records. A null url is written as ``urn:page``,
    a null page_id is left out; line ends in urls are escaped, and what could begin a record.
    """
    clean_url = F.regexp_replace(F.coalesce("url", F.lit("urn:page")), "[\r\n]+", "%0A")
    clean_url = F.replace(clean_url, F.lit("WARC/"), F.lit("WARC%2F"))
    http = F.when(
        F.col("chunk") == 1,
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "payload_bytes", F.lit(_END)),
    ).otherwise(F.lit(""))
    later = F.col("chunk") > 1
    segment_id = F.when(later, F.concat("record_id", F.lit("-"), "chunk")).otherwise(F.col("record_id"))

    def header(name, value):
        text = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
        return F.coalesce(text, F.lit(""))

    urn = F.lit("urn:uuid:")
    lines = F.concat(
        F.lit(_MARK),
        header("WARC-Type", F.when(later, F.lit("continuation")).otherwise(F.col("record_type"))),
        header("WARC-Record-ID", F.concat(F.lit("<"), urn, segment_id, F.lit(">"))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", clean_url),
        header("WARC-Page-ID", F.col("page_id")),
        header("WARC-Refers-To-Page-ID", F.col("refers_to")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("same_as"))),
        header("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        header("WARC-Segment-Number", F.when(F.col("chunks") > 1, F.col("chunk"))),
        header("WARC-Segment-Origin-ID", F.when(later, F.concat(F.lit("<"), urn, F.col("record_id"), F.lit(">")))),
        header("WARC-Segment-Total-Length", F.when((F.col("chunks") > 1) & (F.col("chunk") == F.col("chunks")), F.col("payload_bytes"))),
        header("WARC-Payload-Bytes", F.when(F.col("chunk") == 1, F.col("payload_bytes"))),
        header("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(F.concat(http, F.col("payload")), 256))),
        header("Content-Type", F.when(~later, F.lit("application/http; msgtype=response"))),
        header("Content-Length", F.octet_length(F.concat(http, F.col("payload")))),
        F.lit("\r\n"),
        http,
        F.col("payload"),
    )
    chunks.select(lines.alias("value")).write.option("lineSep", _END).option("compression", "gzip").text(folder)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of archives: (record_id, chunk, page_id, record_type, refers_to, declared_bytes, same_as, payload, damaged).

    A segment whose block differs from its digest or length is marked damaged.
    """
    # each row is what follows a record's first line; the first row of a file is empty
    rows = spark.read.option("lineSep", _MARK).text(folder).where("value <> ''")
    head_end = F.locate(_END, F.col("value"))
    rows = rows.withColumn("head", F.concat(F.lit("\r\n"), F.substring("value", F.lit(1), head_end - 1), F.lit("\r\n")))
    rows = rows.withColumn("block", F.substring("value", head_end + 4, F.lit(2**31 - 1)))

    def field(name):
        return F.nullif(F.regexp_extract("head", f"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))

    length = field("Content-Length").cast("bigint")
    ended = (F.octet_length("block") == length + 4) & F.col("block").endswith(_END)
    block = F.when(ended, F.expr("left(block, length(block) - 4)")).otherwise(F.col("block"))
    rows = rows.withColumn("block", block)
    origin = F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID"))
    damaged = (F.octet_length("block") != length) | (
        F.concat(F.lit("sha256:"), F.sha2("block", 256)) != field("WARC-Block-Digest")
    )
    chunk = F.coalesce(field("WARC-Segment-Number"), F.lit("1")).cast("int")
    body = F.when(chunk == 1, F.substring("block", F.locate(_END, F.col("block")) + 4, F.lit(2**31 - 1))).otherwise(F.col("block"))
    return rows.select(
        origin.alias("record_id"),
        chunk.alias("chunk"),
        field("WARC-Page-ID").cast("bigint").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To-Page-ID").cast("bigint").alias("refers_to"),
        field("WARC-Payload-Bytes").cast("bigint").alias("declared_bytes"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("same_as"),
        field("WARC-Segment-Number").isNotNull().alias("segmented"),
        body.alias("payload"),
        F.coalesce(damaged, F.lit(True)).alias("damaged"),
    )


def fold_records(segments: DataFrame) -> DataFrame:
    """One row a record, with length and digest of its payload.

    A record of one segment is digested where it is. The segments of larger ones
    meet in order of their number, and a running digest takes one after another.
    """
    single = segments.where("NOT segmented").select(
        "record_id",
        "page_id",
        "record_type",
        "refers_to",
        "declared_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        F.lit(1).cast("bigint").alias("chunks"),
        "damaged",
        "same_as",
    )

    def fold(batches):
        names = [part.strip().split(" ")[0] for part in _FOLD.split(",")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        state = None

        def closed(s):
            bad = s["bad"] or s["bytes"] != s["row"][4]
            row = (*s["row"], s["bytes"], s["sha"].hexdigest(), s["chunks"], bad)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        for batch in batches:
            for record, chunk, page, kind, refers, declared, payload, bad in zip(*batch.columns):
                if state is None or state["id"] != record.as_py():
                    if state:
                        yield closed(state)
                    row = (record.as_py(), page.as_py(), kind.as_py(), refers.as_py(), declared.as_py())
                    state = {"id": record.as_py(), "row": row, "sha": hashlib.sha256(), "bytes": 0, "chunks": 0, "bad": False}
                data = payload.as_buffer()
                state["sha"].update(data)
                state["bytes"] += len(data)
                state["chunks"] += 1
                state["bad"] |= bad.as_py() or chunk.as_py() != state["chunks"]
        if state:
            yield closed(state)

    parts = segments.where("segmented").select(
        "record_id", "chunk", "page_id", "record_type", "refers_to", "declared_bytes", "payload", "damaged"
    )
    parts = parts.repartition("record_id").sortWithinPartitions("record_id", "chunk")
    # revisits have no payload and so one segment
    return single.unionByName(parts.mapInArrow(fold, _FOLD).withColumn("same_as", F.lit(None).cast("string")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Gives revisits the length and digest of the response they refer to, by its id and payload digest.

    However often a response is repeated, a revisit stays one row.
    """
    answer = ["refers_to", "same_as"]
    responses = records.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("same_as"), F.col("payload_bytes").alias("_bytes")
    )
    revisits = records.where("record_type = 'revisit'")
    wanted = revisits.select(*answer).distinct()
    responses = responses.join(wanted, answer, "left_semi").groupBy(*answer).agg(F.max("_bytes").alias("_bytes"))
    responses = materialize(responses, "warc-responses")
    resolved = revisits.join(responses, answer, "left").withColumns(
        {"payload_bytes": F.col("_bytes"), "payload_digest": F.when(F.col("_bytes").isNotNull(), F.col("same_as"))}
    )
    return records.where("record_type <> 'revisit'").unionByName(resolved.drop("_bytes")).drop("same_as")


def round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Writes a record for every row of ``pages`` to ``folder`` and reads the archives back.

    One row a page: page_id, payload_bytes, payload_digest, record_type, refers_to,
    chunks, damaged. A null payload counts as empty; payloads below ``LEAST`` bytes
    are never revisits. Rows without an id keep their records; a row that repeats the
    response's id is a response as well. Columns other than id, url and payload are
    not read; no rows give no rows.
    """
    write_warc(chunk_table(first_of_equals(pages, id_col, payload_col), chunk), folder)
    records = materialize(fold_records(read_warc(pages.sparkSession, folder)), "warc-records")
    return resolve_revisits(records)
