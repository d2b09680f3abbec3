"""WARC archives: written from pages, read back, and assembled to one nested row per capture."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm.common import stored
from tillbook.sources.workspace import scratch_path

#: Shorter payloads are written again rather than referred to.
LEAST_REVISIT = 1000
#: Records in a file at most, which bounds the files that are read whole.
FILE_RECORDS = 10_000
DATE = "1970-01-01T00:00:00Z"
_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- Writing ----------------------------------------------------------------------------------


def captures(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Each page as one capture: page_id, url, html, digest, nth, and ``first``, the capture it revisits or null.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest page_id (nulls last, then the largest url) is kept
    whole and the others revisit it. Rows that repeat in full are captures of their own, told apart by ``nth``.

    Which payloads repeat is found on short rows without the payloads. Their table is written, so that Spark knows
    its size and broadcasts it if it is small; else both sides are shuffled on the digest, and adaptive execution
    splits that of a payload with a third of all pages.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"))
    size = F.octet_length(payload).alias("size")
    rows = pages.select("page_id", "url", F.sha1(payload).alias("digest"), size).groupBy("digest", "size", "page_id", "url").count()
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "url")
    groups = rows.groupBy("digest", "size").agg(F.max(rank).alias("first"), F.sum("count").alias("all"))
    shared = (F.col("size") >= least) & (F.col("all") > 1)
    repeated = stored(
        rows.join(groups, ["digest", "size"])
        .where(shared | (F.col("count") > 1))
        .select("digest", "page_id", "url", F.col("count").alias("n"), F.when(shared, F.col("first")).alias("first")),
        "warc-repeated",
    ).alias("r")
    same = (
        (F.col("p.digest") == F.col("r.digest"))
        & F.col("p.page_id").eqNullSafe(F.col("r.page_id"))
        & F.col("p.url").eqNullSafe(F.col("r.url"))
    )
    found = keyed.alias("p").join(repeated, same, "left").select("p.*", "r.n", "r.first")
    once = found.where(F.coalesce("n", F.lit(1)) == 1).withColumn("nth", F.lit(0))
    again = (
        found.where("n > 1")
        .dropDuplicates(["digest", "page_id", "url"])
        .withColumn("nth", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    )
    itself = (F.col("nth") == 0) & F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first.url").eqNullSafe(F.col("url"))
    return once.unionByName(again).withColumn("first", F.when(~itself, F.col("first"))).drop("n")


def _record_id(kind: str, page_id: Column, url: Column, digest: Column, nth: Column) -> Column:
    """The same id for the same record each time it is computed, as a retried task must write it again."""
    parts = [F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("")), digest, nth.cast("string")]
    h = F.md5(F.concat_ws("\n", *parts))
    cuts = [F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: str, fields: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """Headers and block; a field that is null is left out. The writer puts the two line ends after a record."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(_END, *lines), F.lit(_END * 2), block)


def write_archives(pages: DataFrame, path: str, date: str = DATE, least: int = LEAST_REVISIT) -> None:
    """Write three records for each page: a response or revisit, and a request and a metadata record concurrent to it.

    Spark's text writer ends each record with the two line ends of the format, so the files are
    WARC 1.1 as it stands; each file is compressed as a whole. A null html is an empty payload; a null url leaves the target out.
    Line ends within a url are percent-encoded.
    """
    found = captures(pages, least)
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    own = [F.col(c) for c in ("page_id", "url", "digest", "nth")]
    first = [F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.lit(0)]
    record_id = {kind: _record_id(kind, *own) for kind in ("request", "response", "metadata")}
    refers_to = F.when(F.col("first").isNotNull(), _record_id("response", *first))
    when = ("WARC-Date", F.lit(date))
    target = ("WARC-Target-URI", uri)
    with_main = ("WARC-Concurrent-To", record_id["response"])
    payload_digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END * 2}")
    main = [("WARC-Record-ID", record_id["response"]), when, target, payload_digest]
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1)
    request = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("-")), F.lit(f" HTTP/1.1{_END}Host: "), host, F.lit(_END * 2))
    metadata = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_END))
    response_type = "application/http;msgtype=response"
    records = F.array(
        F.when(
            F.col("first").isNull(),
            _record("response", main, response_type, F.concat(http, F.coalesce("html", F.lit("")))),
        ).otherwise(
            _record("revisit", [*main, ("WARC-Refers-To", refers_to), ("WARC-Profile", F.lit(_PROFILE))], response_type, http)
        ),
        _record("request", [("WARC-Record-ID", record_id["request"]), when, target, with_main], "application/http;msgtype=request", request),
        _record("metadata", [("WARC-Record-ID", record_id["metadata"]), when, with_main], "application/warc-fields", metadata),
    )
    (
        found.select(F.explode(records).alias("value"))
        .write.option("lineSep", _END * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(path)
    )


# --- Reading ----------------------------------------------------------------------------------

_RECORD = (
    "record_id string, type string, date string, uri string, concurrent_to string, refers_to string, "
    "payload_digest string, content_type string, http_header string, payload binary, payload_bytes long, payload_sha1 string"
)


_CHUNK = 1 << 20


def inflate(content: bytes) -> Iterator[bytes]:
    """The text of a file in parts of a bounded size: of all its gzip (or zlib) members one after another, or as it is."""
    if content[:2] != b"\x1f\x8b" and content[:1] != b"\x78":
        yield from (content[at : at + _CHUNK] for at in range(0, len(content), _CHUNK))
        return
    rest = content
    while rest:
        member = zlib.decompressobj(47)  # 47: gzip or zlib, by the header
        data = rest
        while not member.eof:
            part = member.decompress(data, _CHUNK)
            data = member.unconsumed_tail
            if part:
                yield part
            elif not member.eof:
                raise ValueError("the archive's last member is cut off")
        rest = member.unused_data.lstrip(b"\0")


def split_records(parts: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and the block of every record, by its Content-Length. One record is held at a time."""
    parts, data, at = iter([parts] if isinstance(parts, bytes) else parts), bytearray(), 0

    def have(size: int) -> bool:
        while len(data) < size:
            part = next(parts, None)
            if part is None:
                return False
            data.extend(part)
        return True

    while have(1):
        seen = 0
        while (end := data.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(data) - 3)
            if not have(len(data) + 1):
                raise ValueError(f"the record at byte {at} has no end of its headers")
        version, *lines = data[:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start, size = end + 4, int(headers["content-length"])
        if not have(start + size + 4) or data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield headers, bytes(data[start : start + size])
        at += start + size + 4
        del data[: start + size + 4]


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives at ``path``; ``payload`` is null if ``payloads`` is false, its size and digest are there still.

    Archives may be plain or compressed, as a whole or with a gzip member for each record or for some; one that is cut off is
    an error. A file is one row of Spark's binary reader, which reads any store: compressed it must stay under 2 GB. It is unpacked
    as a stream, of which one record is held at a time. For HTTP blocks the payload is what follows the header, for others the
    block.
    """
    schema = spark.createDataFrame([], _RECORD).schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for headers, block in split_records(inflate(content.as_py())):
                    rows.append(_row(headers, block, payloads))
                    size += len(rows[-1]["payload"] or b"")
                    if len(rows) == 1000 or size > 16 * _CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, arrow)

    arrow = pa.schema(
        [(f.name, {"binary": pa.binary(), "bigint": pa.int64()}.get(f.dataType.simpleString(), pa.string())) for f in schema]
    )
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, schema)


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> dict:
    header, payload = "", block
    if headers.get("content-type", "").startswith("application/http"):
        header, _, payload = block.partition(b"\r\n\r\n")
        header = header.decode("utf-8", "replace")
    kept = payloads or headers["warc-type"] == "metadata"
    return {
        "record_id": headers["warc-record-id"],
        "type": headers["warc-type"],
        "date": headers.get("warc-date"),
        "uri": headers.get("warc-target-uri"),
        "concurrent_to": headers.get("warc-concurrent-to"),
        "refers_to": headers.get("warc-refers-to"),
        "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "content_type": headers.get("content-type"),
        "http_header": header,
        "payload": payload if kept else None,
        "payload_bytes": len(payload),
        "payload_sha1": hashlib.sha1(payload).hexdigest(),
    }


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` (the response or revisit), its ``request`` and its ``metadata``.

    Requests and metadata meet the capture that their concurrent-to identifier names, in one shuffle of all records: each key is
    combined in the map tasks, so records that name one capture in great number are one row there. A capture without a request
    or metadata record has null, of several the one with the smallest record id counts, and records
    that name no capture at hand are left out.
    """
    fields = F.struct(*records.columns)

    def beside(*kinds: str) -> Column:
        own = F.col("type").isin(*kinds)
        return F.min_by(F.when(own, fields), F.when(own, F.col("record_id")))

    key = F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    together = records.groupBy(key.alias("_capture")).agg(
        beside("response", "revisit").alias("capture"),
        beside("request").alias("request"),
        beside("metadata").alias("metadata"),
    )
    return together.where("capture is not null").drop("_capture")


def with_originals(captures: DataFrame) -> DataFrame:
    """Assembled captures with ``original`` (capture and metadata): what a revisit refers to, null if it isn't there. A response is
    its own original.

    Only revisits are joined. A response that a third of all captures refer to is one row of its side; adaptive execution splits the
    other side.
    """
    original = F.struct("capture", "metadata")
    revisit = F.col("capture.type") == "revisit"
    whole = captures.where(~revisit)
    originals = whole.select(F.col("capture.record_id").alias("_id"), original.alias("original"))
    revisits = captures.where(revisit).withColumn("_id", F.col("capture.refers_to"))
    return whole.withColumn("original", original).unionByName(revisits.join(originals, "_id", "left").drop("_id"))


def page_id_of(metadata: Column) -> Column:
    """The page_id that a metadata record holds; null if it holds none."""
    found = F.regexp_extract(F.decode(metadata["payload"], "UTF-8"), r"pageId: (-?\d+)", 1)
    return F.when(found != "", found.cast("long"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages to archives, read them back, assemble, and return one row per page.

    payload_bytes and payload_digest are those of the whole payload: of a revisit, those of the record it refers to. A null
    page_id stays null, and so does refers_to if all equal pages lack one. An empty table gives no rows. Other
    columns than page_id, url and html are not used.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    captures = stored(assemble(read_records(spark, path, payloads=False)), "warc-captures")
    return with_originals(captures).select(
        page_id_of(F.col("metadata")).alias("page_id"),
        F.col("original.capture.payload_bytes").alias("payload_bytes"),
        F.col("original.capture.payload_sha1").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.when(F.col("capture.type") == "revisit", page_id_of(F.col("original.metadata"))).alias("refers_to"),
    )
