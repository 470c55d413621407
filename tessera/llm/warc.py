"""WARC archives: written from pages, read back, and assembled into captures.

Each page becomes three records: a request, its response (or a revisit, when an earlier page has the same payload), and
metadata. The latter two name the capture's main record in WARC-Concurrent-To, and reading joins them by it.
A page of any length is one value in one task; nothing longer is held.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, salted_lookup, scratch_path

CRLF = "\r\n"
#: Fixed values of the format and of these archives.
VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages of one archive file, so that a few long tasks don't read all: files are split no further. Any size is read as a stream.
FILE_PAGES = 1000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: F.Column) -> F.Column:
    """Bare upper-case base32 of the SHA-1: its 40 hex digits are eight groups of five, each of them four letters."""
    digits = F.sha1(payload)
    groups = [F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(_ALPHABET), F.shiftright(g, 15 - 5 * j).bitwiseAND(31) + 1, 1) for g in groups for j in range(4)])


def _record(kind: str, record_id: F.Column, headers: list[tuple[str, F.Column]], block: F.Column) -> F.Column:
    """A record without the two line ends that follow it: header lines with a null value are left out."""
    lines = [F.concat(F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), record_id, F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}"))]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in headers]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def _urn(kind: str, digest: F.Column, page: F.Column) -> F.Column:
    """Ids are unique to a page and payload, so that rows of one id with other payloads are other records."""
    return F.concat(F.lit(f"<urn:page:{kind}:"), digest, F.lit(":"), page.cast("string"), F.lit(">"))


def write(pages: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, revisit_from: int = 0) -> None:
    """Write WARC files under ``path``.

    Null payloads and URLs count as empty. Of pages with equal payloads of at least ``revisit_from`` bytes, that with the smallest id is
    a response and others revisit it; smaller payloads are all responses. Rows with a null id are left out; repeated rows are a
    capture each. An empty table gives an archive without records. Other columns are ignored.

    Equal payloads are found by digest, of which one row each leaves a task before the shuffle; the payloads of a common digest are
    dealt over several tasks. Files are written by Spark's text writer, so any file system and commit protocol serves.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "%0A")
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), url.alias("_url"), payload.alias("_payload"))
    rows = rows.withColumn("_key", F.sha2(F.col("_payload").cast("binary"), 256))
    # The columns that equal payloads are found by are made apart, so that payloads aren't shuffled for it.
    least = rows.where(F.octet_length("_payload") >= revisit_from).groupBy("_key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").select("_key", "_first")
    rows = salted_lookup(rows, least, "_key", F.col("_id"))
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("_payload").cast("binary")))
    length = F.octet_length("_payload").cast("string")
    page, first = F.col("_id"), F.when(F.col("_first") < F.col("_id"), F.col("_first"))
    main = _urn("response", F.col("_key"), page)
    target = F.col("_url")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF * 2))
    request = _record("request", _urn("request", F.col("_key"), page), [("WARC-Target-URI", target), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    kept = [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http;msgtype=response"))]
    response = _record("response", main, kept, F.concat(http, F.col("_payload")))
    revisit = _record("revisit", main, [*kept, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _urn("response", F.col("_key"), first))], http)
    metadata = _record("metadata", _urn("metadata", F.col("_key"), page), [("WARC-Target-URI", target), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("pageId: "), page.cast("string"), F.lit(f"{CRLF}payloadLength: "), length, F.lit(CRLF)))
    end = F.lit(CRLF * 2)
    capture = F.concat(request, end, F.when(first.isNull(), response).otherwise(revisit), end, metadata)
    one = rows.select(capture.alias("value"))
    one.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_PAGES).text(path)


FIELDS = pa.schema([(x, pa.string()) for x in ("record_type", "record_id", "concurrent_to", "refers_to", "target_uri", "payload_digest")] + [("payload_bytes", pa.int64()), ("actual_digest", pa.string()), ("block", pa.binary())])


class Parser:
    """Records out of an archive's bytes, which come in pieces: what stands between two double line ends.

    Nothing but the record at hand is kept. A record whose length isn't a number is passed over, and a cut-off last one left out.
    """

    def __init__(self):
        self.headers: dict[str, str] | None = None
        self.block = bytearray()
        self.size = 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers (names in lower case) and block of each record that the piece completes."""
        while True:
            if self.headers is None:
                piece = piece.lstrip(CRLF.encode())
                if not piece.startswith(b"WARC/"):
                    return
                lines = piece.decode("utf-8", "replace").split(CRLF)[1:]
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                size = headers.get("content-length", "0")
                if size.isascii() and size.isdigit():
                    self.headers, self.size, self.block, self.begun = headers, int(size), bytearray(), False
                return
            if self.begun:
                self.block += b"\r\n\r\n"
            self.block += piece
            self.begun = True
            if len(self.block) < self.size:
                return
            piece = bytes(self.block[self.size :])
            headers, self.headers = self.headers, None
            yield headers, bytes(self.block[: self.size])
            if not piece:
                return


def read(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records of the archives under ``path``; without ``blocks``, their payloads' lengths and digests only.

    Archives stream through Spark's text reader (a gzip file is one split), so neither an archive nor its content is ever held whole; one
    record is.
    """
    lines = spark.read.option("lineSep", CRLF * 2).option("pathGlobFilter", "*.gz").text(path)
    pieces = lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("_file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, file = Parser(), None
        rows: list[list] = [[] for _ in FIELDS]
        held = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, FIELDS, strict=True)], schema=FIELDS)

        for batch in batches:
            files = batch.column(1).dictionary_encode()
            for value, of in zip(batch.column(0), files.indices.to_pylist(), strict=True):
                if (name := files.dictionary[of].as_py()) != file:
                    parser, file = Parser(), name
                for headers, block in parser.feed(value.as_py()):
                    kind = headers.get("warc-type", "")
                    payload = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit") else block
                    digest = headers.get("warc-payload-digest")
                    actual = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None
                    got = (kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest and digest.partition(":")[2])
                    for into, x in zip(rows, (*got, len(payload), actual, block if blocks or kind == "metadata" else None), strict=True):
                        into.append(x)
                    held += len(block) if blocks else 200
                    if held > 4 << 20:
                        yield made()
                        rows, held = [[] for _ in FIELDS], 0
        yield made()

    return pieces.mapInArrow(run, "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes bigint, actual_digest string, block binary")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: ``record_id``, and ``response`` (or revisit), ``request`` and ``metadata`` as structs.

    Requests and metadata are joined to the main record that they name as concurrent; where several name one, that of the smallest id is
    taken, and a main record without one has a null there. Requests and metadata without their main record are left out.
    """
    main = records.where(F.col("record_type").isin("response", "revisit"))
    main = main.select("record_id", F.struct("record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "actual_digest", "block").alias("response"))

    def beside(kind: str) -> DataFrame:
        rows = records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        one = F.struct("record_id", "target_uri", "block")
        return rows.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(one, "record_id").alias(kind))

    return main.join(beside("request"), "record_id", "left").join(beside("metadata"), "record_id", "left")


def field_of(metadata: F.Column, name: str) -> F.Column:
    """A field of a metadata record's block."""
    return F.regexp_extract(metadata["block"].cast("string"), rf"(?m)^{name}: (-?\d+)\r?$", 1).try_cast("bigint")


def resolved(captures: DataFrame) -> DataFrame:
    """Captures with ``page_id``, ``payload_bytes``, ``payload_digest`` and ``refers_to`` (the page of the response that a revisit names, or null).

    ``page_id`` is what the joined metadata record says. A revisit's payload is its response's; where that isn't in the archives, its digest is the
    revisit's own and its length null.
    """
    captures = captures.withColumn("page_id", field_of(F.col("metadata"), "pageId"))
    full = captures.where("response.record_type = 'response'").select(F.col("record_id").alias("_to"), F.col("page_id").alias("_page"), F.col("response.payload_bytes").alias("_bytes"), F.col("response.actual_digest").alias("_digest")).dropDuplicates(["_to"])
    named = captures.where("response.record_type = 'revisit'").select(F.col("response.refers_to").alias("_to")).distinct()
    wanted = full.join(named, "_to", "left_semi")
    rows = salted_lookup(captures.withColumn("_to", F.col("response.refers_to")), wanted, "_to", F.col("record_id"))
    own = F.col("response.record_type") == "response"
    return rows.select(
        "page_id", "record_id", "request", "response", "metadata",
        F.when(own, F.col("response.payload_bytes")).otherwise(F.col("_bytes")).alias("payload_bytes"),
        F.when(own, F.col("response.actual_digest")).otherwise(F.coalesce("_digest", "response.payload_digest")).alias("payload_digest"),
        F.when(~own, F.col("_page")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", blocks: bool = False) -> DataFrame:
    """Write the pages into archives in the shared folder, read them back once and assemble the captures."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, id_col, url_col, payload_col)
    records = materialise(read(spark, path, blocks=blocks), "records")
    return resolved(materialise(assemble(records), "captures"))


def oracle() -> str:
    """DuckDB SQL for the captures of all pages."""
    letters = "list_aggregate(list_transform(range(0, 32), lambda i: substr('" + _ALPHABET + "', (((('0x' || substr(h, (1 + 5 * (i // 4))::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), 'string_agg', '')"
    return f"""
        with p as (select page_id, coalesce(html, '') as body, regexp_replace(coalesce(url, ''), '[\r\n]', '%0A', 'g') as target from pages where page_id is not null),
        f as (select *, min(page_id) over (partition by body) as first, sha1(body) as h from p)
        select page_id, octet_length(encode(body))::bigint as payload_bytes, {letters} as payload_digest, case when first < page_id then 'revisit' else 'response' end as record_type,
            case when first < page_id then first end as refers_to, target as request_target, octet_length(encode(body))::bigint as declared_bytes from f"""
