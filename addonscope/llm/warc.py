"""WARC archives in which equal payloads are kept once and other records revisit them.

Headers without payloads are shuffled by payload digest; of each digest one record stays a
response. The others become revisit records that name it. Archives are written by Spark's
text writer, one record a row, with the two line ends that close a record as separator, so
that files appear only when their task has ended. They are compressed, so each is read by
one task from its start, which is the only way to tell records from payloads that look
like records: the reader follows the lengths in the headers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from addonscope.session import materialize

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no time of capture; a caller that knows one passes it.
DATE = "1970-01-01T00:00:00Z"
#: Payloads of fewer bytes are always kept.
LEAST_BYTES = 0
#: Shares into which the headers of one digest are dealt to meet their response.
SHARES = 16
RECORDS = (
    "file string, type string, record_id string, page_id bigint, target_uri string, date string, "
    "payload_digest string, refers_to_id string, http string, payload binary"
)
_END = b"\r\n\r\n"
#: Bytes of payloads that the reader gathers before it hands rows on.
_BATCH_BYTES = 1 << 20
#: Pieces of a batch that the reader takes at a time.
_PIECES = 256


def base32_sha1(data: Column) -> Column:
    """SHA-1 of a binary column in base 32, upper case: 20 bits, five hexadecimal digits, at a time."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, i * 5 + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(name: Column) -> Column:
    """A record id: a name-based UUID."""
    h = F.sha1(name)
    group = lambda first, n: F.substring(h, first, n)
    return F.concat(
        F.lit("<urn:uuid:"), group(1, 8), F.lit("-"), group(9, 4), F.lit("-5"), group(14, 3), F.lit("-a"),
        group(18, 3), F.lit("-"), group(21, 12), F.lit(">"),
    )


def _uri(url: Column, page_id: Column) -> Column:
    """The url with control characters and spaces escaped, so that it stays on its line."""
    for plain, escaped in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        url = F.replace(url, F.lit(plain), F.lit(escaped))
    return F.coalesce(url, F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none"))))


def _pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, bytes, name); rows with equal names are equal."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn(
        "bytes", F.octet_length("payload").cast("bigint")
    )
    name = F.concat_ws(
        "\n", "digest", F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.when(F.col("url").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "url")),
    )
    return rows.withColumn("name", F.sha2(name.cast("binary"), 256))


def headers(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One row for each different page: who answers for its payload.

    (page_id, url, digest, bytes, name, copies, first_name, first_id, first_url): ``copies``
    equal pages; ``first_*`` is the page with the smallest id (nulls last, then the smallest
    name) among those of its digest, or the page itself where its payload is smaller than
    ``least_bytes``. No payload is shuffled; a digest's headers are dealt in shares.
    """
    each = _pages(pages).groupBy("name").agg(
        *(F.any_value(c).alias(c) for c in ("page_id", "url", "digest", "bytes")), F.count("*").alias("copies")
    )
    each = materialize(each, "warc_headers")
    order = F.struct(F.col("page_id").isNull(), "page_id", "name", "url")
    shared = each.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(
        F.min(order).alias("first"), F.count("*").alias("members")
    )
    shared = shared.where("members > 1").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    dealt = each.withColumn("share", F.pmod(F.xxhash64("name"), F.lit(SHARES)).cast("int"))
    joined = dealt.join(shared, ["digest", "share"], "left").withColumn(
        "first", F.when(F.col("bytes") >= least_bytes, F.col("first"))
    )
    own = F.col("first").isNull()
    return joined.select(
        "page_id", "url", "digest", "bytes", "name", "copies",
        F.when(own, F.col("name")).otherwise(F.col("first.name")).alias("first_name"),
        F.when(own, F.col("page_id")).otherwise(F.col("first.page_id")).alias("first_id"),
        F.when(own, F.col("url")).otherwise(F.col("first.url")).alias("first_url"),
    )


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; those whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")) for name, value in pairs]
    return F.concat(F.lit(f"{VERSION}\r\n"), *(F.coalesce(line, F.lit("")) for line in lines), F.lit("\r\n"))


def _http(size: Column) -> Column:
    return F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        size.cast("string"), F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """(record): the text of one WARC record for each row of ``pages`` (page_id, url, html).

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest
    page_id is a response, the others are revisits of it, with fresh headers and no payload.
    Equal ids among them give the response to one row; null ids come last. Equal pages with
    smaller payloads are responses each. A null html is an empty payload, a null url becomes
    a urn, other columns are ignored, no pages give no records. Payloads may have any length
    that one row can have.

    Payloads are shuffled once, by page; equal pages are one before that shuffle.
    """
    known = materialize(headers(pages, least_bytes), "warc_first")
    is_first = F.col("name") == F.col("first_name")
    small = F.col("bytes") < least_bytes
    http = _http(F.col("bytes"))
    uri = _uri(F.col("url"), F.col("page_id"))

    def record_id(name: Column, copy: Column) -> Column:
        return _urn(F.concat_ws("#", name, copy.cast("string")))

    def copies_from(first: int) -> Column:
        return F.explode(
            F.when(F.col("copies") >= first, F.sequence(F.lit(first).cast("bigint"), F.col("copies"))).otherwise(
                F.array().cast("array<bigint>")
            )
        ).alias("copy")

    revisits = known.where(~small)
    revisits = revisits.where(~is_first).select("*", copies_from(1)).unionByName(
        revisits.where(is_first).select("*", copies_from(2))
    )
    revisit_head = _lines(
        ("WARC-Type", F.lit("revisit")),
        ("WARC-Record-ID", record_id(F.col("name"), F.col("copy"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", uri),
        ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Refers-To", record_id(F.col("first_name"), F.lit(1))),
        ("WARC-Refers-To-Target-URI", _uri(F.col("first_url"), F.col("first_id"))),
        ("WARC-Refers-To-Date", F.lit(date)),
        ("Page-Id", F.col("page_id")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(http)),
    )
    kept = known.where(is_first).select("name", "copies")
    same = Window.partitionBy("name").orderBy("name")
    responses = _pages(pages).withColumn("n", F.row_number().over(same)).where("n = 1").join(kept, "name")
    responses = responses.withColumn("last", F.when(small, F.col("copies")).otherwise(F.lit(1)))
    responses = responses.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "last")))
    response_head = _lines(
        ("WARC-Type", F.lit("response")),
        ("WARC-Record-ID", record_id(F.col("name"), F.col("copy"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("Page-Id", F.col("page_id")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(http) + F.col("bytes")),
    )
    return responses.select(F.concat(response_head, http, "payload").alias("record")).unionByName(
        revisits.select(F.concat(revisit_head, http).alias("record"))
    )


def write(rows: DataFrame, path: str) -> None:
    """Writes records (record) as compressed archives below ``path``."""
    rows.select("record").write.option("lineSep", _END.decode()).option("compression", "gzip").text(path)


class _Reader:
    """Puts records together from the pieces of a file, in order.

    A piece may end within a payload, or begin within the separator of two records where a
    payload ends with a line end, so records are cut by their lengths alone.
    """

    def __init__(self):
        self.file: str | None = None
        self.parts: list[bytes] = []
        self.held = self.needed = 0
        self.open = False

    def feed(self, file: str, piece: bytes) -> Iterator[tuple]:
        if file != self.file:
            yield from self.close()
            self.file, self.open = file, False
        if self.open:
            # what lay between two pieces was the separator
            self._add(_END)
        self.open = True
        self._add(piece)
        yield from self._rows()

    def close(self) -> Iterator[tuple]:
        """What the file's last separator completes."""
        if self.held:
            self._add(_END)
            yield from self._rows()
        if self.held:
            raise ValueError(f"{self.file} ends within a record")

    def _add(self, data: bytes) -> None:
        self.parts.append(data)
        self.held += len(data)

    def _rows(self) -> Iterator[tuple]:
        if self.held < self.needed:
            return
        data, at = b"".join(self.parts), 0
        while True:
            head = data.find(_END, at)
            if head < 0:
                self.needed = len(data) - at + 1
                break
            fields = _fields(data[at:head])
            block = head + len(_END)
            end = block + int(fields["content-length"])
            if len(data) < end + len(_END):
                self.needed = end + len(_END) - at
                break
            if data[end : end + len(_END)] != _END:
                raise ValueError(f"record {fields.get('warc-record-id')} of {self.file} is longer than its header says")
            yield self._row(fields, data[block:end])
            at = end + len(_END)
        self.parts, self.held = ([data[at:]] if at < len(data) else []), len(data) - at

    def _row(self, fields: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(_END)
        page, kind = fields.get("page-id"), fields["warc-type"]
        return (
            self.file, kind, fields.get("warc-record-id"), None if page is None else int(page),
            fields.get("warc-target-uri"), fields.get("warc-date"),
            fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            fields.get("warc-refers-to"), http.decode("utf-8", "replace"), payload if kind == "response" else None,
        )


def _fields(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record starts with {first[:40]!r}")
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}


_SCHEMA = pa.schema(
    [(c.split()[0], {"bigint": pa.int64(), "binary": pa.binary()}.get(c.split()[1], pa.string())) for c in RECORDS.split(", ")]
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, rows, size = _Reader(), [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(_SCHEMA)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA
        )

    for part in batches:
        for start in range(0, part.num_rows, _PIECES):
            some = part.slice(start, _PIECES)
            for file, piece in zip(some["file"].to_pylist(), some["piece"].to_pylist()):
                for row in reader.feed(file, piece):
                    rows.append(row)
                    size += len(row[-1] or b"") + 500
                    if size >= _BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
    rows.extend(reader.close())
    yield batch()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``, as ``RECORDS`` names them; revisits have no payload.

    A file is one task's work, read as a stream; only one record is held at a time besides
    the rows of a batch. A file that is cut short or starts within a record is an error.
    """
    lines = spark.read.option("lineSep", _END.decode()).text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(_parse, RECORDS)


def resolve(found: DataFrame) -> DataFrame:
    """Every record with its full payload's size and digest, revisits through the response they name.

    (page_id, record_id, target_uri, record_type, refers_to, payload_bytes, payload_digest):
    sizes and digests come from the payloads themselves; ``refers_to`` is the page_id of the
    response. A revisit whose response is not among the records keeps its header's digest
    and has a null size and response. The records are read once and written without their
    payloads; only record ids, sizes and digests are shuffled.
    """
    thin = found.select(
        "page_id", "record_id", "target_uri", "type", "refers_to_id",
        F.when(F.col("type") == "response", F.octet_length("payload").cast("bigint")).alias("bytes"),
        F.when(F.col("type") == "response", base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("digest"),
    )
    thin = materialize(thin, "warc_read")
    original = thin.where("type = 'response'").select(
        F.col("record_id").alias("original_id"), F.col("page_id").alias("original_page"),
        F.col("bytes").alias("original_bytes"), F.col("digest").alias("original_digest"),
    )
    revisit = thin.where("type = 'revisit'").join(original, F.col("refers_to_id") == F.col("original_id"), "left")
    columns = ["page_id", "record_id", "target_uri", F.col("type").alias("record_type")]
    return thin.where("type = 'response'").select(
        *columns, F.lit(None).cast("bigint").alias("refers_to"),
        F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
    ).unionByName(
        revisit.select(
            *columns, F.col("original_page").alias("refers_to"), F.col("original_bytes").alias("payload_bytes"),
            F.coalesce("original_digest", "digest").alias("payload_digest"),
        )
    )


def pages_of(found: DataFrame) -> DataFrame:
    """(page_id, url, html) of every record of archives, revisits with the payload they stand for.

    This is what ``records`` takes, so archives from several sources are merged into
    deduplicated ones. Revisits of a response that is not there are left out.
    """
    own = found.where("type = 'response'")
    payload = F.col("payload").cast("string").alias("html")
    original = own.select(F.col("record_id").alias("original_id"), payload)
    revisit = found.where("type = 'revisit'").join(original, F.col("refers_to_id") == F.col("original_id"))
    url = F.col("target_uri").alias("url")
    return own.select("page_id", url, payload).unionByName(revisit.select("page_id", url, "html"))
