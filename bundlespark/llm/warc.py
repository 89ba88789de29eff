"""WARC archives: writing records, some in segments, and reading them back whole.

A page becomes a response record with its payload as an HTTP message body, or a revisit
of the response with the equal payload of smallest id. Bodies longer than a segment
are framed in HTTP chunks, cut into a first record and continuation records, and the
reader puts them together again: continuations are grouped by the identifier of their
origin, ordered by segment number, checked against the total length, and the chunked
framing is taken off. Archives are written and read through Spark, so they can lie
wherever Spark can write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir, skew_join, with_rank

#: Payloads of fewer bytes are never stored as revisits.
LEAST_REVISIT = 100
#: Bytes of a record's block beyond which it is cut into segments.
SEGMENT = 16_384
#: Bytes of a chunk of the transfer framing.
CHUNK = 4_096
#: Bytes of an archive file at most, but for headers; a reader holds one file at a time.
FILE_BYTES = 32 << 20
#: What stands between two records.
_END = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """``body`` in HTTP/1.1 chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in _cuts(body, size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """What ``chunked`` framed; chunk extensions and trailers are passed over. ValueError if it breaks off."""
    out, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        size = int(framed[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than it says")
        out.append(framed[at:at + size])
        at += size + 2


def _cuts(block: bytes, size: int):
    """Parts of about ``size`` bytes; none ends within a UTF-8 character, so each is text."""
    at = 0
    while at < len(block):
        end = min(len(block), at + size)
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end += 1
        yield block[at:end]
        at = end


def _record(headers: dict[str, str], block: bytes) -> str:
    lines = "".join(f"{k}: {v}\r\n" for k, v in {**headers, "Content-Length": str(len(block))}.items())
    return f"WARC/1.1\r\n{lines}\r\n{block.decode()}"


def _identifier(page: int | None, copy: int) -> str:
    """Copy number, a bit that says whether the id is null, and the 64 bits of the id."""
    return f"<urn:uuid:{uuid.UUID(int=copy << 65 | (page is None) << 64 | (page or 0) & (1 << 64) - 1)}>"


def page_of(identifier):
    """The page id in a record identifier of ``_identifier``, as a column of one."""
    digits = F.regexp_replace(F.regexp_replace(identifier, "^<urn:uuid:|>$", ""), "-", "")
    flag = F.conv(F.substring(digits, 16, 1), 16, 10).cast("int")
    return F.when(flag % 2 == 0, F.conv(F.right(digits, F.lit(16)), 16, -10).cast("long"))


def records_of(page: int | None, copy: int, url: str | None, payload: bytes, digest: str, refers: tuple[int | None, int] | None):
    """The records of one page as text, the final line ends left out."""
    own = _identifier(page, copy)
    common = {"WARC-Record-ID": own, "WARC-Date": _DATE, "WARC-Target-URI": " ".join((url or "").split()) or "about:blank", "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers is not None:
        head = {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _identifier(*refers), "X-Payload-Length": str(len(payload))}
        yield _record({**head, **common}, b"HTTP/1.1 200 OK\r\n\r\n")
        return
    long = len(payload) > SEGMENT
    framing = b"Transfer-Encoding: chunked\r\n" if long else b"Content-Length: %d\r\n" % len(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + framing + b"\r\n" + (chunked(payload) if long else payload)
    if not long:
        yield _record({"WARC-Type": "response", **common}, block)
        return
    parts = list(_cuts(block, SEGMENT))
    yield _record({"WARC-Type": "response", **common, "WARC-Segment-Number": "1"}, parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": str(len(block))} if n == len(parts) else {}
        yield _record({"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}/{n}')}>", "WARC-Date": _DATE, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": str(n), **last}, part)


def _numbered(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, copy, url, payload, digest); copy tells rows with equal ids apart and is 0 where there is only one."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    again = materialise(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("_id"), "n"), "warc-again").df
    total = again.agg(F.sum("n")).first()[0] or 0
    once = rows.withColumn("copy", F.lit(0).cast("long"))
    if not total:
        return once
    keys = again.select("_id")
    same = F.col("id").eqNullSafe(F.col("_id"))
    # Only rows whose id another row has are numbered, by id and a flag for null.
    more = rows.join(keys, same, "left_semi").withColumn("_none", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0)))
    ranked = with_rank(more, ["id", "_none"], F.xxhash64("digest", "url"), ["digest", "url"], total, "copy")
    ranked = materialise(ranked.withColumn("id", F.when(~F.col("_none"), F.col("id"))).drop("_none"), "warc-copies").df
    return once.join(keys, same, "left_anti").unionByName(ranked)


def plan(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, copy, url, payload, digest, refers) of every page; refers is the (id, copy) that a revisit points to, else null.

    Of equal payloads of LEAST_REVISIT bytes or more, the one with the smallest id is
    the response; of rows with that id, the one numbered first. Null ids come last.
    """
    rows = _numbered(pages, id_col, url_col, html_col)
    large = F.octet_length("payload") >= LEAST_REVISIT
    first = rows.filter(large).groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "copy")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = materialise(first, "warc-equal").df
    total = first.agg(F.sum("n")).first()[0] or 0
    none = F.lit(None).cast("struct<id:bigint,copy:bigint>")
    if not total:
        return rows.withColumn("refers", none)
    # Pages with an equal one are matched without their payloads.
    ids = skew_join(rows.filter(large).select("id", "copy", "digest"), first, "digest", "n", total).filter(~(F.col("id").eqNullSafe(F.col("least.id")) & (F.col("copy") == F.col("least.copy"))))
    ids = ids.select(F.col("id").alias("_id"), F.col("copy").alias("_copy"), F.struct("least.id", "least.copy").alias("refers"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))
    return rows.join(ids, same, "left").select("id", "copy", "url", "payload", "digest", "refers")


def write(planned: DataFrame, to: str) -> None:
    """Writes the records of ``plan`` to archives in the folder ``to``, of FILE_BYTES each at most."""
    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out, held = [], 0
            for page, copy, url, payload, digest, of, of_copy in zip(*[c if i == 3 else c.to_pylist() for i, c in enumerate(batch.columns)], strict=True):
                for record in records_of(page, copy, url, payload.as_py(), digest, None if of_copy is None else (of, of_copy)):
                    out.append(record)
                    held += len(record)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows = planned.select("id", "copy", "url", "payload", "digest", "refers.id", F.col("refers.copy").alias("of_copy"))
    rows.toDF("id", "copy", "url", "payload", "digest", "of", "of_copy").mapInArrow(work, "value string").write.option("lineSep", _END).option("maxRecordsPerFile", FILE_BYTES // SEGMENT).text(to)


def parsed(data: bytes):
    """The records of an archive, one by one: (headers in lower case, block)."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        start = end + 4
        size = int(headers["content-length"])
        if start + size > len(data):
            raise ValueError(f"the record at byte {at} breaks off")
        yield headers, data[start:start + size]
        at = start + size
        while data.startswith(b"\r\n", at):
            at += 2


def read(spark, folder: str) -> DataFrame:
    """Every record of the archives in ``folder``: type, record, origin, segment, total, uri, digest, refers, length, block.

    origin is the record's own identifier but for continuations; segment is null for a
    record that is whole.
    """
    names = ["type", "record", "origin", "segment", "total", "uri", "digest", "refers", "length", "block"]

    def work(batches):
        import pyarrow as pa

        schema = pa.schema([("type", pa.string()), ("record", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("uri", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("length", pa.int64()), ("block", pa.binary())])
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in parsed(content.as_py()):
                    rows.append(dict(zip(names, (h["warc-type"], h["warc-record-id"], h.get("warc-segment-origin-id", h["warc-record-id"]), number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to"), number(h.get("x-payload-length")), block), strict=True)))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(work, "type string, record string, origin string, segment int, total long, uri string, digest string, refers string, length long, block binary")


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: type, record, uri, digest, refers, length, body; continuations joined to their origins.

    The body is the HTTP message's, its transfer framing taken off. The job fails if
    segments are missing or doubled, or their length is not the total that the last one
    states. Only segmented records are moved, each to the task of its origin.
    """
    whole = records.filter("segment is null").select("type", "record", "uri", "digest", "refers", "length", "block")
    cut = records.filter("segment is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c) for c in ("type", "uri", "digest", "refers", "length")])
    # one pass over the segments for a record: their blocks as hexadecimal text, joined and turned back
    block = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    good = (F.octet_length("block") == F.col("total")) & (F.element_at("parts", -1)["segment"] == F.size("parts")) & (F.element_at("parts", 1)["segment"] == 1)
    joined = cut.withColumn("block", block).withColumn("block", F.when(good, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("incomplete segments of "), F.col("origin"))).cast("binary")))
    every = whole.unionByName(joined.select("type", F.col("origin").alias("record"), "uri", "digest", "refers", "length", "block"))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            bodies = []
            for block in batch.column(6):
                head, _, body = block.as_py().partition(b"\r\n\r\n")
                bodies.append(dechunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(bodies, pa.binary())], ["type", "record", "uri", "digest", "refers", "length", "body"])

    return every.mapInArrow(work, "type string, record string, uri string, digest string, refers string, length long, body binary")


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them: (id, payload_bytes, payload_digest, record_type, refers_to, body).

    payload_digest is computed from what was read; that of a revisit, which carries no
    payload, is the one it states, as its length is. Null html is an empty payload. Rows
    with equal or null ids are records of their own; of repeated rows whose payloads are
    long enough, one is the response that the others revisit. Other columns are ignored.
    """
    spark, to = pages.sparkSession, f"{shared_dir(pages.sparkSession)}/bundlespark/warc-{uuid.uuid4().hex}"
    planned = plan(pages, id_col=id_col, url_col=url_col, html_col=html_col)
    write(planned, to)
    whole = reassemble(read(spark, to))
    revisit = F.col("type") == "revisit"
    return whole.select(
        page_of(F.col("record")).alias("id"),
        F.when(revisit, F.col("length")).otherwise(F.octet_length("body")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.substring("digest", 8, 64)).otherwise(F.sha2("body", 256)).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(revisit, page_of(F.col("refers"))).alias("refers_to"), "body")
