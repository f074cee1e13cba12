"""WARC derivatives (op10): metadata and plain-text conversion records from responses.

``read_responses`` reads response records from WARC files; ``responses`` makes them of a table of web pages. ``derive`` gives, for each
response, a metadata record and a conversion record, both linked to it by WARC-Refers-To and sharing its target URI and date; the metadata
record keeps the source's HTTP headers and digests as ``application/warc-fields``, the conversion record holds the plain text. Identifiers
follow from page id, URI and content, so that a task that runs again gives the same records. ``encode``, ``write`` and ``parse`` are the
file side: gzip members, one a record.

A page is scanned once, tag by tag, in time that grows with its length. Comments, scripts, styles, titles, templates and noscript go,
block tags break lines, white space is squeezed, all character references of HTML are decoded. A tag or comment that the page's end cuts
off goes to the end.

A null html is an empty body, a null url an empty URI; rows repeated in page id, url and html are one capture, whose records have the same
identifiers; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import html as htmllib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import pagetext, shared
from weftline.llm.records import qualified

CRLF = "\r\n"
#: Elements that break lines, and those that go with all inside (fixed values, from the HTML standard).
BREAKING = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer body html head blockquote pre hr aside main dl dt dd figure figcaption form fieldset address details summary".split())
DROPPED = frozenset("script style title noscript template".split())
SPACE = re.compile(r"[ \t\r\n\f\xa0]+")


def digest(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256))


def identifier(*parts: Column) -> Column:
    """urn:uuid: of 32 hexadecimal digits that follow from the parts."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def plain_text(page: str | None) -> str:
    """Text of a page, a line for each stretch between block tags."""
    page, parts, pos = page or "", [], 0

    def add(text):
        parts.append(SPACE.sub(" ", htmllib.unescape(text)))

    while (at := page.find("<", pos)) >= 0:
        add(page[pos:at])
        m = pagetext.TAG.match(page, at) or pagetext.SIMPLE_TAG.match(page, at)  # quotes may not be paired
        if not m:
            sign = page[at + 1 : at + 2]
            if sign.isascii() and sign.isalpha() or sign in ("/", "!"):
                pos = len(page)
                break  # a tag that the page's end cuts off
            parts.append("<")
            pos = at + 1
            continue
        pos = m.end()
        if not (name := (m[3] or "").lower()):
            parts.append(" ")
        elif name in BREAKING:
            parts.append("\n")
        elif name in DROPPED and not m[2]:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, pos)
            pos = close.end() if close else len(page)
            parts.append(" ")
    add(page[pos:])
    lines = (SPACE.sub(" ", line).strip(" ") for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", server: str = "example") -> DataFrame:
    """A response record for each page: page_id, record_id, target_uri, date, http_headers, body."""
    body, uri = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    size = F.octet_length(body).cast("string")
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nServer: {server}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(CRLF))
    return pages.select("page_id", identifier(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri, digest(body)).alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), body.alias("body"))


SOURCE = ["record_id", "target_uri", "date", "http_headers", "body"]
#: What a source record says of its own bytes; without them it is what ``body`` and ``http_headers`` give.
OWN = ["payload_digest", "block_digest", "payload_length"]


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response: type, record_id, refers_to, concurrent_to, target_uri, date, content_type, source_digest, block_digest,
    content_length, block; page_id first, if the source has it. Digests and length of the source are those that it has (OWN), as bytes were
    transferred, before any decoding."""
    body, head, page = F.col("body"), F.col("http_headers"), [c for c in source.columns if c == "page_id"]
    own = OWN if set(OWN) <= set(source.columns) else []
    names = [*page, *SOURCE, *own]
    at = names.index("body")

    def work(batch):
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            yield dict(zip(names, part.columns, strict=True)) | {"_text": [plain_text(t) for t in part.column(at).to_pylist()]}

    rows = source.select(*names)
    both = shared.by_batch(rows, work, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", _text string")
    known = lambda name, made: F.coalesce(F.col(name), made) if own else made
    both = both.select("*", known("payload_digest", digest(body)).alias("_payload"), known("block_digest", digest(F.concat(head, F.lit(CRLF), body))).alias("_source_block"), known("payload_length", F.octet_length(body).cast("long")).alias("_length"))
    both = both.select("*", identifier(F.lit("conversion"), F.col("record_id"), digest(F.col("_text"))).alias("_conversion"), identifier(F.lit("metadata"), F.col("record_id")).alias("_metadata"))
    fields = F.concat(
        F.lit("source-payload-digest: "), F.col("_payload"), F.lit(f"{CRLF}source-block-digest: "), F.col("_source_block"), F.lit(f"{CRLF}source-content-length: "), F.col("_length").cast("string"),
        F.lit(f"{CRLF}conversion: "), F.col("_conversion"), F.lit(CRLF), F.regexp_replace(head, r"(?m)^(?=[^\r\n])", "http-header: "),
    )
    records = F.array(
        F.struct(F.lit("metadata").alias("type"), F.col("_metadata").alias("record_id"), F.col("_conversion").alias("concurrent_to"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.col("_conversion").alias("record_id"), F.col("_metadata").alias("concurrent_to"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("_text").alias("block")),
    )
    rows = both.select(*page, F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("_payload").alias("source_digest"), F.inline(records))
    return rows.select(*page, "type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "source_digest", digest(F.col("block")).alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"), "block")


def encode(record: dict) -> bytes:
    """One record as it stands in a file, before compression; keys as ``derive`` or ``responses`` names them."""
    if "body" in record:
        record = record | {"type": "response", "content_type": "application/http; msgtype=response", "block": record["http_headers"] + CRLF + record["body"]}
    block = record["block"].encode()
    lines = ["WARC/1.1"]
    for name, key in (("Type", "type"), ("Record-ID", "record_id"), ("Date", "date"), ("Target-URI", "target_uri"), ("Refers-To", "refers_to"), ("Concurrent-To", "concurrent_to"), ("Block-Digest", "block_digest")):
        if key in record:
            lines.append(f"WARC-{name}: {record[key]}")
    lines += [f"Content-Type: {record['content_type']}", f"Content-Length: {len(block)}"]
    return CRLF.join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def stream(file) -> Iterator[tuple[dict, bytes]]:
    """(header fields by lower-case name, block) of each record of a file, plain or of gzip members; one record is held at a time."""
    file = io.BufferedReader(file) if not hasattr(file, "peek") else file
    source = gzip.GzipFile(fileobj=file) if file.peek(2)[:2] == b"\x1f\x8b" else file
    source = io.BufferedReader(source, 1 << 20)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        fields = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode(errors="replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = source.read(size)
        if len(block) < size:
            raise ValueError("the data end within a record")
        yield fields, block


def http_parts(block: bytes) -> tuple[str, str]:
    """HTTP headers (a line each, ended by CRLF) and decoded body of a response's block: chunks joined, gzip and deflate undone, by its charset."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = head.decode("latin-1") + CRLF
    field = lambda name: (re.search(rf"(?im)^{name}:[ \t]*([^\r\n]*)", headers) or [None, ""])[1].lower()
    if "chunked" in field("transfer-encoding"):
        joined, at = [], 0
        while m := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n").match(body, at):
            if not (size := int(m[1], 16)):
                break
            joined.append(body[m.end() : m.end() + size])
            at = m.end() + size + 2
        body = b"".join(joined)
    try:
        if "gzip" in field("content-encoding"):
            body = zlib.decompressobj(47).decompress(body)
        elif "deflate" in field("content-encoding"):
            body = zlib.decompressobj(-15 if body[:1] != b"\x78" else 15).decompress(body)
    except zlib.error:
        pass  # servers say so of bodies that aren't
    charset = re.search(r"charset=[\"']?([\w-]+)", field("content-type"))
    try:
        return headers, body.decode(charset[1] if charset else "utf-8", errors="replace")
    except LookupError:
        return headers, body.decode("utf-8", errors="replace")


RESPONSE = pa.schema([(n, pa.int64() if n == "payload_length" else pa.string()) for n in [*SOURCE, *OWN]])


def own_digests(fields: dict, block: bytes) -> tuple[str, str, int]:
    """Payload digest, block digest and payload length of a response: the digests that the record states, else those of its bytes as they are,
    transfer and content encodings included."""
    payload = block.partition(b"\r\n\r\n")[2]
    made = lambda data: f"sha256:{hashlib.sha256(data).hexdigest()}"
    return fields.get("warc-payload-digest") or made(payload), fields.get("warc-block-digest") or made(block), len(payload)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """record_id, target_uri, date, http_headers, decoded body, and payload_digest, block_digest and payload_length as transferred, of every
    response record of the WARC files at ``path``, one task for each file.

    Files are streamed, so that a task holds one record at a time. A file that ends within a record fails the read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def run(batches):
        import pyarrow.fs as pafs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, root = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                rows, size = [], 0
                with fs.open_input_stream(root, compression=None) as file:
                    for fields, block in stream(file):
                        if fields.get("warc-type") != "response":
                            continue
                        headers, body = http_parts(block)
                        rows.append((fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""), fields.get("warc-date", ""), headers, body, *own_digests(fields, block)))
                        size += len(block)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RESPONSE, strict=True)], schema=RESPONSE)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RESPONSE, strict=True)], schema=RESPONSE)

    return files.repartition("path").mapInArrow(run, ", ".join(f"{n} {'long' if n == 'payload_length' else 'string'}" for n in RESPONSE.names))


def parse(data: bytes) -> list[dict]:
    """Records of a gzip file of records: their header fields by lower-case name, and ``block`` as text."""
    return [fields | {"block": block.decode()} for fields, block in stream(io.BytesIO(data))]


def write(records: DataFrame, out_dir: str) -> DataFrame:
    """Write records as .warc.gz files, one for each partition; path, n_records and n_bytes of each.

    A task writes under a name of its own, and moves the file into place when it is complete.
    """
    columns = [c for c in records.columns if c != "page_id"]
    out_dir = qualified(records.sparkSession, out_dir)

    def run(batches):
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(out_dir)
        fs.create_dir(root, recursive=True)
        name, n, size = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0, 0
        tmp = f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(tmp, compression=None) as out:
            for batch in batches:
                for first in range(0, batch.num_rows, 500):
                    for record in batch.slice(first, 500).to_pylist():
                        z = io.BytesIO()
                        with gzip.GzipFile(fileobj=z, mode="wb", mtime=0) as g:
                            g.write(encode(record))
                        out.write(z.getvalue())
                        n, size = n + 1, size + z.tell()
        fs.move(tmp, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [n], "n_bytes": [size]})

    return records.select(*columns).mapInArrow(run, "path string, n_records long, n_bytes long")


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(shared.table(spark, sf_dir, "pages")))


def _sql_uuid(h: str) -> str:
    return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"


def _sql_text() -> str:
    """The plain text of pages of simple markup: tags without signs in their attributes, eight character references."""

    def g(t, pattern, to):
        return f"regexp_replace({t}, '{pattern}', {to}, 'g')"

    dropped = r"(?is)<!--.*?-->|<script\b.*?</script[^>]*>|<style\b.*?</style[^>]*>|<title\b.*?</title[^>]*>"
    breaks = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|body|html|head|blockquote|pre|hr)\b[^>]*>"
    t = g(g(g(g("body", dropped, "' '"), r"[ \t\r\n\f]+", "' '"), breaks, "chr(10)"), r"<[/a-zA-Z!][^>]*>", "''")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'\'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = f"replace({t}, '{ref}', '{char}')"
    return g(g(g(t, " +", "' '"), r" ?\n[ \n]*", "chr(10)"), r"\A[ \n]+|[ \n]+\z", "''")


OP10_SQL = f"""
WITH r0 AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS body FROM pages),
r1 AS (SELECT *, 'sha256:' || sha256(body) AS payload, strlen(body) AS n,
  ['HTTP/1.1 200 OK', 'Server: example', 'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || strlen(body)] AS head FROM r0),
r2 AS (SELECT *, md5('response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || target_uri || chr(10) || payload) AS h, {_sql_text()} AS plain,
  'sha256:' || sha256(list_aggregate(list_append(head, ''), 'string_agg', chr(13) || chr(10)) || chr(13) || chr(10) || body) AS source_block FROM r1),
r3 AS (SELECT *, {_sql_uuid('h')} AS refers_to, 'sha256:' || sha256(plain) AS plain_digest FROM r2),
r4 AS (SELECT *, md5('conversion' || chr(10) || refers_to || chr(10) || plain_digest) AS hc, md5('metadata' || chr(10) || refers_to) AS hm FROM r3),
r5 AS (SELECT *, {_sql_uuid('hc')} AS conversion, {_sql_uuid('hm')} AS metadata FROM r4),
r6 AS (SELECT *, list_aggregate(list_concat(['source-payload-digest: ' || payload, 'source-block-digest: ' || source_block, 'source-content-length: ' || n, 'conversion: ' || conversion],
  list_transform(head, lambda x: 'http-header: ' || x), ['']), 'string_agg', chr(13) || chr(10)) AS fields FROM r5),
r7 AS (
  SELECT page_id, 'metadata' AS type, metadata AS record_id, refers_to, conversion AS concurrent_to, target_uri, 'application/warc-fields' AS content_type, payload AS source_digest, fields AS block FROM r6
  UNION ALL
  SELECT page_id, 'conversion', conversion, refers_to, metadata, target_uri, 'text/plain; charset=utf-8', payload, plain FROM r6)
SELECT page_id, type, record_id, refers_to, concurrent_to, target_uri, '2024-01-01T00:00:00Z' AS date, content_type, source_digest, 'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length, block FROM r7
"""
