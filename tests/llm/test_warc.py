"""WARC files, plain text of pages, identifiers."""

import gzip
import hashlib
import time
import zlib

from weftline.llm import warc


def test_plain_text():
    for page, want in {
        "a &eacute; &#8217; &#x27; &mdash; &nbsp; b &amp;lt;": "a é ’ ' — b &lt;",
        "<noscript>no</noscript><p title='a > b' data-x=\"c>d\">x</p><!-- > --><template>t</template>y": "x\ny",
        "<p>it's <b>so</b>me</p>< 3<p>z": "it's some\n< 3\nz",
        "one<br>two<td>three</td>&lt;p&gt;": "one\ntwothree<p>",
        "<p>kept<p class='cut": "kept",
        "kept<!-- not closed <p>x": "kept",
        "kept<script>not closed <p>x": "kept",
        None: "",
        "": "",
    }.items():
        assert warc.plain_text(page) == want, page


def test_time_grows_with_the_page():
    for unit in ("<!-- ", "<script>x</script", "<p ", "<a b=\"c ", "<a b='c ", "<", "&amp", "</", "<style>"):
        start = time.time()
        warc.plain_text(unit * (400_000 // len(unit)))
        assert time.time() - start < 5, unit


def test_identifiers_differ(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", 5), (2, "u", "<p>x</p>", 5), (None, "u", "<p>x</p>", 5), (3, "v", "<p>x</p>", 5)], "page_id long, url string, html string, body int")
    rows = warc.derive(warc.responses(pages)).collect()
    assert len({r.record_id for r in rows}) == 8 and len({r.refers_to for r in rows}) == 4
    by_id = {r.record_id: r for r in rows}
    assert all(by_id[r.concurrent_to].concurrent_to == r.record_id and by_id[r.concurrent_to].refers_to == r.refers_to for r in rows)


def test_response_files_are_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<title>t</title><p>text {i} é</p>") for i in range(30)] + [(30, None, None)], "page_id long, url string, html string")
    source = warc.responses(pages)
    rows = [r.asDict() for r in source.collect()]
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + b"".join(gzip.compress(warc.encode(r)) for r in rows[:20]))
    (tmp_path / "b.warc").write_bytes(info + b"".join(warc.encode(r) for r in rows[20:]))
    read = warc.read_responses(spark, str(tmp_path))
    assert sorted(map(tuple, read.select(*warc.SOURCE).collect())) == sorted(tuple(r[n] for n in warc.SOURCE) for r in rows)
    want = warc.derive(source).drop("page_id")
    got = warc.derive(read)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_bodies_are_decoded():
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n"
    assert warc.http_parts(f"{head}\r\n".encode() + "é".encode("latin-1")) == (head, "é")
    for more, body in (("Content-Encoding: gzip\r\n", gzip.compress(b"abc")), ("Content-Encoding: deflate\r\n", zlib.compress(b"abc")), ("Transfer-Encoding: chunked\r\n", b"2\r\nab\r\n1;x=y\r\nc\r\n0\r\n\r\n"), ("Content-Encoding: gzip\r\n", b"abc")):
        assert warc.http_parts(f"{head}{more}\r\n".encode() + body) == (head + more, "abc")
    assert warc.http_parts(b"no headers") == ("no headers\r\n", "")


def test_what_a_source_says_of_itself_is_kept(spark, tmp_path):
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset="
    page = "<p>caf\u00e9</p>"
    zipped, chunked = gzip.compress(page.encode()), b"5\r\n<p>ca\r\n" + b"%x\r\n" % len("f\u00e9</p>".encode()) + "f\u00e9</p>".encode() + b"\r\n0\r\n\r\n"
    cases = {"latin": (f"{head}iso-8859-1\r\n\r\n", page.encode("latin-1")), "gzip": (f"{head}utf-8\r\nContent-Encoding: gzip\r\n\r\n", zipped), "chunked": (f"{head}utf-8\r\nTransfer-Encoding: chunked\r\n\r\n", chunked)}
    out = b""
    for name, (top, body) in cases.items():
        block = top.encode() + body
        stated = "WARC-Payload-Digest: sha1:OWNPAYLOAD\r\nWARC-Block-Digest: sha1:OWNBLOCK\r\n" if name == "gzip" else ""
        out += f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{name}>\r\nWARC-Date: d\r\nWARC-Target-URI: u\r\n{stated}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(out)
    rows = {(r.refers_to, r.type): r for r in warc.derive(warc.read_responses(spark, str(tmp_path))).collect()}
    for name, (top, body) in cases.items():
        meta, text = rows[f"<urn:{name}>", "metadata"], rows[f"<urn:{name}>", "conversion"]
        payload, block = ("sha1:OWNPAYLOAD", "sha1:OWNBLOCK") if name == "gzip" else (f"sha256:{hashlib.sha256(body).hexdigest()}", f"sha256:{hashlib.sha256(top.encode() + body).hexdigest()}")
        assert meta.block.startswith(f"source-payload-digest: {payload}\r\nsource-block-digest: {block}\r\nsource-content-length: {len(body)}\r\n")
        assert meta.source_digest == text.source_digest == payload and text.block == "caf\u00e9"


def test_records_are_written_by_a_qualified_path(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in range(6)], "page_id long, url string, html string")
    records = warc.derive(warc.responses(pages))
    for _ in range(2):  # a task that runs again writes the same file
        shards = warc.write(records, str(tmp_path / "out")).collect()
    found = [r for s in shards for r in warc.parse(open(s.path.removeprefix("file://"), "rb").read())]
    assert sorted(r["warc-record-id"] for r in found) == sorted(r.record_id for r in records.collect()) and not list((tmp_path / "out").glob(".*.tmp"))
