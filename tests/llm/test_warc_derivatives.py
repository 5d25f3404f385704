import glob
import gzip
import json
import random

from pyspark.sql import functions as F

from millrace.llm import warc_derivatives as D

PAGE = "<html><head><title>A  title</title></head><body><a href='/x?a=1&amp;b'>li<b>nk</b></a><p>one\n two</p><script>no</script></body></html>"


def response(body, http=b"Content-Type: text/html", digest=None):
    block = b"HTTP/1.1 200 OK\r\n" + http + D.END + body
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://h/p/"), ("WARC-Date", "2020-01-02T03:04:05Z"), ("WARC-Payload-Digest", digest or D.sha1_label(body))]
    return D.make_record(fields, block) + D.END


def test_records_link_to_their_source(spark):
    rows = D.build_derivatives(spark.createDataFrame([(response(PAGE.encode()),)], "record binary").withColumn("type", F.lit(1))).collect()
    metadata, conversion = sorted(rows, key=lambda r: r.type, reverse=True)
    for r in rows:
        assert (r.refers_to, r.target_uri, r.date, r.digest_ok, r.problem) == ("<urn:uuid:1>", "http://h/p/", "2020-01-02T03:04:05Z", True, None)
        head, _, block = r.record.partition(D.END)
        headers = D.headers_of(head)
        assert D.get(headers, "WARC-Refers-To") == "<urn:uuid:1>" and D.get(headers, "WARC-Block-Digest") == D.sha1_label(block) == r.block_digest
        assert int(D.get(headers, "Content-Length")) == len(block) == r.content_length
    assert conversion.concurrent_to == metadata.record_id and conversion.record.endswith(b"\r\n\r\nlink\none two")
    facts = json.loads(metadata.record.partition(D.END)[2])
    assert facts["html"] == {"title": "A title", "links": [{"path": "a@/href", "url": "http://h/x?a=1&b"}]}
    assert ["WARC-Payload-Digest", D.sha1_label(PAGE.encode())] in facts["source"]["headers"] and facts["http"]["status"] == "HTTP/1.1 200 OK"


def test_codings_types_and_broken_records():
    zipped = gzip.compress("é".encode())
    chunks = b"%x\r\n%s\r\n0\r\n\r\n" % (len(zipped), zipped)
    out = D.derivatives_of(response(chunks, b"Content-Type: text/plain; charset=utf-8\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked", D.sha1_label(zipped)))
    assert out[1]["record"].endswith("\r\n\r\né".encode()) and out[0]["digest_ok"]
    assert D.derivatives_of(response(b"\x00\x01", b"Content-Type: image/png"))[1]["content_length"] == 0
    assert D.derivatives_of(response(b"a", digest="sha1:AAAA"))[0]["digest_ok"] is False
    for bad in (None, b"", b"junk", response(b"abc")[:-8], b"WARC/1.0\r\nContent-Length: 0\r\n\r\n"):
        (row,) = D.derivatives_of(bad)
        assert row["problem"] and row["type"] is None
    assert D.derivatives_of(b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <a>\r\nContent-Length: 0\r\n\r\n") == []


def plain_chunks(body):
    """Byte by byte: a size line, that many bytes, two bytes of line end, and so on."""
    out, rest, any_chunk = b"", body, False
    while True:
        line, sep, after = rest.partition(b"\r\n")
        digits = line.split(b";")[0].strip().decode("latin-1")
        if not sep or not digits or any(c not in "0123456789abcdefABCDEF" for c in digits):
            return out if out else body
        n = int(digits, 16)
        if n == 0:
            return out
        out, rest = out + after[:n], after[n + 2 :]


def test_chunks_match_a_plain_reader():
    rng = random.Random(6)
    sizes = [b"-6", b"+5", b"1_0", b"", b"0", b"5", b"A", b"1;x=y", b" 3 ", b"ffffffffff", b"0x5", b"\xd9\xa3"]
    for _ in range(3000):
        body = b"".join(rng.choice(sizes) + rng.choice([b"\r\n", b"\n"]) + b"abcdefghij"[: rng.randrange(11)] + b"\r\n" for _ in range(rng.randrange(5)))
        assert D.joined_chunks(body) == plain_chunks(body)


def test_content_is_unpacked_up_to_a_bound():
    several = gzip.compress(b"one ") + gzip.compress(b"two") + b"\0\0"
    head = b"Content-Type: text/plain\r\nContent-Encoding: gzip"
    assert D.derivatives_of(response(several, head))[1]["record"].endswith(b"\r\n\r\none two")
    assert D.derivatives_of(response(several, head), 7)[1]["problem"] is None
    (row,) = D.derivatives_of(response(gzip.compress(bytes(10_000_000)), head), 1000)
    assert (row["problem"], row["refers_to"], row["type"]) == ("content too large", "<urn:uuid:1>", None)
    for broken in (several[:20], b"no gzip", b""):
        assert D.derivatives_of(response(broken, head))[1]["content_length"] == 0


def test_pages_to_files_and_back(spark, tmp_path):
    rows = [(1, "http://a/", PAGE), (1, "http://a/", PAGE), (None, None, None), (2, "x", "")]
    made = D.build_derivatives(D.page_responses(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert made.count() == 8 and made.filter("problem IS NOT NULL OR NOT digest_ok").count() == 0
    D.write_warc(made, str(tmp_path / "out"))
    found = 0
    for name in glob.glob(str(tmp_path / "out" / "part-*")):
        raw, at = open(name, "rb").read(), 0
        while at < len(raw):
            end = raw.index(D.END, at) + 4
            size = int(D.get(D.headers_of(raw[at : end - 4]), "Content-Length"))
            assert raw[end + size : end + size + 4] == D.END
            at, found = end + size + 4, found + 1
    assert found == 8
    assert D.build_derivatives(D.page_responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
