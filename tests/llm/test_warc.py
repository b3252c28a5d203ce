import gzip
import hashlib
import io
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from photoflow.llm import warc as W

PAGES = "page_id long, url string, html string"


def big(c):
    return c * 1500


def rows():
    out = [(k, f"http://a.example/{k}", big("xyz"[k % 3])) for k in range(40)]  # three groups of equal payloads
    out += [(100, "http://b/é ?q=%20\r\nX-Page-ID: 7", "ü" * 499), (101, "http://b/2", "ü" * 499), (102, None, "ü" * 500), (103, "http://b/4", "ü" * 500)]  # 998 and 1,000 bytes
    out += [(104, "http://c/1", None), (105, "http://c/2", ""), (106, "http://c/3", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx" * 50)]
    out += [(107, "http://d", big("r")), (107, "http://d", big("r")), (None, "http://e", big("n")), (None, "http://e", big("n")), (108, "http://e", big("m")), (None, "http://e", big("m"))]
    return out


def want(pages, least=W.MIN_BYTES):
    """By definition; of repeated rows of the greatest id one is the response."""
    groups = {}
    for k, (i, _, html) in enumerate(pages):
        groups.setdefault((html or "").encode(), []).append((i is not None, i, k))
    out = []
    for body, own in groups.items():
        last = max(own)
        for _, i, k in own:
            again = len(body) >= least and k != last[2]
            out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[1] if again else None))
    return sorted(out, key=str)


def got(spark, path):
    out = W.read_resolved(spark, path)
    return sorted(map(tuple, out.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").cast("long")).collect()), key=str)


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x") for r in rows()], PAGES + ", record_id string").repartition(5)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    W.write_archive(W.responses(pages), a, per_file=7)
    assert len(os.listdir(a)) >= 8 and all(n.endswith(".warc.gz") for n in os.listdir(a))
    assert all(r["resolved"] and r["record_type"] == "response" for r in W.read_resolved(spark, a).collect())
    W.deduplicate(spark, a, b, F.col("page_id").cast("long"))
    assert got(spark, b) == want(rows())
    size = lambda p: sum(len(gzip.open(f"{p}/{n}").read()) for n in os.listdir(p))
    assert size(b) < size(a)
    old, new = ({r["record_id"] for r in W.read_headers(spark, p).collect()} for p in (a, b))
    assert len(new) == len(rows()) and not old & new
    # archives that hold revisits already: another pass changes no row
    W.deduplicate(spark, b, str(tmp_path / "c"), F.col("page_id").cast("long"))
    assert got(spark, str(tmp_path / "c")) == want(rows())


def test_records_are_as_the_format_says(spark, tmp_path):
    W.write_archive(W.responses(spark.createDataFrame(rows()[40:44], PAGES), date="2024-01-02T03:04:05Z"), str(tmp_path / "a"))
    W.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"), F.col("page_id").cast("long"))
    raw = b"".join(gzip.open(tmp_path / "b" / n).read() for n in os.listdir(tmp_path / "b"))
    found = list(W.parse(io.BytesIO(raw)))
    by = {r["page_id"]: r for r in found}
    assert by["100"]["uri"] == "http://b/é%20?q=%20%0D%0AX-Page-ID:%207" and by["102"]["uri"] is None and by["100"]["payload"] == ("ü" * 499).encode()
    assert by["102"]["refers_to_id"] == by["103"]["record_id"] and by["102"]["refers_to_uri"] == "http://b/4" and by["102"]["refers_to_date"] == "2024-01-02T03:04:05Z"
    assert by["102"]["head"].endswith(b"Content-Length: 1000\r\n\r\n") and raw.count(W.PROFILE.encode()) == 1
    assert raw.count(b"WARC-Payload-Digest: sha1:") == 4 and b"WARC-Record-ID: <urn:uuid:" in raw


def test_other_archives(spark, tmp_path):
    """Plain files, other record types, hex digests, revisits without a response, a digest that doesn't hold."""
    body = big("q").encode()
    record = lambda kind, i, block, *more: "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{i}>", f"X-Page-ID: {i}", *more, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    http, sha = f"Content-Type: {W.HTTP}", hashlib.sha1(body).hexdigest()
    os.makedirs(tmp_path / "a")
    (tmp_path / "a" / "x.warc").write_bytes(
        record("warcinfo", 0, b"software: x\r\n", "Content-Type: application/warc-fields") + record("response", 1, b"HTTP/1.1 404 Gone\r\n\r\n" + body, http, f"WARC-Payload-Digest: sha1:{sha}")
        + record("response", 2, b"HTTP/1.1 200 OK\r\n\r\n" + body, http) + record("revisit", 3, b"HTTP/1.1 304\r\n\r\n", http, f"WARC-Payload-Digest: sha1:{sha}", "WARC-Refers-To: <urn:x:gone>")
        + record("revisit", 4, b"", http, "WARC-Payload-Digest: sha1:" + "0" * 40, "WARC-Refers-To: <urn:x:gone>") + record("response", 5, b"HTTP/1.1 200 OK\r\n\r\n" + body, http, "WARC-Payload-Digest: sha1:" + "1" * 40)
    )
    W.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    out = {r["page_id"]: (r["record_type"], r["payload_bytes"], r["refers_to_page"], r["resolved"]) for r in W.read_resolved(spark, str(tmp_path / "b")).collect()}
    assert out == {"1": ("revisit", 1500, "2", True), "2": ("response", 1500, None, True), "3": ("revisit", 1500, "2", True), "4": ("revisit", None, None, False), "5": ("response", 1500, None, False)}
    kept = {r["page_id"]: r for n in os.listdir(tmp_path / "b") for r in W.parse(gzip.open(tmp_path / "b" / n))}
    assert kept["0"]["record_type"] == "warcinfo" and kept["0"]["payload"] == b"software: x\r\n" and kept["4"]["refers_to_id"] == "<urn:x:gone>" and kept["1"]["head"] == b"HTTP/1.1 404 Gone\r\n\r\n"


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = W.responses(spark.createDataFrame(rows(), PAGES)).withColumn("payload", F.when(F.col("page_id") == "39", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="lost"):
        W.write_archive(bad, str(tmp_path / "a"))
    assert os.listdir(tmp_path / "a") == []


def test_members_are_read_as_by_the_standard_library(tmp_path):
    import random

    r = random.Random(2)
    texts = [r.randbytes(r.choice([0, 1, 100, 70_000])) + b"x\n" * r.choice([0, 5, 300_000]) for _ in range(60)]
    file = tmp_path / "x.warc.gz"
    file.write_bytes(b"".join(gzip.compress(t) for t in texts) + b"\0" * 100)
    with W._opened(str(file)) as f:
        assert f.read() == b"".join(texts)
    with W._opened(str(file)) as f:
        assert list(f) == list(io.BytesIO(b"".join(texts)))
    file.write_bytes(gzip.compress(b"y" * 1000)[:-12])
    with W._opened(str(file)) as f, pytest.raises(EOFError):
        f.read()


def test_empty_table(spark, tmp_path):
    W.write_archive(W.responses(spark.createDataFrame([], PAGES)), str(tmp_path / "a"))
    W.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert got(spark, str(tmp_path / "b")) == []


def test_query_is_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    out = W.op12_warc_revisits(spark, sf)
    wanted = con.execute(W.OP12_SQL).fetchall()
    assert [d[0] for d in con.description] == out.columns
    assert sorted(map(tuple, out.collect())) == sorted(wanted)


def test_sql_is_the_definition():
    con = duckdb.connect()
    own = [r for r in rows() if r[0] is not None and r[0] != 107]
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", own)
    assert sorted(con.execute(W.OP12_SQL).fetchall(), key=str) == want(own)
