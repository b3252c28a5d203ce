"""WARC archives of responses: written by tasks and committed at once, read back, and rewritten with equal payloads as revisits.

Only headers are shuffled, by payload digest; what becomes a revisit goes to its archive's task as a list. Bodies are read
and written where their archive is, so each is moved through no shuffle. An archive is rolled at ROLL bytes or RECORDS
records, which bounds that list. Archives are plain files on a folder that the driver and all executors mount.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from photoflow.llm.common import discard, materialise, used
from photoflow.sources.shared import mounted_dir

#: Least bytes of a payload that is stored once.
MIN_BYTES = 1000
#: An archive's compressed bytes and records, beyond which the next one begins; bytes of payloads that go to Spark together.
ROLL, RECORDS, BATCH = 64_000_000, 50_000, 4_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, page_id string, uri string, date string, payload_digest string, refers_to_id string, refers_to_uri string, refers_to_date string, content_type string, head binary, payload binary"
HEADERS = "file string, record_id string, record_type string, page_id string, uri string, date string, payload_digest string, strong_digest string, payload_bytes long, refers_to_id string, refers_to_uri string, refers_to_date string, intact boolean"
HTTP = "application/http; msgtype=response"
_FIELDS = {
    "WARC-Record-ID": "record_id", "WARC-Type": "record_type", "X-Page-ID": "page_id", "WARC-Target-URI": "uri", "WARC-Date": "date", "WARC-Payload-Digest": "payload_digest",
    "WARC-Refers-To": "refers_to_id", "WARC-Refers-To-Target-URI": "refers_to_uri", "WARC-Refers-To-Date": "refers_to_date", "Content-Type": "content_type",
}


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds.get(kind, pa.string())) for n, kind in (f.split() for f in ddl.split(", "))])


def _labelled(sha1: bytes) -> str:
    """As archives write it: in base 32."""
    return f"sha1:{base64.b32encode(sha1).decode()}"


def _hex(header: str | None) -> str | None:
    """A header's SHA-1, in base 32 or hex, as lower-case hex; none of another algorithm."""
    kind, _, value = (header or "").partition(":")
    try:
        return None if kind.lower() != "sha1" else value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def record_bytes(r: dict) -> bytes:
    """A record (RECORD): the block is ``head``, of HTTP its status and headers, and ``payload``, which a revisit has none of."""
    block = (r["head"] or b"") + (b"" if r["record_type"] == "revisit" else r["payload"] or b"")
    lines = ["WARC/1.1"]
    for name, field in _FIELDS.items():
        if (value := r.get(field)) is not None:
            if field == "payload_digest":
                value = _labelled(bytes.fromhex(value))
            elif field == "page_id":
                value = quote(value)
            lines.append(f"{name}: {re.sub(r'[\x00-\x20\x7F]', lambda m: quote(m[0]), value) if 'uri' in field else value}")
    if r["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += [f"WARC-Block-Digest: {_labelled(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """A task's archives lie in a folder of this write until all tasks are done; an attempt that isn't committed leaves nothing."""

    def __init__(self, path: str, roll: int, records: int):
        self.path, self.roll, self.records = path, roll, records
        self.staged = os.path.join(path, f"_staged-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.staged, exist_ok=True)
        names, out, n, size = [], None, 0, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, n, size = open(os.path.join(self.staged, names[-1]), "wb"), 0, 0  # noqa: SIM115
                packer = zlib.compressobj(1, wbits=31)  # a member for each record
                member = packer.compress(record_bytes(r)) + packer.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if n >= self.records or size >= self.roll:
                    out.close()
                    out = None
        if out:
            out.close()
        message = WriterCommitMessage()
        message.names = names
        return message

    def commit(self, messages) -> None:
        for m in messages:
            for name in m.names if m else ():
                os.replace(os.path.join(self.staged, name), os.path.join(self.path, name))
        shutil.rmtree(self.staged, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


class WarcSink(DataSource):
    """Options: ``path``, ``roll``, ``records``. Rows are RECORD."""

    @classmethod
    def name(cls) -> str:
        return "photoflow_warc"

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("roll", ROLL)), int(self.options.get("records", RECORDS)))


def write_archive(records: DataFrame, path: str, roll: int = ROLL, per_file: int = RECORDS) -> None:
    """Add ``records`` (RECORD) to the folder ``path`` as archives: all of them, or none where the write fails."""
    records.sparkSession.dataSource.register(WarcSink)
    os.makedirs(path, exist_ok=True)
    records.write.format("photoflow_warc").option("roll", roll).option("records", per_file).mode("append").save(path)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: str | None = None) -> DataFrame:
    """Pages as response records (RECORD). A null body is empty; a null key or url has no header. ``date`` is now, if not given.

    On one line controls and spaces of a URL are percent-encoded, and a key like a URL's part.
    """
    payload = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    none = F.lit(None).cast("string")
    when = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    own = pages.select(F.col(key).cast("string").alias("page_id"), F.col(url).alias("uri"), payload.alias("payload"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    return own.select(
        F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("record_id"), F.lit("response").alias("record_type"), "page_id", "uri", when.alias("date"), F.sha1("payload").alias("payload_digest"),
        none.alias("refers_to_id"), none.alias("refers_to_uri"), none.alias("refers_to_date"), F.lit(HTTP).alias("content_type"), head.cast("binary").alias("head"), "payload",
    )


def parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of an archive one by one (RECORD). Of a record without a SHA-1 header the payload's own is taken; a revisit has no payload."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        said: dict[str, str] = {}
        while (line := stream.readline().strip()) != b"":
            name, _, value = line.decode(errors="replace").partition(":")
            said[name.lower()] = value.strip(" \t")
        block = stream.read(int(said["content-length"]))
        out = {field: said.get(name.lower()) for name, field in _FIELDS.items()}
        cut = block.find(b"\r\n\r\n") + 4 if (out["content_type"] or "").startswith("application/http") else 0
        if out["record_type"] == "revisit":
            out |= {"head": block, "payload": None}
        else:
            out |= {"head": block[:cut] if cut > 3 else b"", "payload": block[cut:] if cut > 3 else block}
        out["payload_digest"] = _hex(out["payload_digest"]) or (None if out["payload"] is None else hashlib.sha1(out["payload"]).hexdigest())
        out["page_id"] = None if out["page_id"] is None else unquote(out["page_id"])
        yield out


class Members(io.RawIOBase):
    """What the members of a gzip file hold, one after the other; cheaper for small ones than the standard library's reader."""

    def __init__(self, file: str):
        self.file, self.rest, self.member = open(file, "rb"), b"", None  # noqa: SIM115

    def readable(self) -> bool:
        return True

    def close(self) -> None:
        self.file.close()
        super().close()

    def readinto(self, into) -> int:
        while True:
            if not self.rest and not (more := self.file.read(1 << 16)):
                if self.member is None:
                    return 0
                out = self.member.decompress(b"", len(into))
                if not out and not self.member.eof:
                    raise EOFError("the archive ends within a member")
            else:
                self.rest = self.rest or more
                if self.member is None:
                    self.rest = self.rest.lstrip(b"\0")  # padding
                    if not self.rest:
                        continue
                    self.member = zlib.decompressobj(31)
                out = self.member.decompress(self.rest, len(into))
                self.rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if self.member.eof:
                self.member = None
            if out:
                into[: len(out)] = out
                return len(out)


def _opened(file: str) -> io.BufferedIOBase:
    return io.BufferedReader(Members(file), 1 << 16) if file.endswith(".gz") else open(file, "rb")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """A row ``file`` for each archive in ``path``; contents aren't read here."""
    if not any(".warc" in e.name for e in os.scandir(path)):
        return spark.createDataFrame([], "file string")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(f"file://{path}")
    return listed.select(F.regexp_replace("path", "^file:/*", "/").alias("file"))


def _dealt(files: DataFrame) -> DataFrame:
    """An archive a task, up to 100,000 of them; a count that AQE doesn't lower though the rows are small."""
    return files.repartition(max(1, min(files.count(), 100_000)))


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = _schema(HEADERS)
    for batch in batches:
        for file in batch.column(0).to_pylist():
            rows = []
            with _opened(file) as stream:
                for r in parse(stream):
                    payload = r["payload"]
                    own = {"file": file, "strong_digest": None, "payload_bytes": None, "intact": None}
                    if payload is not None:
                        own |= {"strong_digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload), "intact": r["payload_digest"] == hashlib.sha1(payload).hexdigest()}
                    rows.append({c: v for c, v in (r | own).items() if c in types.names})
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, types)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """HEADERS of all records of the archives in ``path``; payloads are read, checked and dropped where they lie.

    Sizes and SHA-256 are of the payload as read; a revisit has none, and ``intact`` says whether the digest header holds.
    """
    return _dealt(archives(spark, path)).mapInArrow(_headers, HEADERS)


def resolve(headers: DataFrame, key: Column | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Each record that should be a revisit, with its response: ``file, record_id, to_id, to_uri, to_date, to_page``.

    Of the responses of equal payloads of at least ``min_bytes`` the one of the greatest ``key`` (the page id by default;
    null is least, the record id breaks ties) stays; the others refer to it, and so do revisits of that digest that the
    archives hold already. Revisits without a response here aren't listed. Payloads are equal if SHA-1, SHA-256 and size
    are; records whose digest header doesn't hold stay what they are. Headers meet their group's one response by an
    ordinary join on the digest, whose groups were reduced before the shuffle.
    """
    key = F.col("page_id") if key is None else key
    own = headers.where("record_type = 'response' and intact and payload_bytes >= %d" % min_bytes).withColumn("key", key)
    chosen = own.groupBy("payload_digest", "strong_digest").agg(F.max(F.struct("key", "record_id", "uri", "date", "page_id")).alias("to"), F.count("*").alias("n"))
    to = [F.col("to.record_id").alias("to_id"), F.col("to.uri").alias("to_uri"), F.col("to.date").alias("to_date"), F.col("to.page_id").alias("to_page")]
    many = chosen.where("n > 1").select("payload_digest", "strong_digest", *to)
    again = own.select("file", "record_id", "payload_digest", "strong_digest").join(many, ["payload_digest", "strong_digest"]).where("record_id <> to_id")
    # a revisit has no payload to tell apart two of one SHA-1: such a digest is left as it is
    single = chosen.groupBy("payload_digest").agg(F.count("*").alias("kinds"), F.first("to").alias("to")).where("kinds = 1").select("payload_digest", *to)
    old = headers.where("record_type = 'revisit'").select("file", "record_id", "payload_digest").join(single, "payload_digest")
    out = ["file", "record_id", "to_id", "to_uri", "to_date", "to_page"]
    return again.select(*out).union(old.select(*out))


def _rewritten(salt: str):
    fresh = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, salt + i)}>"
    types = _schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, changes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = {c["record_id"]: c for c in changes or ()}
                rows, size = [], 0
                with _opened(file) as stream:
                    for r in parse(stream):
                        if c := to.get(r["record_id"]):
                            r |= {"record_type": "revisit", "payload": None, "refers_to_id": fresh(c["to_id"]), "refers_to_uri": c["to_uri"], "refers_to_date": c["to_date"]}
                        r["record_id"] = fresh(r["record_id"] or uuid.uuid4().hex)
                        rows.append(r)
                        size += len(r["payload"] or b"")
                        if size >= BATCH or len(rows) >= 5_000:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, types)

    return run


def deduplicate(spark: SparkSession, source: str, target: str, key: Column | None = None, min_bytes: int = MIN_BYTES) -> None:
    """Write the archives in ``source`` to ``target`` with fresh headers, equal payloads once (:func:`resolve`).

    Record ids are new, worked out from the old ones, so that revisits can name a response that another task writes.
    Revisits without a response in ``source`` keep what they refer to; records of other types keep their blocks.
    """
    headers = materialise(read_headers(spark, source), "headers")
    changes = resolve(headers, key, min_bytes).groupBy("file").agg(F.collect_list(F.struct("record_id", "to_id", "to_uri", "to_date")).alias("changes"))  # RECORDS of a file at most
    each = materialise(archives(spark, source).join(changes, "file", "left").select("file", "changes"), "changes")
    write_archive(_dealt(each).mapInArrow(_rewritten(uuid.uuid4().hex), RECORD), target)
    discard(headers)
    discard(each)


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record_type, payload_bytes, payload_digest, refers_to_page, resolved`` of each record, revisits through their response.

    ``page_id``s are text. A revisit whose response isn't in ``path``, or has another digest, isn't ``resolved`` and has
    no bytes; a response is unless its digest header is wrong.
    """
    headers = materialise(read_headers(spark, path), "headers")
    to = headers.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to_page"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest"), F.col("intact").alias("to_intact"))
    revisits = headers.where("record_type = 'revisit'").join(to, "refers_to_id", "left")
    good = F.coalesce((F.col("payload_digest") == F.col("to_digest")) & F.col("to_intact"), F.lit(False))
    none = F.lit(None).cast("string")
    own = headers.where("record_type = 'response'").select("page_id", "record_type", "payload_bytes", "payload_digest", none.alias("refers_to_page"), F.coalesce("intact", F.lit(False)).alias("resolved"))
    out = own.union(revisits.select("page_id", "record_type", F.when(good, F.col("to_bytes")), "payload_digest", F.when(good, F.col("refers_to_page")), good))
    return used(out, headers)


def op12_warc_revisits(spark, sf_dir: str) -> DataFrame:
    base = f"{mounted_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), f"{base}/crawled")
    deduplicate(spark, f"{base}/crawled", f"{base}/deduplicated", F.col("page_id").cast("long"))
    out = read_resolved(spark, f"{base}/deduplicated")
    return out.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").cast("long").alias("refers_to"))


OP12_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, strlen(body) AS n, sha1(body) AS digest, CASE WHEN strlen(body) >= {MIN_BYTES} THEN max(page_id) OVER (PARTITION BY body) END AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM g
"""
