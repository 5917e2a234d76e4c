"""WARC archives of web pages, compressed with Zstandard: writing, and reading them back.

An archive is a skippable frame that carries the dictionary, then one frame for each record, so that any record can be
read alone. Of records with equal payloads of at least `least_bytes`, that with the largest page id is the response, the
others are revisits that name it and hold no payload. The reader loads the dictionary from the leading frame, decodes
frame by frame, and checks each record's version, headers and lengths, and the digest of each payload.

Tasks write archives of bounded size under names of their own and return a manifest; what a lost or repeated task wrote is
in no manifest, so readers never see it. Archives lie in the folder that the cluster shares (any path that
pyarrow.fs.FileSystem.from_uri takes). The dictionary is trained on a bounded sample of payloads (`dict_rows` of them).

Defined results: null html is an empty payload; a null url becomes urn:page:<id>; rows that repeat a page id with equal
payload are treated alike (all responses, or all revisits of the same page); null page ids are kept, as null; an empty
table gives no archives and no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import common as C

#: Magic numbers of the dictionary's skippable frame and of a Zstandard frame.
SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_DATE = "2000-01-01T00:00:00Z"


def with_duplicates(pages: DataFrame, least_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, digest, size, refers_to: the response's id for revisits, else null."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    heads = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    # Only digests met twice or more, without payloads, are joined; then a page id and digest find their head.
    found = rows.filter(F.col("size") >= least_bytes).select("page_id", "digest").join(heads.select("digest", "head"), "digest").filter("page_id < head").distinct()
    joined = rows.alias("r").join(found.alias("f"), (F.col("r.page_id") == F.col("f.page_id")) & (F.col("r.digest") == F.col("f.digest")), "left")
    return joined.select("r.*", F.col("f.head").alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'urn:page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: WARC headers, then an HTTP head, then the payload unless it is a revisit."""
    one_line = lambda x: "".join(c if c > " " else "%%%02X" % ord(c) for c in x)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": _DATE,
        "WARC-Target-URI": one_line(url) if url else f"urn:page:{page_id}",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Page-ID": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "WARC-Refers-To-Page-ID": str(refers_to)}
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, rows: int, most_bytes: int = 16 << 10) -> bytes:
    """A dictionary from at most `rows` payloads; empty where there is too little to learn from."""
    html = pages.columns[-1]
    seen = [bytes(r[0][: 16 << 10], "utf-8") for r in pages.select(F.col(html)).filter(F.length(html) > 0).limit(rows).toLocalIterator()]
    try:
        return zstandard.train_dictionary(most_bytes, seen).as_bytes() if len(seen) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def write_archives(rows: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes rows as with_duplicates() gives them; a manifest row (path, records, bytes) for each archive."""
    schema = "path string, records long, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True, write_checksum=True)
        out, done, name, n, size = None, [], "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", n, size))
                out = None

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name, n = f"pages-{uuid.uuid4().hex}.warc.zst", 0
                    out = fs.open_output_stream(f"{base}/{name}")
                    size = out.write(struct.pack("<II", SKIP_MAGIC, len(dictionary)) + dictionary)
                size += out.write(press.compress(record(*row)))
                n += 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({k: [d[i] for d in done] for i, k in enumerate(("path", "records", "bytes"))}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, schema)


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one frame at a time; a small window of the file is held."""
    magic, size = struct.unpack("<II", _exactly(stream, 8))
    if magic != SKIP_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    dictionary = _exactly(stream, size)
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    unpress = zstandard.ZstdDecompressor(dict_data=known)
    held = b""
    while True:
        one, parts = unpress.decompressobj(), []
        while not one.eof:
            if not held and not (held := stream.read(1 << 18)):
                if parts or one.unconsumed_tail:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(one.decompress(held))
            held = one.unused_data
        yield b"".join(parts)


def _exactly(stream, n: int) -> bytes:
    out = stream.read(n)
    if len(out) != n:
        raise ValueError("the archive ends within its dictionary")
    return out


def parse(raw: bytes) -> dict:
    """One record's fields; ValueError if version, headers, lengths or digest don't hold."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not found or version != VERSION:
        raise ValueError(f"not a {VERSION.decode()} record")
    fields = {}
    for x in lines:
        k, colon, v = x.decode().partition(":")
        if not colon or not k or k != k.strip():
            raise ValueError(f"malformed header line {x[:80]!r}")
        fields[k.lower()] = v.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"headers are missing: {sorted(missing)}")
    n = int(fields["content-length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError("the block's length isn't that of its header")
    http, found, payload = block.partition(b"\r\n\r\n")
    told = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not found or len(told) != 1:
        raise ValueError("the HTTP head doesn't tell its length")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (told[0] != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload's length or digest isn't that of its headers")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit holds no payload and names its response")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {"page_id": number("warc-page-id"), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": told[0], "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to-page-id")}


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives whose paths the manifest names."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    if not payloads:
        del kinds["payload"]
    arrow = pa.schema(list(kinds.items()))
    schema = "page_id long, url string, " + "payload binary, " * payloads + "payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = open_fs(uri)
                with fs.open_input_stream(path) as f:
                    rows, size = [], 0
                    for raw in frames(f):
                        rows.append({k: v for k, v in parse(raw).items() if k in kinds})
                        size += len(raw)
                        if len(rows) >= 1000 or size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return manifest.select("path").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, dict_rows: int = 200, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes the pages' archives and their manifest under `folder` and returns the manifest."""
    spark = pages.sparkSession
    dictionary = train_dictionary(pages.select(F.col(html_col)), dict_rows)
    rows = with_duplicates(pages, least_bytes, id_col, url_col, html_col)
    manifest = write_archives(rows, f"{folder}/archives", dictionary, archive_bytes)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archive(C.table(spark, sf_dir, "pages"), C.new_path(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, payload_digest,
  CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < head THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)
"""
