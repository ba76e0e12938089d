"""WARC archives: a writer that revisits equal payloads and a sequential reader.

Every record is a gzip member of its own.  The reader goes through a file once, decompressing
incrementally, frames each record by its Content-Length and verifies payload digests.

Edge cases: a null or empty payload is written as an empty response; null URLs become an empty
target; a repeated page_id with the same payload stays a response in each of its rows; an empty
table gives no archive and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.work import AtomicFile, opened, shared_folder, stored

#: Payloads of fewer bytes are never revisited.
MIN_REVISIT_BYTES = 100
_CHUNK = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def gzip_member(parts: list[bytes], level: int = 5) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([*map(z.compress, parts), z.flush()])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that names the page which has it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = [http] if refers_to is not None else [http, payload]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%-._~')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines.append(f"Content-Length: {sum(map(len, body))}")
    return gzip_member(["\r\n".join(lines).encode() + b"\r\n\r\n", *body, b"\r\n\r\n"])


class MemberStream:
    """The decompressed bytes of one gzip member after another, read a chunk at a time."""

    def __init__(self, source):
        self.source, self.raw = source, b""

    def next_member(self) -> bool:
        """Go on to the next member; False at the end of the file."""
        self.raw = self.raw or self.source.read(_CHUNK)
        self.z, self.ready = zlib.decompressobj(31), b""
        return bool(self.raw)

    def _more(self) -> bool:
        if self.z.eof:
            return False
        self.raw = self.raw or self.source.read(_CHUNK)
        if not self.raw:
            raise ValueError("truncated gzip member")
        self.ready += self.z.decompress(self.raw, _CHUNK)
        self.raw = self.z.unconsumed_tail or self.z.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if not self._more():
                raise ValueError("record without an end of its header")
        head, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly ``n`` bytes, in chunks."""
        while n:
            if not self.ready and not self._more():
                raise ValueError("record shorter than its Content-Length")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            if part:
                yield part

    def end(self) -> None:
        while self._more():
            pass
        if self.ready != b"\r\n\r\n":
            raise ValueError("record longer than its Content-Length")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def read_records(source, keep_payload: bool = False) -> Iterator[dict]:
    """Records of an open archive in file order.

    Raises ValueError for a wrong frame, a truncated member or a payload whose digest isn't the declared one.
    """
    stream = MemberStream(source)
    page = lambda s: int(x) if (x := s[len("<urn:page:") : -1]) else None
    while stream.next_member():
        fields = _fields(stream.until(b"\r\n\r\n"))
        length, declared = int(fields["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
        http, kind = stream.until(b"\r\n\r\n"), fields["warc-type"]
        size = int(_fields(http)["content-length"])
        if length != len(http) + 4 + (size if kind == "response" else 0):
            raise ValueError("Content-Length doesn't match the block")
        sha, kept = hashlib.sha256(), []
        for part in stream.take(size if kind == "response" else 0):
            sha.update(part)
            if keep_payload:
                kept.append(part)
        stream.end()
        if kind == "response" and sha.hexdigest() != declared:
            raise ValueError(f"payload digest of {fields['warc-record-id']} doesn't match")
        yield {
            "page_id": page(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": declared, "record_type": kind,
            "refers_to": page(fields["warc-refers-to"]) if kind == "revisit" else None, "url": fields["warc-target-uri"], "payload": b"".join(kept) if keep_payload else None,
        }


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to.

    The first page of each payload comes from a pre-aggregated table of repeated digests; it joins the
    pages by digest, and as both sides are plain exchanges, adaptive execution splits a digest that a
    third of all pages share.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    first = rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = stored(first.filter("n > 1").drop("n"), "warc-first")
    refers = F.when(F.col("page_id") != F.col("first_id"), F.col("first_id"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> list[str]:
    """One archive for each partition of ``pages`` in ``folder``; the paths, in partition order."""

    def write(batches):
        out = None
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        n = 0
        for b in batches:
            for page_id, url, html, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                out = out or AtomicFile(folder, name)
                out.write(record(page_id, url, html.encode(), digest, refers))
                n += 1
        if out:
            out.commit()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})

    made = with_revisits(pages, min_bytes).mapInArrow(write, "path string, records long")
    return sorted(r.path for r in made.collect())  # a row for each archive


def read_warc(spark: SparkSession, paths: list[str], keep_payload: bool = False) -> DataFrame:
    """Records of the archives, a task for each; ``payload`` and ``url`` too if ``keep_payload``."""
    schema = _RECORD + (", url string, payload binary" if keep_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        arrow = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        for b in batches:
            for i in b.column(0).to_pylist():
                fs, path = opened(paths[i])
                with fs.open_input_stream(path, compression=None) as f:
                    rows = []

                    def batch(rows=rows):
                        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], arrow.get(c, pa.string())) for c in names], names)

                    size = 0
                    for r in read_records(f, keep_payload):
                        rows.append(r)
                        size += r["payload_bytes"] if keep_payload else 0
                        if len(rows) >= 4096 or size > 16 << 20:
                            yield batch()
                            rows.clear()
                            size = 0
                    if rows:
                        yield batch()

    return spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(read, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_warc(spark, write_warc(pages, shared_folder(spark, "warc")))
