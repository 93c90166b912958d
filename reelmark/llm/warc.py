"""WARC archives: a writer with revisit records and a sequential reader.

Writing: payload digests are grouped natively to find equal payloads, and each task streams its rows into gzip
members, one per record, beginning another archive when one is large enough. Archive names follow from the
partition, so a task that runs again replaces its own files.

Reading: one task walks an archive from front to back in small chunks: an incremental inflater per gzip member,
the header block up to the blank line, then exactly Content-Length bytes, then digest verification. Nothing is
held beyond one record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, shared_dir, written

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
READ_SCHEMA = (
    "archive string, record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint,"
    " payload_digest string, digest_ok boolean, payload binary"
)


class WarcError(ValueError):
    """The archive's framing or a record's digest is broken."""


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One response or revisit record, before compression. A revisit keeps the HTTP header and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c if c > " " else "%%%02X" % ord(c) for c in uri or "")
    head = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + CRLF + CRLF


class _Members:
    """The inflated bytes of a gzip file, a member at a time; reads the source in chunks."""

    def __init__(self, source, chunk: int):
        self.source, self.chunk, self.raw = source, chunk, b""

    def next_member(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(self.chunk)
        self.z, self.out = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def _more(self) -> bool:
        """Inflates another chunk; False at the member's end."""
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.raw or self.source.read(self.chunk)
        if not data:
            raise WarcError("the archive ends inside a gzip member")
        self.raw = b""
        self.out += self.z.decompress(data, self.chunk)
        if self.z.eof:
            self.raw = self.z.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (i := self.out.find(mark, at)) < 0:
            at = max(0, len(self.out) - len(mark))
            if not self._more():
                raise WarcError("a header without end")
        head = bytes(self.out[:i])
        del self.out[: i + len(mark)]
        return head

    def exactly(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more():
                raise WarcError("a record shorter than its Content-Length")
        body = bytes(self.out[:n])
        del self.out[:n]
        return body

    def finish(self) -> None:
        while self._more():
            pass
        if bytes(self.out) != CRLF + CRLF:
            raise WarcError("a record not closed by two line ends")


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def records(source, chunk: int = 1 << 16) -> Iterator[dict]:
    """The records of an open archive, in order. Raises WarcError where the framing is broken."""
    members = _Members(source, chunk)
    while members.next_member():
        head = _fields(members.until(CRLF + CRLF))
        block = members.exactly(int(head["content-length"]))
        members.finish()
        http, _, payload = block.partition(CRLF + CRLF)
        full = head["warc-type"] != "revisit"
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
        yield {
            "record_id": head["warc-record-id"].strip("<>"),
            "record_type": head["warc-type"],
            "target_uri": head.get("warc-target-uri") or None,
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "payload_bytes": len(payload) if full else int(_fields(http)["content-length"]),
            "payload_digest": digest,
            "digest_ok": hashlib.sha1(payload).hexdigest() == digest if full else None,
            "payload": payload if full else None,
        }


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(_id, _sha, _refers) of the (_id, _body, _sha) rows whose payload an equal one with a larger id answers for.

    Digests are narrow rows. A digest with more rows than others is one row on the other side of the join, so
    the adaptive skew join may split it.
    """
    keys = rows.select("_id", "_sha", F.length("_body").alias("_n")).filter(F.col("_n") >= least_bytes)
    last = keys.groupBy("_sha", "_n").agg(F.max("_id").alias("_last"), F.count("*").alias("_k")).filter("_k > 1").drop("_k")
    return keys.join(last, ["_sha", "_n"]).filter("_id <> _last").groupBy("_id", "_sha").agg(F.max("_last").alias("_refers"))


def write_warc(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 1000, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record per row and returns the archives written: (archive, n_records), a small table.

    Null bodies are empty payloads, null urls empty URIs; rows with equal ids are each written, and all but the largest
    id among equal payloads are revisits; a null id is written as the id "null", is never a revisit and never answers for
    others. Ids are whole numbers of any size or text, and stay exact. An empty table gives no archive. Further columns,
    of whatever name, are ignored. A very long body is one record, which may make an archive of its size.
    """
    spark = pages.sparkSession
    out = shared_dir(spark, "warc")
    fs_out, root = _fs(out)
    fs_out.create_dir(root, recursive=True)
    body = F.coalesce(column(body_col).cast("binary"), F.lit(b""))
    rows = pages.select(column(id_col).alias("_id"), column(url_col).alias("_url"), body.alias("_body"), F.sha1(body).alias("_sha"))
    refs = revisits(rows.filter(F.col("_id").isNotNull()), least_bytes)
    dealt = rows.join(refs, ["_id", "_sha"], "left").sortWithinPartitions("_id", "_url").select("_id", "_url", "_body", "_refers")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, folder = _fs(out)
        # Arrow keeps numbers beside nulls whole. A slice's bodies are taken out at a time.
        rows = (x for batch in batches for at in range(0, batch.num_rows, 100) for x in zip(*(c.to_pylist() for c in batch.slice(at, 100).columns), strict=True))
        names, counts, more = [], [], next(rows, None)
        while more:
            name = f"part-{task.partitionId():06d}-{len(names):04d}.warc.gz"
            temp = f"{folder}/.{name}.{task.taskAttemptId()}"
            count = size = 0
            with fs.open_output_stream(temp, compression=None) as sink:
                while more and size < archive_bytes:
                    i, url, data, ref = more
                    urn = "urn:page:null" if i is None else f"urn:page:{i}"
                    member = _gzip(record(urn, url, data, hashlib.sha1(data).hexdigest(), None if ref is None else f"urn:page:{ref}"))
                    sink.write(member)
                    count, size, more = count + 1, size + len(member), next(rows, None)
            fs.move(temp, f"{folder}/{name}")
            names.append(f"{out}/{name}")
            counts.append(count)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "n_records"])

    return written(dealt.mapInArrow(write, "archive string, n_records bigint"), "warc-list")


def read_warc(archives: DataFrame, *, path_col: str = "archive", payloads: bool = True, strict: bool = True) -> DataFrame:
    """A row per record of each archive; with payloads=False the payload column stays null.

    Raises WarcError on broken framing and where a payload differs from its digest; with strict=False such a record is a
    row with digest_ok false. A revisit, whose payload is elsewhere, has a null digest_ok.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch[path_col]:
                fs, at = _fs(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as source:
                    for r in records(source):
                        if strict and r["digest_ok"] is False:
                            raise WarcError(f"{path}: the payload of {r['record_id']} differs from its digest")
                        if not payloads:
                            r["payload"] = None
                        rows.append(r | {"archive": path})
                        held += len(r["payload"] or b"") + 500
                        if held > 8 << 20:
                            yield pd.DataFrame(rows)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    columns = [c.strip().split(" ")[0] for c in READ_SCHEMA.split(",")]
    return (
        archives.select(path_col)
        .repartition(max(1, archives.count()), path_col)
        .mapInPandas(lambda it: (pdf[columns].astype({"payload": object}) for pdf in read(it)), READ_SCHEMA)
    )
