"""WARC archives by a chunked record table.

A payload becomes rows (record id, chunk number, bytes) of at most chunk_bytes; digests advance chunk by
chunk, and neither side ever holds a whole record. Archives are .warc.gz files (one gzip member a record)
in the shared folder. Null payloads are empty. Of records with equal payloads of at least
min_revisit_bytes the smallest id is the response; repeated ids keep one record for each row. Rows without
an id keep their records as well: they revisit the smallest id of their payload, or are responses where none has one.
Ids travel as text, so that ids beyond 2**53 and missing ones pass unchanged. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK = 1 << 16


def chunk_table(records: DataFrame, id_col: str, payload_col: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows (record as text, chunk_no, last, chunk); a record's chunks stay adjacent and in order."""
    data = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    n = F.greatest(F.lit(0), F.floor((F.octet_length("data") - 1) / F.lit(chunk_bytes))).cast("int")
    told = records.withColumn("refers_to", F.col("refers_to").cast("string")) if "refers_to" in records.columns else records
    rows = told.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("record"), data.alias("data"), *[c for c in ("record_type", "refers_to", "payload_digest", "payload_bytes") if c in records.columns])
    return rows.withColumn("n", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn(
        "chunk", F.substring(F.col("data"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).withColumn("last", F.col("chunk_no") == F.col("n")).drop("data", "n")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def digests(batches):
    sha, size = hashlib.sha1(), 0
    for batch in batches:
        out = []
        for record, no, last, chunk in zip(batch["record"], batch["chunk_no"], batch["last"], batch["chunk"]):
            if no == 0:
                sha, size = hashlib.sha1(), 0
            sha.update(chunk)
            size += len(chunk)
            if last:
                out.append((record, size, base32(sha.digest()), sha.hexdigest()))
        yield pd.DataFrame(out, columns=["record", "payload_bytes", "payload_digest", "sha"])


def _target(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _writer(folder: str):
    def write(batches):
        from pyspark import TaskContext

        store, base = _target(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        count, z = 0, None
        with store.open_output_stream(name) as sink:
            for batch in batches:
                for record, no, last, chunk, kind, refers, digest, size in zip(*(batch[c] for c in ("record", "chunk_no", "last", "chunk", "record_type", "refers_to", "payload_digest", "payload_bytes"))):
                    if no == 0:
                        z = zlib.compressobj(1, zlib.DEFLATED, 31)
                        revisit = kind == "revisit"
                        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:record:{record}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
                        if revisit:
                            head += f"WARC-Refers-To: <urn:record:{refers}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                        head += f"X-Payload-Length: {size}\r\nContent-Type: text/html\r\nContent-Length: {0 if revisit else size}\r\n\r\n"
                        sink.write(z.compress(head.encode()))
                    if kind != "revisit":
                        sink.write(z.compress(chunk))
                    if last:
                        sink.write(z.compress(b"\r\n\r\n") + z.flush())
                        count += 1
        yield pd.DataFrame({"path": [name], "records": [count]})

    return write


def write_archives(records: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", chunk_bytes: int = CHUNK) -> DataFrame:
    """Writes the archives; records carry record_type, refers_to, payload_digest and payload_bytes. Returns the finished files.

    A file belongs to a task attempt, and only files of attempts that succeeded are listed.
    """
    chunks = chunk_table(records, id_col, payload_col, chunk_bytes)
    return common.cut(chunks.mapInPandas(_writer(folder), "path string, records long"))


class _Unzipped(io.RawIOBase):
    """Gzip members read on as one stream, a bounded piece at a time."""

    def __init__(self, source):
        self.source, self.z, self.rest, self.held = source, None, b"", b""

    def read_some(self, size: int) -> bytes:
        while not self.held:
            if not self.rest:
                self.rest = self.source.read(1 << 16)
                if not self.rest:
                    return b""
            if self.z is None or self.z.eof:
                self.z = zlib.decompressobj(31)
            self.held = self.z.decompress(self.rest, 1 << 18)
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        out, self.held = self.held[:size], self.held[size:]
        return out

    def line(self) -> bytes:
        out = b""
        while not out.endswith(b"\r\n"):
            if not self.held:
                more = self.read_some(1 << 18)
                if not more:
                    return out
                self.held = more
            at = self.held.find(b"\n")
            take = len(self.held) if at < 0 else at + 1
            out, self.held = out + self.held[:take], self.held[take:]
        return out


def parsed(stream: _Unzipped):
    """Records of an archive as (headers, payload bytes, SHA-1 as base32), payloads read in pieces."""
    while line := stream.line():
        if not line.startswith(b"WARC/"):
            continue
        heads = {}
        while (line := stream.line()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            heads[key.strip().lower()] = value.strip()
        left = size = int(heads["content-length"])
        sha = hashlib.sha1()
        while left:
            piece = stream.read_some(min(left, 1 << 16))
            if not piece:
                raise ValueError("the archive ends within a record")
            sha.update(piece)
            left -= len(piece)
        yield heads, size, base32(sha.digest())


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the listed archives, digests taken anew from the payloads read."""

    def read(batches):
        store, _ = _target(folder)
        number = lambda urn: int(n) if (n := urn.rpartition(":")[2].rstrip(">")) else None
        framed = lambda rows: pd.DataFrame({c: pd.array([r[i] for r in rows], dtype="Int64" if c in ("page_id", "refers_to") else None) for i, c in enumerate(COLUMNS)})
        for batch in batches:
            for path in batch["path"]:
                out = []
                with store.open_input_stream(path) as source:
                    for heads, size, digest in parsed(_Unzipped(source)):
                        kind, said = heads["warc-type"], heads["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and digest != said:
                            raise ValueError(f"digest mismatch in {path}")
                        out.append((number(heads["warc-record-id"]), int(heads["x-payload-length"]), said, kind, number(heads["warc-refers-to"]) if kind == "revisit" else None))
                        if len(out) >= 4096:
                            yield framed(out)
                            out = []
                if out:
                    yield framed(out)

    return files.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("path")).mapInPandas(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def decide(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK) -> DataFrame:
    """(record, payload_bytes, payload_digest, record_type, refers_to) for each row."""
    sums = chunk_table(pages, id_col, payload_col, chunk_bytes).mapInPandas(digests, "record string, payload_bytes long, payload_digest string, sha string").withColumn("record", F.expr("try_cast(record AS long)"))
    sums = common.cut(sums)
    same = F.when(F.col("payload_bytes") >= min_revisit_bytes, F.col("record"))
    first = common.cut(sums.groupBy("payload_digest").agg(F.min(same).alias("first"), F.count("*").alias("n")))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("record")) & (F.col("payload_bytes") >= min_revisit_bytes)
    return common.met(sums, first, "payload_digest", sums.count()).select(
        "record", "sha", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.text_batches(spark)
    pages = common.table(spark, sf_dir, "pages").select("page_id", "html")
    plan = decide(pages)
    folder = common.fresh_path(spark, "warc")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    key = F.concat_ws("|", F.coalesce(F.col("record").cast("string"), F.lit("-")), "sha")
    what = F.first(F.struct("record_type", "refers_to", "payload_digest", "payload_bytes")).alias("what")  # the same for all rows of a key
    told = common.cut(plan.withColumn("row_key", key).groupBy("row_key").agg(what, F.count("*").alias("n")))
    records = pages.withColumnRenamed("page_id", "record").withColumn("sha", F.sha1(payload)).withColumn("row_key", key)
    records = common.met(records, told, "row_key", told.agg(F.sum("n")).first()[0] or 0).select("record", "html", "what.*")
    return read_archives(write_archives(records, folder, "record", "html"), folder)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
g AS (SELECT page_id, payload_bytes, list_transform(range(8), lambda i: CAST('0x' || substr(x, 1 + 5 * CAST(i AS INTEGER), 5) AS BIGINT)) AS v FROM d),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((n >> k) & 31) AS INTEGER), 1)), '')), '') AS payload_digest FROM g),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
