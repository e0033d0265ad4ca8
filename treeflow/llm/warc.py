"""WARC archives as a chunked record table.

An archive is a table of rows ``(part, rec, chunk_no, n_chunks, header, bytes, running)``: record ``rec`` is its header
block followed by its chunks in order, ``running`` is the SHA-256 of the payload up to and including the chunk. A payload
above ``CHUNK`` bytes becomes several rows. Payloads are cut by Spark's own functions, chunk by chunk, from the row that holds
them (a payload is one value of the input table, so the JVM has it in memory once); writer and reader get chunk rows and keep
one chunk and one hash state at a time, never a whole record. Table rows go through Spark's writer, so any store that Spark
can write holds archives; ``export_archive`` streams one part of the table into a .warc file.

Reading: one-chunk records are checked where they are; only records of several chunks are brought together by record and
chunk number, and streamed through one hash state.

Defined results: null payload is empty; payloads below ``MIN_SHARED`` bytes are always responses; rows that repeat the
smallest page_id of a payload are responses too; rows without a page_id are responses unless another row has the payload;
null urls give an empty target; other columns are ignored; payloads of any size that a Spark value holds (2 GB) are whole; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, map_rows, materialise, rows_of, salted_left_join, small, to_arrow

CHUNK = 256 * 1024
MIN_SHARED = 100
HOT_SHARE = 0.01
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE = "part int, rec long, chunk_no int, n_chunks int, header binary, bytes binary, running string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, n_chunks int"


def head(page_id, url: str | None, kind: str, digest: str, size: int, refers_to) -> bytes:
    """The record's header block with the HTTP header that opens its content block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:treeflow:page:{page_id}>", f"WARC-Date: {DATE}"]
    lines += ["WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or ""), f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:treeflow:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    return CRLF.join(x.encode() for x in lines) + CRLF + CRLF + http


def parse_head(block: bytes) -> dict[str, str]:
    warc, _, http = block.partition(CRLF + CRLF)
    fields = dict(x.split(": ", 1) for x in warc.decode().split("\r\n")[1:] if ": " in x)
    size = re.search(rb"Content-Length: (\d+)", http)
    return fields | {"payload": size[1].decode() if size else "0"}


def first_holders(pages: DataFrame, id_col: str, payload_col: str) -> tuple[DataFrame, DataFrame]:
    """Digests of payloads that more than one row has, with the smallest id; and those of very many rows."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    shared = pages.select(F.col(id_col).cast("long").alias("id"), F.octet_length(payload).alias("size"), F.sha2(payload, 256).alias("digest")).where(F.col("size") >= MIN_SHARED)
    groups = materialise(shared.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "warc-shared")
    total = groups.agg(F.sum("n")).first()[0] or 0
    return groups, groups.where(F.col("n") > max(1, int(total * HOT_SHARE))).select("digest")


def write_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Write the archive and return its table."""
    from pyspark import TaskContext

    holders, hot = first_holders(pages, id_col, payload_col)
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    holders = holders.select("digest", "first_id")
    rows = rows.join(F.broadcast(holders), "digest", "left") if small(holders) else salted_left_join(rows, holders, "digest", hot)
    size = F.octet_length("payload")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    count = F.when(again, F.lit(1)).otherwise(F.greatest(F.ceil(size / chunk), F.lit(1))).cast("int")
    rows = rows.select("page_id", "url", "digest", "first_id", size.alias("size"), again.alias("again"), count.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("no"), "payload")
    piece = F.when(F.col("again"), F.lit(b"")).otherwise(F.substring("payload", F.col("no") * chunk + 1, F.lit(chunk)))
    chunks = rows.select("page_id", "url", "digest", "first_id", "size", "again", "no", "n", piece.alias("bytes"))

    def make():
        part, count, state, rec = TaskContext.get().partitionId(), 0, None, 0

        def each(row):  # the chunks of a record come one after the other
            nonlocal count, state, rec
            page, url, digest, first, size, again, no, n, body = row
            top = None
            if no == 0:
                rec, state = part << 40 | count, hashlib.sha256()
                count += 1
                top = head(page, url, "revisit" if again else "response", digest, size, first)
            state.update(body)
            running = digest if again else state.hexdigest()
            if no == n - 1 and running != digest:
                raise ValueError(f"page {page}: its chunks don't make up its payload")
            yield part, rec, no, n, top, body, running

        return each

    return materialise(map_rows(chunks, make, ARCHIVE, weigh=lambda row: len(row[5])), "warc")


def _finish(fields: dict[str, str], size: int, digest: str, n_chunks: int) -> tuple:
    """The row of a record whose payload has been read to its end."""
    kind = fields["WARC-Type"]
    want, stated = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["payload"])
    if kind == "response" and (digest, size) != (want, stated):
        raise ValueError(f"record {fields['WARC-Record-ID']}: payload doesn't match its digest")
    number = lambda uri: None if uri is None or uri.endswith(":None>") else int(uri.rstrip(">").rpartition(":")[2])
    return number(fields["WARC-Record-ID"]), stated, want, kind, number(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], n_chunks


def read_records(archive: DataFrame) -> DataFrame:
    """Read records back, checking every payload against its digest and every chunk against its running digest."""

    def whole():
        def each(row):
            block, body = row
            yield _finish(parse_head(block), len(body), hashlib.sha256(body).hexdigest(), 1)

        return each

    one = map_rows(archive.where("n_chunks = 1").select("header", "bytes"), whole, READ)
    arrow = to_arrow(archive.sparkSession, READ)

    def stream(it) -> Iterator:
        def rows():
            rec = fields = state = None
            size = 0
            for batch in it:
                for r, no, n, block, body, running in rows_of(batch):
                    if r != rec:
                        rec, fields, state, size = r, parse_head(block), hashlib.sha256(), 0
                    state.update(body)
                    size += len(body)
                    if state.hexdigest() != running:
                        raise ValueError(f"record {r}, chunk {no}: running digest doesn't match")
                    if no == n - 1:
                        yield _finish(fields, size, running, n)

        return batches(rows(), arrow)

    several = archive.where("n_chunks > 1").select("rec", "chunk_no", "n_chunks", "header", "bytes", "running")
    several = several.repartition("rec").sortWithinPartitions("rec", "chunk_no").mapInArrow(stream, READ)
    return one.unionByName(several)


def export_archive(archive: DataFrame, part: int, path: str) -> int:
    """Stream one part of the table, in record and chunk order, into a .warc file on the driver's disk; gives the records
    written. Rows come one at a time (``toLocalIterator``)."""
    n = 0
    with open(path, "wb") as out:
        for r in archive.where(F.col("part") == part).orderBy("rec", "chunk_no").toLocalIterator():
            out.write((bytes(r.header) if r.header is not None else b"") + bytes(r.bytes))
            if r.chunk_no == r.n_chunks - 1:
                out.write(CRLF + CRLF)
                n += 1
    return n


def read_file(path: str, chunk: int = CHUNK) -> Iterator[tuple]:
    """Records of a .warc file, read ``chunk`` bytes at a time; the same rows as ``read_records``."""
    with open(path, "rb") as f:
        while (line := f.readline()):
            if not line.strip():
                continue
            block = line
            while (line := f.readline()).strip():
                block += line
            block += CRLF
            length = int(re.search(rb"\r\nContent-Length: (\d+)", block)[1])
            http = b""
            while not http.endswith(CRLF + CRLF):
                http += f.readline()
            left, state, size = length - len(http), hashlib.sha256(), 0
            while left and (piece := f.read(min(chunk, left))):
                state.update(piece)
                size, left = size + len(piece), left - len(piece)
            yield _finish(parse_head(block + http), size, state.hexdigest(), max(1, -(-size // chunk)))
