"""WARC archives: writing, normalising of monolithic gzip files, and reading by offset."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_rows, shared_path, stored, tidy
from .files import opened, replaced

BREAK = b"\r\n"
VERSION = b"WARC/1.1"
CHUNK = 1 << 20
#: Fixed value: the profile of a revisit with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
LINE_MOST = (1 << 31) + (1 << 10)  # a field's name and the longest text that a column holds
FIRST_MOST = 1 << 16  # bytes in which a record's first line ends


def record_id(page: int | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page}/{copy}')}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version, named fields with the block's length last, an empty line, the block, two line ends."""
    clean = [(k, str(v).replace("\r", " ").replace("\n", " ")) for k, v in fields]
    head = b"".join(f"{k}: {v}".encode("utf-8", "replace") + BREAK for k, v in [*clean, ("Content-Length", str(len(block)))])
    return VERSION + BREAK + head + BREAK + block + BREAK + BREAK


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int = 0, size: int | None = None) -> bytes:
    """A response with its payload, or a revisit with none, which tells the payload's length (`size` where the payload
    isn't given) and the page it equals."""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", "" if page is None else str(page)), ("X-Payload-Length", str(len(payload) if size is None else size))]
    http = b"HTTP/1.1 200 OK" + BREAK + b"Content-Type: text/html; charset=utf-8" + BREAK
    if refers_to is None:
        return record([*fields, ("Content-Type", "application/http;msgtype=response")], http + b"Content-Length: " + str(len(payload)).encode() + BREAK * 2 + payload)
    return record([*fields, ("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", str(refers_to)), ("Content-Type", "application/http;msgtype=response")], http + BREAK)


class Inflated:
    """The bytes of a gzip file of one or many members, inflated as they are asked for, each part once."""

    def __init__(self, stream):
        self.stream, self.inflate, self.ready, self.over = stream, zlib.decompressobj(31), bytearray(), False
        self.rest = b""

    def _more(self) -> bool:
        while not self.over:
            data = self.rest or self.stream.read(CHUNK)
            self.rest = b""
            if not data:
                if not self.inflate.eof and self.started:
                    raise ValueError("the gzip stream is cut off")
                self.over = True
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            out = self.inflate.decompress(data, 4 * CHUNK)
            self.started = True
            self.rest = self.inflate.unconsumed_tail or self.inflate.unused_data
            if out:
                self.ready += out
                return True
        return False

    started = False

    def take(self, n: int) -> bytes:
        while len(self.ready) < n and self._more():
            pass
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def line(self, most: int = LINE_MOST) -> bytes:
        """Up to a line feed, included; what is left at the end. A line may have `most` bytes and is refused if longer."""
        seen = 0
        while (at := self.ready.find(b"\n", seen)) < 0:
            seen = len(self.ready)
            if seen > most:
                raise ValueError("a header line is too long")
            if not self._more():
                return self.take(len(self.ready))
        return self.take(at + 1)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, the record's bytes) of every record of a gzip file, however its members lie."""
    data = Inflated(stream)
    while True:
        first = data.line(FIRST_MOST)
        while first in (b"\r\n", b"\n"):  # between records
            first = data.line(FIRST_MOST)
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {first[:20]!r}")
        head, fields = [first], {}
        while (line := data.line()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a record's head is cut off")
            head.append(line)
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        block = data.take(n)
        if len(block) < n:
            raise ValueError("a record's block is cut off")
        yield fields, b"".join(head) + BREAK + block + BREAK * 2


def normalise(source: str, target: str) -> list[dict]:
    """Inflates `source` once from end to end, writes every record to `target` as a gzip member of its own, and puts an
    index beside it (`target`.idx, a JSON line a record: offset, length, type, uri, page, digest), which it returns."""
    index, out, side = [], replaced(target), replaced(target + ".idx")
    try:
        with opened(source) as stream:
            for fields, data in records(stream):
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = squeeze.compress(data) + squeeze.flush()
                row = {"offset": out.size, "length": len(member), "type": fields.get("warc-type", ""), "uri": fields.get("warc-target-uri", ""), "page": fields.get("x-page-id", ""), "digest": fields.get("warc-payload-digest", "")}
                out.write(member)
                side.write(json.dumps(row).encode() + b"\n")
                index.append(row)
        side.done()
        out.done()
    except BaseException:
        for f in (out, side):
            f.dropped()
        raise
    return index


def read_at(stream, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The fields and the block of the record whose member begins at offset."""
    import io

    stream.seek(offset)
    fields, data = next(records(io.BytesIO(stream.read(length))))
    n = int(fields["content-length"])
    return fields, data[len(data) - 4 - n : len(data) - 4]


def payload_of(block: bytes) -> bytes:
    return block.partition(BREAK * 2)[2]


KNOWN_MOST = 200_000  # copies' digests that are broadcast, of about 100 bytes each


def with_revisits(pages: DataFrame, least: int = 1000, known_most: int = KNOWN_MOST) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, refers_to: of rows with equal payloads of `least` bytes or more,
    the one with the largest page_id is the response and the others refer to it; refers_to is null for responses, html
    is null for the others.

    Only digests are shuffled to find copies, by an aggregate with partial results: a row a digest and task. Where at
    most `known_most` digests have copies, they are broadcast and pages stay in the partitions they were read in. Beyond
    that, the digests that more rows share than a partition should hold are broadcast (as many as there are partitions
    at most), which decides their rows; all others meet in a join by digest, where rows that are decided already, or
    too small, are dealt by a hash of their own. So no task gets the rows of a payload that very many pages share."""
    spark = pages.sparkSession
    rows = long_rows(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_digest": F.sha1(F.col("html").cast("binary")), "payload_bytes": F.octet_length("html").cast("long")})
    big = F.col("payload_bytes") >= least
    sizes = rows.where(big & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    copies = stored(sizes.where("n > 1").select(F.col("payload_digest").alias("same"), "last", "n"), "copies")
    seen = copies.agg(F.count(F.lit(1)), F.sum("n")).first()
    known = copies
    if seen[0] > known_most:
        most = max(2, seen[1] // int(spark.conf.get("spark.sql.shuffle.partitions")))
        known = copies.where(F.col("n") >= most)  # a partition's rows each, so no more than there are partitions
        copies = copies.where(F.col("n") < most).select(F.col("same").alias("same_too"), F.col("last").alias("last_too"))
    known = F.broadcast(known.select("same", "last"))
    rows = rows.join(known, (F.col("payload_digest") == F.col("same")) & big, "left")
    rows = rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")))
    if seen[0] > known_most:
        own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))  # no digest
        rows = rows.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
        rows = rows.withColumn("by", F.when(big & F.col("last").isNull(), F.col("payload_digest")).otherwise(own)).join(copies, F.col("by") == F.col("same_too"), "left")
        rows = rows.withColumn("refers_to", F.coalesce("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last_too")), F.col("last_too"))))
    return rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "payload_digest", "payload_bytes", "refers_to")


def write_archives(rows: DataFrame, path: str) -> DataFrame:
    """Writes each partition's records to one gzip stream (`path`/part-NNNNN.warc.gz) and returns (file, records): a row
    a file. Files are put in place whole, under a name that a repeated task shares."""

    def run(batches):
        from pyspark import TaskContext

        name = f"{path}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        # what is to be written anew isn't worth much work
        out, squeeze, n = None, zlib.compressobj(1, zlib.DEFLATED, 31), 0
        try:
            for batch in batches:
                for page, url, html, digest, size, refers in zip(*batch.columns, strict=True):
                    if out is None:
                        out = replaced(name)
                    payload = (html.as_py() or "").encode("utf-8", "replace")
                    out.write(squeeze.compress(page_record(page.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py(), n, size.as_py())))
                    n += 1
            if out is not None:
                out.write(squeeze.flush())
                out.done()
                out = None
                yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])
        finally:
            if out is not None:
                out.dropped()
        tidy()

    return stored(rows.mapInArrow(run, "file string, records long"), "archives")


def normalise_archives(files: DataFrame, path: str) -> DataFrame:
    """Normalises every file to `path`, one task each, and returns the index: file, offset, length, type."""

    def run(batches):
        for batch in batches:
            for f in batch.column(0).to_pylist():
                target = f"{path}/{f.rpartition('/')[2]}"
                index = normalise(f, target)
                yield pa.record_batch([pa.array([target] * len(index)), pa.array([r["offset"] for r in index], pa.int64()), pa.array([r["length"] for r in index], pa.int64()), pa.array([r["type"] for r in index])], ["file", "offset", "length", "type"])
        tidy()

    return stored(spread(files.select("file"), "file").mapInArrow(run, "file string, offset long, length long, type string"), "index")


def spread(files: DataFrame, *cols: str) -> DataFrame:
    """Rows that each stand for much work, over as many tasks as there are shuffle partitions."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def read_pages(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the index, each read by its
    offset. A response's payload is measured and digested anew; a revisit tells its own."""

    def run(batches):
        name, stream = None, None
        try:
            for batch in batches:
                out: list[tuple] = []
                for f, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if f != name:
                        if stream is not None:
                            stream.close()
                        name, stream = f, opened(f)
                    fields, block = read_at(stream, offset, length)
                    page = int(fields["x-page-id"]) if fields["x-page-id"] else None
                    if fields["warc-type"] == "response":
                        payload = payload_of(block)
                        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response", None))
                    else:
                        out.append((page, int(fields["x-payload-length"]), fields["warc-payload-digest"].rpartition(":")[2], "revisit", int(fields["x-refers-to-page-id"])))
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        finally:
            if stream is not None:
                stream.close()
        tidy()

    cut = F.floor(F.col("offset") / (32 << 20))  # a large archive is read by several tasks
    dealt = spread(index.select("file", "offset", "length").withColumn("cut", cut), "file", "cut").sortWithinPartitions("file", "offset")
    return dealt.drop("cut").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes pages to archives of one gzip stream each in the shared folder, normalises those, and reads all records
    back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is empty, a null url an empty one. A page with a null page_id is never a copy's original; it refers to
    one if its payload is large and equal. Of rows with the same page_id and payload, all are responses or all refer to
    the same one. Other columns are ignored. An empty table writes no archive and gives no rows."""
    path = shared_path(pages.sparkSession, "warc")
    files = write_archives(with_revisits(pages, least), f"{path}/whole")
    return read_pages(normalise_archives(files, f"{path}/records"))
