"""WARC archives as a chunked record table.

Writing: a payload becomes rows of chunks; a row of at most CHUNK bytes is one WARC record, the first a ``response`` or ``revisit``,
the others its ``continuation`` segments, as the format provides.  Spark's text writer puts the records into files of bounded size:
a record ends with two line ends, the writer's separator being the second.

Reading: each file is walked through record by record and gives rows (record, segment, bytes).  Where all segments of a record lie
in one file, the digest is carried from chunk to chunk and only the result is kept.  Segments of records that two files share meet
by record and in order, again one chunk at a time.  No step holds a whole payload outside the row that brought it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._rows import map_rows, shared_dir, table

#: Bytes of a chunk, chunks of a file, and the least payload that is stored once.
CHUNK, PER_FILE, LEAST = 65_536, 256, 1000
#: Repeated digests that are sent to all executors, at most: some 20 MB.
MOST = 200_000


def roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST, most: int = MOST) -> DataFrame:
    """(id, payload binary, digest, size, refers_to): refers_to is null for responses.

    Of equal payloads of ``least`` bytes or more the row with the largest id is the response; null ids refer to it, and rows that share
    the largest id are all responses.  A null payload is empty.  Only digests are grouped: the ``most`` commonest repeated ones, which
    are a bounded number, go to all executors, so no payload is shuffled for them; beyond that the payloads of rarer ones are.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("size"))
    groups = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null")
    groups = table(groups, "warc-repeats")
    heavy = groups if (few := groups.count() <= most) else table(groups.orderBy(F.desc("n"), "digest").limit(most), "warc-heavy")
    rows = rows.join(F.broadcast(heavy.select("digest", "top")), "digest", "left")
    if not few:
        light = groups.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select("digest", F.col("top").alias("other"))
        found = rows.filter("top is not null").withColumn("other", F.lit(None).cast("long"))
        rows = found.unionByName(rows.filter("top is null").join(light, "digest", "left")).withColumn("top", F.coalesce("top", "other"))
    refers = F.when(F.col("id").isNull() | (F.col("id") < F.col("top")), F.col("top"))
    return rows.select("id", "payload", "digest", "size", refers.alias("refers_to"))


def chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row (record, segment, last, id, digest, size, refers_to, data) per chunk of each record of ``roles``.

    The record's name is drawn anew for each row, so repeated and null ids stay apart.  A revisit has one empty chunk.  Chunk numbers
    are dealt out first and each row then cuts its own bytes, so beside the payload there is one chunk at a time.
    """
    size = F.when(F.col("refers_to").isNull(), F.col("size")).otherwise(0)
    named = records.select(F.expr("uuid()").alias("record"), "id", "digest", "size", "refers_to", "payload", F.greatest(F.ceil(size / chunk), F.lit(1)).cast("int").alias("n"))
    rows = named.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("segment"))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("segment") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return rows.select("record", "segment", (F.col("segment") == F.col("n") - 1).alias("last"), "id", "digest", "size", "refers_to", data.alias("data"))


def lines(rows: DataFrame) -> DataFrame:
    """One column ``value``: each chunk as a WARC record up to its last line end."""
    end = "\r\n"
    kind = F.when(F.col("segment") > 0, "continuation").when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    head = F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "), kind, F.lit(f"{end}WARC-Record-ID: <urn:uuid:"), F.col("record"), F.lit(">"),
        F.when(F.col("segment") > 0, F.concat(F.lit(f"{end}WARC-Segment-Origin-ID: <urn:uuid:"), F.col("record"), F.lit(">"))).otherwise(""),
        F.lit(f"{end}WARC-Segment-Number: "), (F.col("segment") + 1).cast("string"),
        F.when(F.col("last"), F.concat(F.lit(f"{end}WARC-Segment-Total-Length: "), F.col("size").cast("string"))).otherwise(""),
        F.when(F.col("id").isNotNull(), F.concat(F.lit(f"{end}WARC-Target-URI: urn:page:"), F.col("id").cast("string"))).otherwise(""),
        F.lit(f"{end}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit(f"{end}WARC-Profile: identical-payload-digest{end}WARC-Refers-To-Target-URI: urn:page:"), F.col("refers_to").cast("string"))).otherwise(""),
        F.lit(f"{end}WARC-Block-Digest: sha1:"), F.sha1("data"),
        F.lit(f"{end}Content-Length: "), F.length("data").cast("string"), F.lit(end + end),
    )
    return rows.select(F.concat(head.cast("binary"), F.col("data"), F.lit(end.encode())).cast("string").alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html") -> None:
    """Writes gzip archives; a file has PER_FILE chunks at most."""
    rows = chunks(roles(pages, id_col, payload_col))
    lines(rows).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


class Pieces:
    """Decompressed bytes of an archive, a bounded piece at a time.  A compressed member that ends early raises a ValueError."""

    def __init__(self, data: bytes, step: int = 1 << 16) -> None:
        self.data, self.at, self.step = memoryview(data), 0, step
        self.gunzip = zlib.decompressobj(31) if bytes(self.data[:2]) == b"\x1f\x8b" else None
        self.buffer = bytearray()

    def more(self) -> bool:
        if self.at >= len(self.data) and not (self.gunzip and self.gunzip.unconsumed_tail):
            if self.gunzip and not self.gunzip.eof:
                raise ValueError("the archive ends within compressed data")
            return False
        if self.gunzip is None:
            self.buffer += self.data[self.at : self.at + self.step]
            self.at += self.step
            return True
        source = self.gunzip.unconsumed_tail or bytes(self.data[self.at : self.at + self.step])
        if not self.gunzip.unconsumed_tail:
            self.at += len(source)
        self.buffer += self.gunzip.decompress(source, self.step * 4)
        if self.gunzip.eof and (self.gunzip.unused_data or self.at < len(self.data)):  # the next member
            self.at -= len(self.gunzip.unused_data)
            self.gunzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the mark, which is passed over; None at the end, where only line ends may be left."""
        seen = 0
        while (i := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more():
                if self.buffer.strip(b"\r\n"):
                    raise ValueError("the archive ends within the head of a record")
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        if len(self.buffer) < n:
            raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of an archive.  A block that differs from its digest raises a ValueError."""
    pieces = Pieces(data)
    while (head := pieces.until(b"\r\n\r\n")) is not None:
        if not head.strip(b"\r\n"):
            continue  # line ends between records
        _, *rest = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
        block = pieces.take(int(fields.get("content-length", 0)))
        agree(fields.get("warc-block-digest"), hashlib.sha1(block).hexdigest(), fields)
        yield fields, block


def agree(stated: str | None, found: str, fields: dict[str, str]) -> None:
    """Raises a ValueError if a digest in hexadecimal SHA-1 is stated and another one was found."""
    if stated and len(x := stated.removeprefix("sha1:")) == 40 and x.lower() != found:
        raise ValueError(f"record {fields.get('warc-record-id')} states the digest {x} and has {found}")


def _page(uri: str | None) -> int | None:
    return int(uri.rpartition(":")[2]) if uri else None


_COLUMNS = "record string, segment int, page_id long, record_type string, refers_to long, stated string, payload_bytes long, payload_digest string, data binary"


def _head(fields: dict[str, str]) -> tuple:
    """The first six of _COLUMNS."""
    origin = fields.get("warc-segment-origin-id") or fields["warc-record-id"]
    number, stated = int(fields.get("warc-segment-number", 1)), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return origin, number, _page(fields.get("warc-target-uri")), fields["warc-type"], _page(fields.get("warc-refers-to-target-uri")), stated


class Running:
    """The digest of a record whose segments come one by one."""

    def __init__(self, row: tuple) -> None:
        self.row, self.sha, self.size = row, hashlib.sha1(), 0

    def add(self, block: bytes) -> None:
        self.sha.update(block)
        self.size += len(block)

    def done(self, total: int | None) -> tuple:
        """The record's row; sizes and digests that differ from what the record states raise a ValueError."""
        if total is None or self.size != total:
            raise ValueError(f"record {self.row[0]} has {self.size} of {total} bytes")
        agree(self.row[5], self.sha.hexdigest(), {"warc-record-id": self.row[0]})
        return *self.row, self.size, self.sha.hexdigest(), None


def _open(content: bytes, origin: str) -> Iterator[tuple]:
    """The segments, with their bytes, of the record that goes on in another file."""
    for fields, block in records(content):
        row = _head(fields)
        if row[0] == origin:
            yield *row, None, None, block


def _whole(content: bytes) -> Iterator[tuple]:
    """Rows of _COLUMNS of a file.  The digest is carried from chunk to chunk, and no chunk is kept: if the file ends before a record
    does, that record's segments are read once more and sent on."""
    state: Running | None = None
    for fields, block in records(content):
        row, total = _head(fields), fields.get("warc-segment-total-length")
        if row[3] == "revisit":
            yield *row, int(total), row[5], None
            continue
        if row[1] == 1:
            state = Running(row)
        if state is None or state.row[0] != row[0]:
            yield *row, int(total) if total else None, None, block  # begun in another file
            continue
        state.add(block)
        if total is not None:
            yield state.done(int(total))
            state = None
    if state is not None:
        yield from _open(content, state.row[0])


def _scan(batches: Iterator[list[list]]) -> Iterator[list]:
    """Whole records with their digest and no data; segments of records that go beyond the file with their data."""
    for (contents,) in batches:
        for content in contents:
            rows = _whole(content)
            while some := list(islice(rows, 64)):
                yield [list(c) for c in zip(*some, strict=True)]


def _gather(batches: Iterator[list[list]]) -> Iterator[list]:
    """Whole records as they are; segments, sorted by record and number, digested one by one."""
    state: Running | None = None
    total = None

    def result(row: tuple) -> tuple:
        return row[2], row[6], row[7], row[3], row[4]

    for columns in batches:
        out: list[tuple] = []
        for row in zip(*columns, strict=True):
            if row[8] is None:
                out.append(result(row))
                continue
            if state is None or state.row[0] != row[0]:
                if state:
                    out.append(result(state.done(total)))
                state = Running(row[:6])
            state.add(row[8])
            total = row[6]
        if out:
            yield [list(c) for c in zip(*out, strict=True)]
    if state:
        yield [[x] for x in result(state.done(total))]


def read(spark, path: str) -> DataFrame:
    """One row (page_id, payload_bytes, payload_digest, record_type, refers_to) per record of the archives under ``path``.

    Sizes and digests of responses are taken from the bytes read and compared with what the records state; a revisit has those that
    its header states.  An archive that is cut off, or differs from its digests, raises an error.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = map_rows(files, ["content"], _COLUMNS, _scan)
    near = rows.repartition(F.coalesce("record", F.lit(""))).sortWithinPartitions("record", "segment")
    return map_rows(near, [f.split(" ")[0] for f in _COLUMNS.split(", ")], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", _gather)


def archive(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Writes the pages to archives in the shared folder and reads those: one row per row of pages.

    Null payloads are empty ones; null and repeated ids and repeated rows keep a record each (``roles`` says which are revisits).  A
    payload of any length goes through in chunks.  An empty table gives an empty result.  Other columns of pages are ignored.
    """
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path, id_col, payload_col)
    return read(pages.sparkSession, path).withColumnRenamed("page_id", id_col)
