r"""WARC files with verified record boundaries (operator 10).

Files are cut into byte ranges that tasks read on their own.  Whatever looks like a
record's first line is a candidate, inside payloads too.  A task emits each
candidate of its range with its successor, the offset right behind the record that
its header describes, and follows successors within the range to where they leave
it.  Pointer jumping from each file's start over these exits, doubling the distance
each round, reaches the first true record of every range; what it doesn't reach was
no record.  The ranges are then read again from there, record by record.

A record is a first line ``WARC/1.0`` or ``WARC/1.1``, header lines, an empty line,
``Content-Length`` bytes and two line ends (CR LF each).  Files whose name ends in
``.gz`` hold one gzip member a record, as WARC is published; there a candidate is what
looks like a member, and its successor the offset behind it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .common import scratch, written

SPLIT_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
#: A header line has its colon within so many bytes, or it is none; values are of any length.
NAME_BYTES = 1 << 16
_MEMBER = re.compile(rb"\x1f\x8b\x08")
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$")
RECORD = "path string, offset long, next long, record_type string, record_id string, target_uri string, headers map<string,string>, payload binary"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one resource record for each page that has an id and a text, by Spark's text sink; other columns are left aside.

    Line ends within a URL are percent-encoded; a null URL gives no target header.
    """
    url = F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    html = F.col(html_col).cast("string")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.col(id_col).cast("string"), F.lit(">\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html,
    )
    rows = pages.where(F.col(id_col).isNotNull() & F.col(html_col).isNotNull()).select(head.alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").text(path)


def _open(path: str):
    from pyarrow import fs

    uri = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/(?!/)", "file:///", path))
    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)


def _is_header(head: bytes, whole: bool) -> bool:
    """Whether lines behind the first are header lines, as far as they are there."""
    lines = head.split(b"\r\n")[1:]
    last = lines.pop() if not whole and lines else b""
    return all(not x or x[:1] in b" \t" or b":" in x[:NAME_BYTES] for x in lines) and (len(last) <= NAME_BYTES or last[:1] in b" \t" or b":" in last[:NAME_BYTES])


def _header(f, at: int, size: int, buffer: bytes, base: int) -> tuple[bytes, int, int] | None:
    """(header, payload start, length) of the record at ``at``; none if there is no well-formed one."""
    local = at - base
    end = buffer.find(b"\r\n\r\n", local) if 0 <= local < len(buffer) else -1
    head = buffer[local : end + 2] if end >= 0 else b""
    want = 1 << 13
    while end < 0:
        head = f.read_at(min(want, size - at), at)
        end = head.find(b"\r\n\r\n")
        if end < 0 and (at + want >= size or not _MAGIC.match(head) or not _is_header(head, False)):
            return None
        head = head[: end + 2] if end >= 0 else head
        want *= 8
    if not _MAGIC.match(head) or not _is_header(head, True):
        return None
    found = _LENGTH.search(head)
    if not found:
        return None
    return head, at + len(head) + 2, int(found[1])


def _member(f, at: int, size: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``at`` if it holds a record; none otherwise."""
    if not _starts_record(f, at, size):
        return None
    unzip, parts, to = zlib.decompressobj(31), [], at
    try:
        while not unzip.eof and to < size:
            data = f.read_at(min(1 << 20, size - to), to)
            parts.append(unzip.decompress(data))
            to += len(data)
    except zlib.error:
        return None
    return (b"".join(parts), to - len(unzip.unused_data)) if unzip.eof else None


def _starts_record(f, at: int, size: int) -> bool:
    """Whether what is unzipped from ``at`` begins with a record's first line; a few bytes tell."""
    try:
        return bool(_MAGIC.match(zlib.decompressobj(31).decompress(f.read_at(min(4096, size - at), at), 64)))
    except zlib.error:
        return False


def _end(f, at: int, size: int) -> int | None:
    """The end of the gzip member at ``at``; its content isn't kept."""
    if not _starts_record(f, at, size):
        return None
    unzip, to = zlib.decompressobj(31), at
    try:
        while not unzip.eof and to < size:
            data = f.read_at(min(1 << 20, size - to), to)
            to += len(data)
            unzip.decompress(data)
    except zlib.error:
        return None
    return to - len(unzip.unused_data) if unzip.eof else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges to candidates: (path, start, offset, successor, exit)."""
    for batch in batches:
        for path, start, end, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "size"))):
            with _open(path) as f:
                buffer = f.read_at(min(end + 16, size) - start, start)
                offsets, successors = [], []
                zipped = path.endswith(".gz")
                for m in (_MEMBER if zipped else _MAGIC).finditer(buffer):
                    at = start + m.start()
                    if at >= end:
                        break
                    h = None if zipped else _header(f, at, size, buffer, start)
                    after = _end(f, at, size) if zipped else h[1] + h[2] + 4 if h else None
                    if after is not None and after <= size:
                        offsets.append(at)
                        successors.append(after)
            exits: dict[int, int] = {}
            for at, after in zip(reversed(offsets), reversed(successors)):
                exits[at] = exits.get(after, after)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(offsets), pa.string()), pa.array([start] * len(offsets), pa.int64()), pa.array(offsets, pa.int64()), pa.array(successors, pa.int64()), pa.array([exits[o] for o in offsets], pa.int64())], ["path", "start", "offset", "successor", "exit"])


def _plain(f, at: int, end: int, size: int) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(offset, header, payload, end) of the records of a chain that begin before ``end``."""
    base, buffer = at, f.read_at(min(end, size) - at, at)
    while at < end:
        h = _header(f, at, size, buffer, base)
        if h is None or h[1] + h[2] + 4 > size:
            return
        head, body, length = h
        payload = buffer[body - base : body - base + length]
        if len(payload) < length:
            payload = f.read_at(length, body)
        yield at, head, bytes(payload), body + length + 4
        at = body + length + 4


def _zipped(f, at: int, end: int, size: int) -> Iterator[tuple[int, bytes, bytes, int]]:
    """As ``_plain``, for members."""
    while at < end:
        found = _member(f, at, size)
        if found is None:
            return
        content, after = found
        cut = content.find(b"\r\n\r\n")
        length = _LENGTH.search(content[: cut + 2]) if cut >= 0 and _is_header(content[: cut + 2], True) else None
        if length is None or cut + 4 + int(length[1]) > len(content):
            return
        yield at, content[: cut + 2], content[cut + 4 : cut + 4 + int(length[1])], after
        at = after


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges with their first true record to records."""
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("next", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
    for batch in batches:
        for path, at, end, size in zip(*(batch.column(c).to_pylist() for c in ("path", "entry", "end", "size"))):
            rows, held = [], 0
            with _open(path) as f:
                for at, head, payload, after in (_zipped if path.endswith(".gz") else _plain)(f, at, end, size):
                    fields = [line.partition(b":") for line in head.decode("utf-8", "replace").encode().split(b"\r\n")[1:] if b":" in line]
                    headers = {k.strip().decode().lower(): v.strip().decode() for k, _, v in fields}
                    rows.append((path, at, after, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), list(headers.items()), payload))
                    held += len(payload)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below ``path``, hidden ones aside."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    walk = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    found = []
    while walk.hasNext():
        f = walk.next()
        if not f.getPath().getName().startswith(("_", ".")) and f.getLen() > 0:
            found.append((f.getPath().toString(), f.getLen()))
    return sorted(found)


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the WARC files below ``path``: ``path, offset, next, record_type, record_id, target_uri, headers, payload``.

    The chain of a file starts at its first byte and ends at the first place where no
    whole record follows: what lies behind damage, and a last record cut short, is
    left out, and a file that doesn't begin with a record has none.  Empty files and
    folders have no records.  Header names are in lower case; of a repeated one the
    last counts; headers that are missing are null.  Headers and payloads of any length
    and content, magic lines included, stay whole.  Of a ``.gz`` file the offsets are
    those of the members.
    """
    ship(spark)
    files = listed(spark, path)
    table = spark.createDataFrame(files, "path string, size long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    ranges = table.select("path", "size", starts.alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, F.col("size")))
    n = sum(-(-size // split_bytes) for _, size in files)
    ranges = ranges.repartition(max(1, min(n, 10_000)), "path", "start")
    candidates = written(ranges.mapInArrow(_candidates, "path string, start long, offset long, successor long, exit long"), "candidates")
    jumps = candidates.select("path", "offset", "exit")
    reached = jumps.where("offset = 0").select("path", "offset")
    rounds = math.ceil(math.log2(max([-(-size // split_bytes) for _, size in files], default=1) + 1))
    for k in range(rounds):
        there = jumps.join(reached, ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        reached = written(reached.unionByName(there).distinct(), "reached")
        if k + 1 < rounds:
            onward = jumps.select("path", F.col("offset").alias("exit"), F.col("exit").alias("further"))
            jumps = written(jumps.join(onward, ["path", "exit"], "left").select("path", "offset", F.coalesce("further", "exit").alias("exit")), "jumps")
    entries = reached.join(candidates.select("path", "offset", "start"), ["path", "offset"]).select("path", "start", F.col("offset").alias("entry"))
    return ranges.join(entries, ["path", "start"]).mapInArrow(_records, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as WARC files to the shared folder and read again: ``page_id, url, html``.

    Pages without id or text have no record.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path)
    r = read(spark, path).where("record_type = 'resource'")
    return r.select(F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)>$", 1).cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.col("payload").cast("string").alias("html"))


ORACLE = "SELECT page_id, url, html FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL"
