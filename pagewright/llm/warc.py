"""WARC archives with a two-level capture index.

Writing: a gzip member per record; an archive begins with a warcinfo record. Of records with equal payloads of at least ``least`` bytes the one with the largest key
is a response, the others are revisits that refer to it. Every task writes archives of its own attempt, so a lost task
leaves at most a file that nothing names. Index: a line per record, sorted by reversed-host URL key over a number of files,
in compressed blocks; a file ends with its sparse directory, a line per block. The list of files with their first and last
keys has a row a partition of the sort. Reading, be it some URLs or all: binary search of the files and of a file's
directory for each key; the blocks found are dealt out, so a key with many records is spread; then a range read of a block,
binary search of its lines, and a range read of each record. A folder that was written in another session is opened by name, and
one with archives of other tools gets an index (``indexed``): fields are the standard's, and our own are optional when
reading.

Keys (``key``) may be of any type that text can be cast back to, and are escaped where they are written; "largest" is by that type. Null payloads are empty; a null
URL has the empty URL key; a null key is never the largest (if all are null, all records are responses). Rows that share the
largest key are all responses; repeated rows are records each. An empty table gives no archives and an empty index. Other
columns of pages don't matter.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST = 1000
BLOCK_LINES = 3000
ARCHIVE_BYTES = 1 << 30
#: Groups of equal payloads that are broadcast at most; more are joined by a shuffle, salted.
BROADCAST_GROUPS = 200_000
SALTS = 16
_DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://www.a.example.com:80/x?y -> com,example,a)/x?y"""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")
    if not host and not parts.path:
        return ""
    tail = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(host.split("."))) + tail + ")" + quote((parts.path or "/") + (f"?{parts.query}" if parts.query else ""), safe="/?:@!$&'()*+,;=%-._~")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _escaped(text: str) -> str:
    """Text without characters that would end a field or a column."""
    return re.sub(r"[\x00-\x20\x7f%<>]", lambda m: f"%{ord(m[0]):02X}", text)


def _member(head: list[str], body: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n") + packer.flush()


def _id(name: str, at: int) -> str:
    """The name of a record: of its place, so that no two have one."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{at}').urn}>"


def info(name: str) -> bytes:
    """The record that an archive begins with."""
    body = b"format: WARC File Format 1.1\r\nsoftware: pagewright\r\n"
    return _member(["WARC-Type: warcinfo", f"WARC-Record-ID: {_id(name, 0)}", f"WARC-Date: {_DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], body)


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to, name: str = "", at: int = 0) -> bytes:
    """A record as a gzip member, at a place in an archive. A revisit (refers_to isn't None) has no payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    body = b"" if refers_to is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(name, at)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {size}", *([] if page_id is None else [f"Page-Key: {_escaped(str(page_id))}"]),
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {_DATE}", f"Refers-To-Page-Key: {_escaped(str(refers_to))}"]),
        "Content-Type: application/http; msgtype=response",
    ]
    return _member(head, body)


@dataclass
class Record:
    """kind: the standard's type; page_id and refers_to: our own keys, if any; size and digest: of the payload, hexadecimal where it is
    a SHA-1, None where a record doesn't say."""

    kind: str
    page_id: str | None
    url: str
    digest: str | None
    size: int | None
    refers_to: str | None
    payload: bytes | None


def _hex(digest: str | None) -> str | None:
    """A digest as hexadecimal SHA-1 where it is one: other tools write it in base 32."""
    name, _, value = (digest or "").partition(":")
    if name.lower() != "sha1":
        return digest
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def parse(raw: bytes) -> Record:
    """A record from its gzip member; the payload's length and SHA-1 are checked where they are told."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    version, *lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    fields = {name.strip(" \t").lower(): value.strip(" \t") for name, _, value in (line.partition(":") for line in lines)}
    if not version.startswith("WARC/1.") or len(rest) != int(fields.get("content-length", -1)) + 4:
        raise ValueError("not a whole WARC record")
    kind, payload, digest = fields.get("warc-type", ""), None, _hex(fields.get("warc-payload-digest"))
    size = int(fields["payload-length"]) if "payload-length" in fields else None
    if kind in ("response", "resource"):
        http = fields.get("content-type", "").startswith("application/http")
        payload = rest[:-4].partition(b"\r\n\r\n")[2] if http else rest[:-4]
        if size not in (None, len(payload)) or digest and len(digest) == 40 and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("a payload isn't what was written")
        size, digest = len(payload), digest or hashlib.sha1(payload).hexdigest()
    key = lambda name: unquote(fields[name]) if name in fields else None
    return Record(kind, key("page-key"), fields.get("warc-target-uri", "").strip("<>"), digest, size, key("refers-to-page-key"), payload)


def _own_name(n: int) -> str:
    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}-{n}"


_LINE = pa.schema([("url_key", pa.string()), ("key", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        out, name, at, n = None, "", 0, 0
        try:
            for batch in common.slices(batches, 2, 16 << 20):
                rows = []
                columns = [batch.column(i).to_pylist() for i in (0, 1)] + [common.byte_values(batch.column(2))] + [batch.column(i).to_pylist() for i in (3, 4, 5)]
                for page_id, url, payload, size, digest, refers_to in zip(*columns, strict=True):
                    if out is None or at > ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name, at, n = f"archive-{_own_name(n)}.warc.gz", 0, n + 1
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                        begin = info(name)
                        out.write(begin)
                        at = len(begin)
                    member = record(page_id, url, payload, size, digest, refers_to, name, at)
                    out.write(member)
                    rows.append((url_key(url), "" if page_id is None else _escaped(page_id), name, at, len(member)))
                    at += len(member)
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _LINE, strict=True)], _LINE.names)
        finally:
            if out:
                out.close()

    return run


def _blocks(folder: str, lines: int):
    """The index file of a partition: blocks of sorted lines, then the directory (first key, place and size of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        name, at, out, held, directory, n = f"index-{_own_name(0)}.gz", 0, None, [], [], 0
        last = ""

        def put(rows: list[tuple]) -> int:
            nonlocal at, out
            out = out or files.open_output_stream(f"{root}/{name}", compression=None)
            block = gzip.compress("".join("\t".join(map(str, x)) + "\n" for x in rows).encode(), 1, mtime=0)
            out.write(block)
            at += len(block)
            return len(block)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                held.append(row)
                last = row[0]
                n += 1
                if len(held) == lines:
                    directory.append((held[0][0], at, put(held)))
                    held = []
        if held:
            directory.append((held[0][0], at, put(held)))
        if out:
            end, size = at, put(directory)
            out.close()
            columns = [[directory[0][0]], [last], [name], [end], [size], [len(directory)], [n]]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(x, k) for x, k in zip(columns if out else [[]] * 7, kinds, strict=True)], ["first_key", "last_key", "file", "at", "size", "blocks", "lines"])

    return run


@dataclass
class Capture:
    """Archives and index files in a folder. files: (first key, last key, name, place and size of the directory, blocks, lines) of each
    index file, as many as the sort had partitions; key_type: of our keys."""

    folder: str
    files: list[tuple[str, str, str, int, int, int, int]]
    key_type: str


#: The file of a folder that says what its index files are.
CAPTURE = "capture.json"


def _indexed(lines: DataFrame, folder: str, block_lines: int, key_type: str) -> Capture:
    """Sort the index lines into files, and write down which they are."""
    spark = lines.sparkSession
    ordered = lines.repartitionByRange(common.shards(spark), "url_key", "key").sortWithinPartitions("url_key", "key")
    index = ordered.transform(common.in_arrow, _blocks(folder, block_lines), "first_key string, last_key string, file string, at long, size long, blocks long, lines long")
    found = sorted(tuple(r) for r in common.stored(index, "index").select("first_key", "last_key", "file", "at", "size", "blocks", "lines").collect())
    files, root = _filesystem(folder)
    with files.open_output_stream(f"{root}/{CAPTURE}.part", compression=None) as out:
        out.write(json.dumps({"key_type": key_type, "files": found}).encode())
    files.move(f"{root}/{CAPTURE}.part", f"{root}/{CAPTURE}")
    return Capture(folder, found, key_type)


def opened(folder: str) -> Capture:
    """The capture that an earlier session has written to a folder."""
    files, root = _filesystem(folder)
    with files.open_input_stream(f"{root}/{CAPTURE}") as file:
        said = json.loads(file.read())
    return Capture(folder, [tuple(x) for x in said["files"]], said["key_type"])


def _members(folder: str):
    """(url_key, key, file, at, size) of the records of archives, read member by member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as file:
                    at, ahead = 0, file.read(1 << 20)
                    while ahead:
                        unpack, raw = zlib.decompressobj(31), []
                        while ahead and not unpack.eof:
                            unpack.decompress(ahead)
                            raw.append(ahead[: len(ahead) - len(unpack.unused_data)])
                            ahead = unpack.unused_data if unpack.eof else file.read(1 << 20)
                        ahead = ahead or file.read(1 << 20)
                        member = b"".join(raw)
                        if not unpack.eof:
                            raise ValueError(f"{name} ends within a record")
                        if (got := parse(member)).kind in ("response", "resource", "revisit"):
                            rows.append((url_key(got.url), _escaped(got.page_id or ""), name, at, len(member)))
                        at += len(member)
                        if len(rows) >= 2000:
                            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _LINE, strict=True)], _LINE.names)
                            rows = []
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _LINE, strict=True)], _LINE.names)

    return run


def indexed(spark: SparkSession, folder: str, names: list[str] | None = None, key_type: str = "string", block_lines: int = BLOCK_LINES) -> Capture:
    """Index the archives (a gzip member a record) in a folder, whoever has written them: responses, resources and revisits. names: of the
    archives; else all that end in .warc.gz. A task reads an archive at a time and holds a record."""
    if names is None:
        from pyarrow import fs

        files, root = _filesystem(folder)
        names = sorted(x.base_name for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".warc.gz"))
    listed = spark.createDataFrame([(x,) for x in names], "file string").repartition(max(1, min(len(names), common.shards(spark))), "file")
    lines = common.stored(listed.transform(common.in_arrow, _members(folder), "url_key string, key string, file string, at long, size long"), "lines")
    return _indexed(lines, folder, block_lines, key_type)


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, block_lines: int = BLOCK_LINES, broadcast_groups: int = BROADCAST_GROUPS) -> Capture:
    """Write pages as archives with their index below a folder that all machines see."""
    spark = pages.sparkSession
    folder = folder or common.scratch_path(spark, "warc")
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    # equal payloads by SHA-1 and length; partial sums leave a row per task of a large group
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("size"), F.sha1(body).alias("digest"))
    groups = rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("key").alias("response"), F.count("*").alias("n")).filter("n > 1 AND response IS NOT NULL").drop("n")
    groups = common.stored(groups, "payloads", light=True)
    if groups.count() <= broadcast_groups:
        joined = rows.join(F.broadcast(groups), ["digest", "size"], "left")
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "size", "salt"], "left")
    refers_to = F.when(F.col("response").isNotNull() & ~F.col("key").eqNullSafe(F.col("response")), F.col("response"))
    ready = joined.select("key", "url", "payload", "size", "digest", refers_to.alias("refers_to"))
    ready = ready.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    texts = ready.withColumns({c: F.col(c).cast("string") for c in ("key", "refers_to")})
    lines = common.stored(texts.transform(common.in_arrow, _written(folder), "url_key string, key string, file string, at long, size long"), "lines")
    return _indexed(lines, folder, block_lines, common.ddl(pages.schema[key].dataType))


class _Reader:
    """Range reads from a folder, with the files last used kept open."""

    def __init__(self, folder: str):
        self.files, self.root = _filesystem(folder)
        self.open: dict[str, pa.NativeFile] = {}
        self.last: tuple[tuple, list[list[str]], list[str]] = ((), [], [])

    def read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.files.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(size, at)

    def block(self, name: str, at: int, size: int) -> tuple[list[list[str]], list[str]]:
        """The lines of a block or directory and their keys; the last one is kept."""
        if self.last[0] != (name, at):
            found = [x.split("\t") for x in gzip.decompress(self.read(name, at, size)).decode().split("\n")[:-1]]
            self.last = (name, at), found, [x[0] for x in found]
        return self.last[1:]


_FIELDS = ("url_key", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")


def _row(key: str, got: Record, payload: bool) -> tuple:
    return key, got.page_id, got.url, got.size, got.digest, got.kind, got.refers_to, got.payload if payload else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], list(_FIELDS))


def _planned(folder: str, files: list[tuple]):
    """(url_key, file, at, size): the blocks that may hold a key, by binary search of the files, then of their directories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last_keys = _Reader(folder), [f[1] for f in files]
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                for i in range(bisect.bisect_left(last_keys, key), len(files)):
                    first, _, name, at, size, *_ = files[i]
                    if first > key:
                        break
                    directory, starts = reader.block(name, at, size)
                    # from the last block that begins before the key to the last that begins with it
                    for _, begin, length in directory[max(0, bisect.bisect_left(starts, key) - 1) : bisect.bisect_right(starts, key)]:
                        rows.append((key, name, int(begin), int(length)))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["url_key", "file", "at", "size"])

    return run


def _records(folder: str, payload: bool):
    """The records of keys in blocks, in order of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)

        def rows(found: list[list[str]]) -> Iterator[pa.RecordBatch]:
            found.sort(key=lambda x: (x[2], int(x[3])))  # one way through each archive
            for i in range(0, len(found), 500):
                yield _batch([_row(x[0], parse(reader.read(x[2], int(x[3]), int(x[4]))), payload) for x in found[i : i + 500]])

        found: list[list[str]] = []
        for batch in batches:
            for key, name, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, keys = reader.block(name, at, size)
                found += lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
                if len(found) > 20_000:
                    yield from rows(found)
                    found = []
        yield from rows(found)

    return run


_SCHEMA = "url_key string, page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def _found(capture: Capture, keys: DataFrame, payload: bool) -> DataFrame:
    """The records of distinct URL keys, in any order."""
    spark = keys.sparkSession
    planned = keys.transform(common.in_arrow, _planned(capture.folder, capture.files), "url_key string, file string, at long, size long")
    blocks = planned.repartition(common.shards(spark), "file", "at").sortWithinPartitions("file", "at", "url_key")
    got = blocks.transform(common.in_arrow, _records(capture.folder, payload), _SCHEMA)
    return got.withColumns({c: F.col(c).cast(capture.key_type) for c in ("page_id", "refers_to")})


def _keys(folder: str):
    """The keys of index files, each once a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        for batch in batches:
            for name, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = None
                for _, begin, length in list(reader.block(name, at, size)[0]):
                    found = [k for k in dict.fromkeys(reader.block(name, int(begin), int(length))[1]) if k != last]
                    last = found[-1] if found else last
                    yield pa.record_batch([pa.array(found, pa.string())], ["url_key"])

    return run


def read(spark: SparkSession, capture: Capture, payload: bool = False) -> DataFrame:
    """Every record, by way of the index: its own URL keys are looked up."""
    n = common.shards(spark)
    files = spark.createDataFrame([f[2:5] for f in capture.files], "file string, at long, size long").repartition(max(1, min(n, len(capture.files))), "file")
    keys = files.transform(common.in_arrow, _keys(capture.folder), "url_key string").distinct()
    return _found(capture, common.stored(keys, "keys").repartitionByRange(n, "url_key").sortWithinPartitions("url_key"), payload)


def lookup(spark: SparkSession, capture: Capture, urls: list[str], payload: bool = True) -> DataFrame:
    """The records of some URLs."""
    return _found(capture, spark.createDataFrame([(x,) for x in sorted({url_key(u) for u in urls})], "url_key string"), payload)
