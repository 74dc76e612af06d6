"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members, a record a member, with the payload or, where a
record with the same payload of at least REVISIT bytes and a larger page_id exists, a revisit of it.
Index: lines (reversed-host URL key, page_id, file, offset, length) sorted over all archives are cut into
compressed blocks of LINES lines; each part of the index has a sparse directory with the first key of each
block.  Reading: a list of the parts' first keys is searched for the part, the part's directory for the
block, the block (one range read) for the line, and the record is one more range read.

Files go to the folder that all machines share, under names that only their partition decides; they are
written under a name of their own and then moved, so a task that runs again leaves the same files.
Payloads that a revisit may touch (at least REVISIT bytes) reach the writer through one shuffle on their
digests, the others are written where they are read; nothing of the archives passes the driver but the list
of parts (as many rows as the index has partitions).  Records are read back in about READ bytes a task.

Defined results: a null html is an empty payload; a null url has the key ``-``; equal rows are each written
and each read back; of equal payloads at the same largest page_id each is a response; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.llm.work import Work

REVISIT, LINES, LEVEL, READ = 1000, 1000, 4, 4 << 20
MOST_TASKS = 20_000
"""Tasks that read records back, READ bytes each; beyond that many, each reads more."""
_LEAST = -(1 << 63)
_DATE = "2024-01-01T00:00:00Z"
_CDX = "url_key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """``http://a.example.org:80/x?y`` -> ``org,example,a:80)/x?y`` (no white space; lower-case host)."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), f":{parts.port}" if parts.port else ""
    except ValueError:
        return quote(url, safe="/?&=%:;,@+~#()!$'*") or "-"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + port + ")" + quote(tail, safe="/?&=%:;,@+~#()!$'*")


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = hashlib.sha1(payload).hexdigest()
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        body += payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {quote(url or '', safe='/?&=%:;,@+~#()!$*')}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """Headers and payload of one WARC record; raises ValueError where lengths or digests don't hold."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    if not lines[0].startswith("WARC/") or len(rest) != int(headers["Content-Length"]) + 4:
        raise ValueError(f"broken record {headers.get('WARC-Record-ID')}")
    payload = rest[:-4].partition(b"\r\n\r\n")[2]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(headers["WARC-Payload-Length"])):
        raise ValueError(f"wrong payload {headers['WARC-Record-ID']}")
    number = lambda name: int(v) if (v := headers.get(name, "")[len("<urn:page:") : -1]) else None
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": int(headers["WARC-Payload-Length"]), "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload}


class _Out:
    """A file of gzip members, moved to its name when it is whole."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.at = self.fs.open_output_stream(self.own), 0

    def member(self, data: bytes) -> tuple[int, int]:
        packed = gzip.compress(data, LEVEL, mtime=0)
        self.out.write(packed)
        self.at += len(packed)
        return self.at - len(packed), len(packed)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.path)


def _range(uri: str, offset: int, length: int) -> bytes:
    """One range read of a gzip member; files stay open for the next."""
    file = _opened(uri)
    return zlib.decompress(file.read_at(length, offset), 31)


@lru_cache(maxsize=64)
def _opened(uri: str):
    own, path = fs.FileSystem.from_uri(uri)
    return own.open_input_file(path)


def write(pages: DataFrame, work: Work) -> DataFrame:
    """Writes the archives; returns a row of index data for each record."""
    body = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("body"))
    digests = rows.select("page_id", F.sha1("body").alias("digest"), F.octet_length("body").alias("n"))
    shared = digests.where(f"n >= {REVISIT}").groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "target")
    shared = work.cut(shared, "shared")
    large, small = rows.where(F.octet_length("body") >= REVISIT), rows.where(F.octet_length("body") < REVISIT)
    large = large.withColumn("digest", F.sha1("body")).join(shared.hint("shuffle_merge"), "digest", "left").select("page_id", "url", "body", F.expr("if(page_id = target, null, target)").alias("refers_to"))
    joined = large.unionByName(small.withColumn("refers_to", F.lit(None).cast("long")))
    root = f"{work.root}/archives"

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        file = None
        for batch in batches:
            cdx = []
            for page, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "body", "refers_to")), strict=True):
                file = file or _Out(uri)
                page, url, refers = page.as_py(), url.as_py(), refers.as_py()
                offset, length = file.member(_record(page, url, payload.as_py(), refers))
                cdx.append((url_key(url), page, uri, offset, length))
            columns = list(zip(*cdx, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], ["url_key", "page_id", "file", "offset", "length"])
        if file:
            file.close()

    return work.cut(joined.mapInArrow(out, _CDX), "captures")


def index(captures: DataFrame, work: Work) -> DataFrame:
    """Sorts the captures into blocks; returns the parts (first key and page_id, block file, directory file)."""
    root = f"{work.root}/index"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri, file, held, directory = f"{root}/part-{part:06d}.gz", None, [], []

        def put(rows: list) -> None:
            nonlocal file
            file = file or _Out(uri)
            text = "".join(f"{key} {json.dumps([_LEAST if page is None else page, name, offset, length])}\n" for key, page, name, offset, length in rows)
            offset, length = file.member(text.encode())
            directory.append([rows[0][0], _LEAST if rows[0][1] is None else rows[0][1], offset, length])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == LINES:
                    put(held)
                    held = []
        if held:
            put(held)
        if file:
            file.close()
            sparse = _Out(f"{uri}.dir")
            sparse.member("".join(json.dumps(d) + "\n" for d in directory).encode())
            sparse.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([uri]), pa.array([sparse.at], pa.int64())], ["first_key", "first_page", "file", "directory_length"])

    dealt = captures.select("url_key", "page_id", "file", "offset", "length").repartitionByRange("url_key", "page_id", "file", "offset").sortWithinPartitions("url_key", "page_id", "file", "offset")
    return work.cut(dealt.mapInArrow(blocks, "first_key string, first_page long, file string, directory_length long"), "parts")


@lru_cache(maxsize=64)
def _directory(uri: str, length: int) -> tuple[list, list]:
    own = [json.loads(line) for line in _range(f"{uri}.dir", 0, length).decode().splitlines()]
    return [(d[0].encode(), d[1]) for d in own], [(d[2], d[3]) for d in own]


@lru_cache(maxsize=4)
def _block(uri: str, offset: int, length: int) -> tuple[list, list]:
    lines = [line.split(" ", 1) for line in _range(uri, offset, length).decode().splitlines()]
    rows = [json.loads(tail) for _, tail in lines]
    return [(key.encode(), row[0]) for (key, _), row in zip(lines, rows, strict=True)], [row[1:] for row in rows]


def find(key: str, page_id: int | None, parts: list[tuple]) -> Iterator[tuple[str, int, int]]:
    """(file, offset, length) of every capture of a key and page_id: binary searches, then range reads."""
    wanted = (key.encode(), _LEAST if page_id is None else page_id)
    firsts = [p[0] for p in parts]
    part = max(0, bisect.bisect_left(firsts, wanted) - 1)
    while part < len(parts) and firsts[part] <= wanted:
        heads, places = _directory(parts[part][1], parts[part][2])
        block = max(0, bisect.bisect_left(heads, wanted) - 1)
        while block < len(heads) and heads[block] <= wanted:
            keys, rows = _block(parts[part][1], *places[block])
            for i in range(bisect.bisect_left(keys, wanted), bisect.bisect_right(keys, wanted)):
                yield tuple(rows[i])
            block += 1
        part += 1


def lookup(wanted: DataFrame, parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """The records of wanted(page_id, url), read from the archives through the index by so many tasks; absent ones have no row."""
    listed = sorted(((r.first_key.encode(), r.first_page), r.file, r.directory_length) for r in parts.collect())  # a row for each partition of the index

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            out = []
            for page, key in zip(batch.column("page_id").to_pylist(), batch.column("url_key").to_pylist(), strict=True):
                out += [parse(_range(*place)) for place in find(key, page, listed)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types, strict=True)], list(names))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())], ["page_id", "url_key"])

    keys = wanted.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(keyed, "page_id long, url_key string").distinct()
    near = keys.repartitionByRange(*([tasks] if tasks else []), "url_key", "page_id").sortWithinPartitions("url_key", "page_id")  # a block is read by few tasks, and once in each
    return near.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page, indexes the archives and reads every record back through the index."""
    work = Work(pages.sparkSession, "warc")
    captures = write(pages, work)
    stored = captures.agg(F.sum("length")).first()[0] or 0
    return lookup(pages, index(captures, work), max(1, min(MOST_TASKS, -(-stored // READ))))
