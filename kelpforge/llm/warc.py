"""WARC archives with revisit records, and a two-level index of captures over them.

An index part is a file of compressed blocks of lines (reversed-host key, page id, archive, offset, length), sorted by
key over all parts; its directory keeps each block's first key. A lookup searches the parts' first keys, then
one part's directory, reads that one block, and then the one record's range of the archive.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.llm.common import fresh_dir, lean, open_store, written

#: Payloads shorter than this are stored whole each time; lines of an index block; bytes of an archive after which the next begins.
LEAST_SHARED = 100
BLOCK_LINES = 1000
ARCHIVE_BYTES = 1 << 30
#: Bytes of records that a task of the query reads, about.
READ_BYTES = 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def reversed_host_key(url: str) -> str:
    """com,example,www)/path?query of http://www.example.com/path?query, in lower case but for path and query."""
    try:
        parts = urlsplit(url if "://" in url else f"http://{url}")
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return f")/{url}"
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def warc_record(url: str, page_id: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has no payload of its own; it names the page that it repeats."""
    body = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {page_id}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []),
        f"Content-Length: {len(body)}",
    ]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + deflate.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one record per page; returns _key, _id, _path, _offset, _length of each, as a table.

    Of the pages with equal payloads of LEAST_SHARED bytes or more, the one of the smallest id is a response and the others revisit
    it; rows that repeat that id are responses too. A null html is an empty payload, a null url an empty one; null ids are not
    allowed. An empty table gives no archives. Other columns of pages are ignored.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), payload.alias("_payload")).withColumn("_digest", F.sha2("_payload", 256))
    may_share = F.octet_length("_payload") >= LEAST_SHARED
    shared = rows.where(may_share).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest", "_first")
    shared = written(shared, "shared")  # a table, so that the join can split a payload that many pages have
    short = rows.where(~may_share).withColumn("_refers", F.lit(None).cast("long"))  # they all may be alike, and need no partner
    rows = rows.where(may_share).join(shared, "_digest", "left").withColumn("_refers", F.when(F.col("_first") != F.col("_id"), F.col("_first")))
    rows = rows.select("_id", "_url", "_payload", "_digest", "_refers").unionByName(short.select("_id", "_url", "_payload", "_digest", "_refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        offset = 0
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            found = []
            for page_id, url, data, digest, refers in zip(*(batch[c].to_pylist() for c in ("_id", "_url", "_payload", "_digest", "_refers")), strict=True):
                if out is not None and offset >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                if out is None:
                    store, inside = open_store(folder)
                    store.create_dir(inside, recursive=True)
                    name, offset = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    path, out = f"{folder}/{name}", store.open_output_stream(f"{inside}/{name}", compression=None)
                record = warc_record(url, page_id, data, digest, refers)
                out.write(record)
                found.append((reversed_host_key(url), page_id, path, offset, len(record)))
                offset += len(record)
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(("_key", "_id", "_path", "_offset", "_length"), zip(*found, strict=True), strict=True)))
        if out is not None:
            out.close()

    return written(rows.select("_id", "_url", "_payload", "_digest", "_refers").mapInArrow(lean(write), "_key string, _id long, _path string, _offset long, _length long"), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts captures by key into parts of compressed blocks; returns the parts: _part, _path, _first (its first key), _directory (where the directory starts), _size."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, directory, offset, first = None, [], [], 0, None

        def flush() -> None:
            nonlocal offset, lines
            data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode(), 6)
            directory.append((lines[0][0], offset, len(data)))
            out.write(data)
            offset, lines = offset + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store, inside = open_store(folder)
                    store.create_dir(inside, recursive=True)
                    part = TaskContext.get().partitionId()
                    name = f"index-{part:06d}-{uuid.uuid4().hex}"
                    out, first = store.open_output_stream(f"{inside}/{name}", compression=None), row[0]
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            at = offset
            data = zlib.compress(json.dumps(directory, ensure_ascii=False).encode(), 6)
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_pydict({"_part": [part], "_path": [f"{folder}/{name}"], "_first": [first], "_directory": [at], "_size": [at + len(data)]})

    order = [F.col("_key").asc(), F.col("_id").asc(), F.col("_path").asc(), F.col("_offset").asc()]
    return written(captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(write), "_part long, _path string, _first string, _directory long, _size long"), "index")


class Index:
    """Looks captures up. parts: (first key, path, start of the directory, size) of every index part, in order. Keeps one directory and one block."""

    def __init__(self, parts: list[tuple[str, str, int, int]]):
        self.parts, self.firsts, self.at, self.block = parts, [_code_points(p[0]) for p in parts], None, (None, [])

    def _directory(self, i: int) -> list:
        if self.at != i:
            _, path, start, size = self.parts[i]
            self.at, self.directory = i, json.loads(zlib.decompress(read_range(path, start, size - start)))
            self.starts = [_code_points(d[0]) for d in self.directory]
        return self.directory

    def find(self, key: str) -> Iterator[tuple[int, str, int, int]]:
        """(id, path, offset, length) of every capture of the key, which may reach over blocks and parts."""
        k = _code_points(key)
        i = max(0, bisect.bisect_left(self.firsts, k) - 1)
        while i < len(self.parts) and (self.firsts[i] <= k):
            directory = self._directory(i)
            j = max(0, bisect.bisect_left(self.starts, k) - 1)
            while j < len(directory) and self.starts[j] <= k:
                if self.block[0] != (i, j):
                    _, offset, length = directory[j]
                    lines = zlib.decompress(read_range(self.parts[i][1], offset, length)).decode().split("\n")
                    self.block = (i, j), [json.loads(x) for x in lines]
                    self.block_keys = [_code_points(x[0]) for x in self.block[1]]
                for x in self.block[1][bisect.bisect_left(self.block_keys, k) : bisect.bisect_right(self.block_keys, k)]:
                    yield x[1], x[2], x[3], x[4]
                j += 1
            i += 1


def _code_points(key: str) -> bytes:
    """UTF-8, in which order Spark sorts strings."""
    return key.encode()


_streams: dict = {}


def read_range(path: str, offset: int, length: int) -> bytes:
    """A few streams stay open per process."""
    if path not in _streams:
        if len(_streams) >= 64:
            _streams.pop(next(iter(_streams))).close()
        store, inside = open_store(path)
        _streams[path] = store.open_input_file(inside)
    s = _streams[path]
    s.seek(offset)
    return s.read(length)


def read_captures(wanted: DataFrame, parts: DataFrame, id_col: str = "page_id", tasks: int | None = None) -> DataFrame:
    """Looks every wanted (_key, _id) up in the index, once each, and reads its record from the archive. _key: of reversed_host_key.
    tasks: among how many ranges of keys the reading is dealt; keys are small, and what they lead to is not.

    Returns id, payload_bytes, payload_digest (computed from a response's payload; of a revisit as recorded), record_type, refers_to, payload (null for revisits).
    """
    listed = [tuple(r) for r in parts.orderBy("_part").select("_first", "_path", "_directory", "_size").collect()]  # a row per shuffle partition

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(listed)
        for batch in batches:
            rows, held = [], 0
            keys, at = batch["_key"].to_pylist(), 0
            ids = batch["_id"].to_pylist()
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                asked = set(ids[at:end])
                for page_id, path, offset, length in index.find(keys[at]):
                    if page_id in asked:
                        fields, payload = parse_record(read_range(path, offset, length))
                        whole = fields["WARC-Type"] == "response"
                        digest = hashlib.sha256(payload).hexdigest() if whole else fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if whole and digest != fields["WARC-Payload-Digest"].removeprefix("sha256:"):
                            raise ValueError(f"page {page_id}: the payload read back has another digest")
                        rows.append((page_id, len(payload) if whole else int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], None if whole else int(fields["X-Refers-To-Page"]), payload if whole else None))
                        held += length
                at = end
                if held > 1 << 23:
                    yield as_batch(rows)
                    rows, held = [], 0
            yield as_batch(rows)

    def as_batch(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    order = [F.col("_key").asc(), F.col("_id").asc()]
    tasks = tasks or int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = wanted.select("_key", "_id").distinct().repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(lean(read), f"{id_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    captures = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    parts = write_index(captures, folder)
    held = captures.agg(F.sum("_length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held // READ_BYTES)
    return read_captures(captures, parts, tasks=tasks).drop("payload")
