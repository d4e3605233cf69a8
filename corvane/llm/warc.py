"""WARC archives and a two-level capture index.

Each task writes its own archives: one gzip member a record, a new file at ROLL bytes. A record is a response, or
a revisit that refers to the response with the same payload. The index is sorted by key (the URL with its host
reversed, then the page): lines go into compressed blocks, and behind the blocks of an index file stands its block
directory, with the first key of each. Looking a key up takes a binary search for the index file, one for the block,
one in the block, and then range reads: of the block and of the record.

Files are reached through pyarrow's file systems by their URI, in the folder that all executors share. A file name
holds a fresh number for each attempt at a task; only the files of attempts that Spark committed are in the tables.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections import OrderedDict
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import new_path, written

ROLL, BLOCK_LINES, MIN_REVISIT = 64 << 20, 256, 1000
ENTRY = "key string, page_id bigint, file string, start bigint, size bigint"


def surt(url: str | None) -> str:
    """com,example,www)/path?query: the host's labels reversed, lower-cased, the port kept, the fragment too."""
    url = url or ""
    try:
        u = urlsplit(url)
        host, port = u.hostname, u.port
    except ValueError:
        return ")" + url
    if not host:
        return ")" + url
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + url.split("://", 1)[-1].partition("@")[2 if "@" in u.netloc else 0][len(host) + (len(str(port)) + 1 if port else 0) :]


def _uri(url: str | None) -> str:
    """As it stands in a header: characters that can't are percent-encoded."""
    return quote(url or "", safe=":/?#[]@!$&()*+,;=%~-._" + chr(39))


def record(kind: str, page_id, url, digest: str, size: int, payload: bytes, refers_to, refers_url=None) -> bytes:
    """One WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, payload (empty for a revisit)."""
    data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, record_type, refers_to, refers_url.

    A null html is empty. Of equal payloads of MIN_REVISIT bytes or more, the row with the largest page_id is the response; rows that
    repeat that id too. A null id is smaller than any other.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload).alias("digest"), F.sha2(payload, 256).alias("content"))
    # SHA-256 tells which payloads are equal; SHA-1, of which collisions can be made, is only written.
    same = rows.filter(F.col("payload_bytes") >= MIN_REVISIT).groupBy("content", "payload_bytes").agg(F.max(F.struct("page_id", "url")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("content", "payload_bytes", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url"))
    same = written(same, "warc-same")  # a plain table, so that the join below is one Spark can split or broadcast
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(same, ["content", "payload_bytes"], "left").select("page_id", "url", "payload", "payload_bytes", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (from roles()) and returns one index entry each, as a written table."""

    def work(batches):
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        out, uri, at = None, "", 0
        try:
            for batch in batches:
                entries = []
                for lo in range(0, batch.num_rows, 64):
                    for r in batch.slice(lo, 64).to_pylist():
                        if out is None or at >= ROLL:
                            if out is not None:
                                out.close()
                            name = f"{uuid.uuid4().hex}.warc.gz"
                            out, uri, at = fs.open_output_stream(f"{root}/{name}", compression=None), name, 0
                        data = record(r["record_type"], r["page_id"], r["url"], r["digest"], r["payload_bytes"], r["payload"], r["refers_to"], r["refers_url"])
                        out.write(data)
                        entries.append((surt(r["url"]), r["page_id"], uri, at, len(data)))
                        at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*entries, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "start", "size"])
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(work, ENTRY), "warc-entries")


def _sort_key(key: str, page_id) -> tuple[str, int]:
    return key, -(1 << 63) if page_id is None else page_id


def write_index(entries: DataFrame, folder: str) -> list[tuple[str, int, str]]:
    """Sorts the entries by range, writes one index file a partition, and returns (first key, first page, file) of
    each: as many as there are partitions, whatever the input."""

    def work(batches):
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        out, directory, lines, at = None, [], [], 0
        name = f"{uuid.uuid4().hex}.cdx"

        def flush():
            nonlocal at, lines
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            directory.append([lines[0][0], lines[0][1], at, len(data)])
            out.write(data)
            at += len(data)
            lines = []

        for batch in batches:
            if batch.num_rows and out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(r)
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data + struct.pack("<QQ", at, len(data)))
            out.close()
            first = directory[0]
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([name])], names=["key", "page_id", "file"])

    ordered = entries.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    parts = written(ordered.mapInArrow(work, "key string, page_id bigint, file string"), "warc-parts")
    return sorted(((r.key, r.page_id, r.file) for r in parts.collect()), key=lambda x: (_bytes(x[0]), _sort_key(*x[:2])[1]))


def _bytes(key: str) -> bytes:
    return key.encode()  # Spark sorts strings by their bytes


class CaptureIndex:
    """Reads an index: parts is what write_index returned. Directories and blocks met lately are kept."""

    def __init__(self, folder: str, parts: list[tuple[str, int, str]], keep: int = 8):
        self.fs, self.root = _fs(folder)
        self.parts, self.keep = parts, keep
        self.firsts = [(_bytes(k), _sort_key(k, p)[1]) for k, p, _ in parts]
        self.directories: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()
        self.files: OrderedDict = OrderedDict()

    def _file(self, name: str):
        if name not in self.files:
            if len(self.files) >= self.keep:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.fs.open_input_file(f"{self.root}/{name}")
        self.files.move_to_end(name)
        return self.files[name]

    def _kept(self, store: OrderedDict, key, make):
        if key not in store:
            if len(store) >= self.keep:
                store.popitem(last=False)
            store[key] = make()
        store.move_to_end(key)
        return store[key]

    def _directory(self, part: int):
        def make():
            f = self._file(self.parts[part][2])
            size = f.size()
            at, n = struct.unpack("<QQ", f.read_at(16, size - 16))
            rows = json.loads(zlib.decompress(f.read_at(n, at)))
            return [(_bytes(k), _sort_key(k, p)[1]) for k, p, _, _ in rows], rows

        return self._kept(self.directories, part, make)

    def _block(self, part: int, block: int):
        def make():
            _, _, at, n = self._directory(part)[1][block]
            lines = [json.loads(x) for x in zlib.decompress(self._file(self.parts[part][2]).read_at(n, at)).decode().split("\n")]
            return [(_bytes(k), _sort_key(k, p)[1]) for k, p, *_ in lines], lines

        return self._kept(self.blocks, (part, block), make)

    def find(self, key: str, page_id) -> list[tuple[str, int, int]]:
        """(file, start, size) of each capture under this key and page."""
        want = (_bytes(key), _sort_key(key, page_id)[1])
        found = []
        part = max(bisect.bisect_left(self.firsts, want) - 1, 0)
        while part < len(self.parts) and self.firsts[part] <= want:
            firsts, _ = self._directory(part)
            block = max(bisect.bisect_left(firsts, want) - 1, 0)
            while block < len(firsts) and firsts[block] <= want:
                keys, lines = self._block(part, block)
                i = bisect.bisect_left(keys, want)
                while i < len(keys) and keys[i] == want:
                    found.append(tuple(lines[i][2:5]))
                    i += 1
                block += 1
            part += 1
        return found

    def read(self, file: str, start: int, size: int) -> tuple[dict[str, str], bytes]:
        return read_record(self._file(file).read_at(size, start))


#: Bytes of records that a task reads back.
READ_BYTES = 32 << 20


def archive(pages: DataFrame) -> tuple[str, str, list[tuple[str, int, str]], int]:
    """Writes archives and index for pages; returns their folders, the index's parts and the bytes of all records."""
    spark = pages.sparkSession
    archives, index = new_path(spark, "warc"), new_path(spark, "cdx")
    entries = write_archives(roles(pages), archives)
    return archives, index, write_index(entries, index), entries.agg(F.sum("size")).first()[0] or 0


_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, refers_url string"


def read_pages(pages: DataFrame, archives: str, index: str, parts, n_bytes: int = 0) -> DataFrame:
    """Looks every page (by url and page_id) up and reads its records: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url. Lengths and digests are those of payloads that were read: a revisit's come from the response that it
    refers to (by page, URL and digest); they are null if that isn't in the archives. n_bytes, the size of all records, spreads the reads over tasks."""

    def work(batches):
        if not parts:
            return
        cdx, warc = CaptureIndex(index, parts), CaptureIndex(archives, [])
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            for page_id, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for where in cdx.find(key, page_id):
                    h, payload = warc.read(*where)
                    kind, refers = h["WARC-Type"], h.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
                    ident = h["WARC-Record-ID"][len("<urn:page:") : -1]
                    n, digest = (len(payload), hashlib.sha1(payload).hexdigest()) if kind == "response" else (None, h["WARC-Payload-Digest"].removeprefix("sha1:"))
                    rows.append((int(ident) if ident else None, n, digest, kind, int(refers) if refers else None, h["WARC-Target-URI"], h.get("WARC-Refers-To-Target-URI")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "refers_url"])

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([surt(u) for u in batch.column(1).to_pylist()], pa.string())], names=["page_id", "key"])

    spark = pages.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // READ_BYTES))
    wanted = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(keys, "page_id bigint, key string").distinct()
    ordered = wanted.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    read = written(ordered.mapInArrow(work, _READ), "warc-read")
    responses, revisits = read.filter("record_type = 'response'"), read.filter("record_type <> 'response'")
    # What a revisit refers to is followed: one row for each response, so that revisits aren't multiplied.
    of = responses.groupBy(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("n"))
    same = F.col("refers_to").eqNullSafe(F.col("p")) & F.col("refers_url").eqNullSafe(F.col("u")) & (F.col("payload_digest") == F.col("d"))
    followed = revisits.join(of, same, "left").select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to", "url")
    return responses.select(*followed.columns).unionByName(followed)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """read_pages of what archive wrote. A null html is an empty payload, a null url an empty one, a null page_id one of its own; rows that
    repeat have a record each, of equal ids and payloads all responses; payloads of any length; an empty table gives an empty one; further
    columns of any name aren't read."""
    return read_pages(pages, *archive(pages))
