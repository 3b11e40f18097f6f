"""WARC archives with a two-level capture index.

Writing: each task writes its pages as WARC records, one gzip member each, into
archives of bounded size, and reports where every record lies. Captures are then
sorted by reversed-host URL key; each range of keys becomes an index shard of
compressed blocks and a sparse directory with the first key of each block.

Reading: a key finds its shard among the shards' first keys (one for each range
partition), its block in the shard's directory, and its line in the block, by
binary search each time; then only that block and that record are read.

Archives and index lie in a folder that all executors share and pyarrow can open.
A task that runs again writes new files under new names; only those of the attempt
that succeeded are in the table of captures.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import looked_up, materialise, new_folder, small_batches

#: Lines of an index block, and bytes after which an archive is closed.
BLOCK_LINES = 3000
ARCHIVE_BYTES = 256 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, id long, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """Reversed-host key of a URL: `com,example,www)/path?query`; '-' for null.

    Scheme, user, fragment, default ports and letter case of the host do not count.
    """
    plain = F.regexp_replace(url, r"#.*$", "")
    rest = F.regexp_replace(plain, r"^(?i)(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r":(?:80|443)?$", "")
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(path, r"\s", "%20")), F.lit("-"))


def capture_key(url: Column, page_id: Column) -> Column:
    """URL key and page id, so that the many captures of one URL are sorted and split too; order of ids as numbers."""
    number = F.lpad((page_id.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat_ws(" ", url_key(url), F.coalesce(number, F.lit("-")))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record, uncompressed: a response, or a revisit that has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'-' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []),
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """What a record says: type, page id, URL, payload (of responses), its length, digest, and the page it refers to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    kind, refers = fields["WARC-Type"], fields.get("WARC-Refers-To")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"a record's payload is not what its digest says: {fields['WARC-Record-ID']}")

    def page(x: str) -> int | None:
        number = x.removeprefix("<urn:page:").removesuffix(">")
        return None if number == "-" else int(number)

    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest, "refers_to": page(refers) if refers else None}


def typed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """`page_id`, `url`, `payload`, and `refers_to` for revisits.

    Of equal payloads of `least_bytes` or more the one with the largest page id is the
    response; rows that repeat that id are responses too. Payloads count as equal by
    SHA-1. A null page id is smaller than any; a null text is empty.
    """
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload"))
    large = own.where(F.octet_length("payload") >= least_bytes)
    again = large.groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null")
    # A payload that very many pages share, such as the empty one, is looked up by broadcast.
    joined = looked_up(own, materialise(again, "copies"), ["sha1"], how="left")
    first = F.col("response").isNull() | F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select("page_id", "url", "payload", F.when(~first, F.col("response")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write `typed` pages as archives below `folder`; returns the captures: `key`, `id`, `file`, `offset`, `length`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                made = {"key": batch.column("key"), "id": batch.column("page_id"), "file": [], "offset": [], "length": []}
                for page, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
                    member = squeeze.compress(record(page.as_py(), url.as_py(), payload.as_py().encode(), refers.as_py())) + squeeze.flush()
                    out.write(member)
                    for k, v in (("file", name), ("offset", at), ("length", len(member))):
                        made[k].append(v)
                    at += len(member)
                yield pa.RecordBatch.from_pydict(made)
        finally:
            if out is not None:
                out.close()

    small_batches(pages.sparkSession)
    keyed = pages.withColumn("key", capture_key(F.col("url"), F.col("page_id"))).select("key", "page_id", "url", "payload", "refers_to")
    return materialise(keyed.mapInArrow(task, CAPTURE), "captures")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index of some captures below `folder`; returns its shards: `first_key`, `file`, `directory_at`, `directory_length`.

    Keys are range-partitioned. A shard file holds its compressed blocks and, behind
    them, its directory: the first key, offset and length of each block.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        rows = (r for b in batches for r in b.to_pylist())
        row = next(rows, None)
        if row is None:
            return
        name, first, directory, at = f"index-{uuid.uuid4().hex}.cdx", row["key"], [], 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            while row is not None:
                lines, head = [], row["key"]
                while row is not None and len(lines) < block_lines:
                    lines.append(row["key"] + " " + json.dumps({k: row[k] for k in ("id", "file", "offset", "length")}))
                    row = next(rows, None)
                block = zlib.compress("\n".join(lines).encode())
                out.write(block)
                directory.append((head, at, len(block)))
                at += len(block)
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail)
        yield pa.RecordBatch.from_pydict({"first_key": [first], "file": [name], "directory_at": [at], "directory_length": [len(tail)]})

    parts = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = captures.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return materialise(ranged.mapInArrow(task, "first_key string, file string, directory_at long, directory_length long"), "shards")


class Index:
    """Lookups in an index, as a task makes them. Keeps the last few directories and blocks."""

    def __init__(self, folder: str, shards: list[tuple[str, str, int, int]]) -> None:
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.shards = shards
        self.firsts = [s[0] for s in shards]
        self.directory = lru_cache(4)(self._directory)
        self.block = lru_cache(4)(self._block)

    def _range(self, name: str, at: int, length: int) -> bytes:
        with self.fs.open_input_file(f"{self.base}/{name}") as f:
            f.seek(at)
            return f.read(length)

    def _directory(self, shard: int) -> tuple[list[str], list[list]]:
        _, name, at, length = self.shards[shard]
        rows = json.loads(zlib.decompress(self._range(name, at, length)))
        return [r[0] for r in rows], rows

    def _block(self, shard: int, k: int) -> tuple[list[str], list[str]]:
        _, at, length = self.directory(shard)[1][k]
        lines = zlib.decompress(self._range(self.shards[shard][1], at, length)).decode().split("\n")
        return [x.partition(" {")[0] for x in lines], lines

    def find(self, key: str) -> Iterator[dict]:
        """All captures of a key; equal keys may run over blocks and shards."""
        shard = max(0, bisect_left(self.firsts, key) - 1)
        k = max(0, bisect_left(self.directory(shard)[0], key) - 1)
        while shard < len(self.shards) and self.firsts[shard] <= key:
            firsts, _ = self.directory(shard)
            while k < len(firsts) and firsts[k] <= key:
                keys, lines = self.block(shard, k)
                for i in range(bisect_left(keys, key), bisect_right(keys, key)):
                    yield json.loads(lines[i][len(key) + 1 :])
                k += 1
            shard, k = shard + 1, 0


def resolve(keys: DataFrame, shards: DataFrame, folder: str, key: str = "key") -> DataFrame:
    """Captures of the different keys of a table; keys without capture give none.

    There is one row of `shards` for each range partition of the index, so they are
    few whatever the number of captures, and go to every task.
    """
    sc = keys.sparkSession.sparkContext
    sent = sc.broadcast(sorted((r["first_key"], r["file"], r["directory_at"], r["directory_length"]) for r in shards.toLocalIterator()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, sent.value)
        for batch in batches:
            found = [(k, c) for k in batch.column("key").to_pylist() for c in (index.find(k) if sent.value else ())]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), *(pa.array([c[x] for _, c in found], t) for x, t in (("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())))], names=["key", "id", "file", "offset", "length"])

    own = keys.select(F.col(key).alias("key")).distinct()
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return own.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(task, CAPTURE)


def fetch(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Read the records of some captures, each by its range: `page_id`, `url`, `record_type`, `payload`, `payload_bytes`, `payload_digest`, `refers_to`.

    Records are read in the order they lie in. A response whose payload is not what
    its digest says is an error.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if payloads else "")
    types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, f = "", None
        try:
            for batch in batches:
                rows = []
                for r in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    if r[0] != name:
                        if f is not None:
                            f.close()
                        name, f = r[0], fs.open_input_file(f"{base}/{r[0]}")
                    f.seek(r[1])
                    row = parsed(zlib.decompress(f.read(r[2]), 31))
                    rows.append(row if payloads else row | {"payload": None})
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], names=list(types))
        finally:
            if f is not None:
                f.close()

    parts = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return captures.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(task, schema)


def archive(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> tuple[str, DataFrame, DataFrame]:
    """Write archives and index of `pages` (`page_id`, `url`, `html`): their folder, the captures, and the index's shards."""
    folder = new_folder(spark, "warc")
    captures = write(typed(pages, least_bytes=least_bytes), f"{folder}/archives")
    return folder, captures, build_index(captures, f"{folder}/index")
