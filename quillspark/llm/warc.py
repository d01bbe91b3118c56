"""WARC (operator 8): a deterministic sharded writer, and a reader.

A first pass takes each payload's SHA-1 and length; the smallest page_id of each digest is its response, other pages with
that payload revisit it. Records are ordered by (page_id, digest) and cut into shards of equal payload bytes: digests are
range-partitioned, each range sums its bytes, and running sums over the ranges give the exact pair at which each shard
begins, whatever the ids' distribution and the input's partitions (the driver gets a number a range and a pair a shard).
A Python stage builds each page's compressed response record beside its row, so what is shuffled is compressed. Each shard
is sorted and written as gzip members, rolled into a new file beyond a compressed size. Files get temporary names with the
task attempt in them and are renamed when complete: a repeated task writes the same bytes to the same final names. A
manifest of files, counts, sizes and SHA-256 is written last under a temporary name and renamed: what it doesn't list
isn't part of the archive; temporary files that failed attempts left are removed then.

Beyond `most_shards` shards (each a task) shards grow, and with them the number of files of each; nothing else changes.

Defined cases: a null payload counts as empty, empty payloads are deduplicated like others (min_bytes sets from which
size on); of rows that repeat page_id and payload the first is the response and the others, small records, revisit it in
the same shard; page_ids may be of any type that can be ordered and cast from a string; a null page_id sorts first and is
written as "null"; a null URL is written empty; an empty table gives an empty manifest; further columns are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from bisect import bisect_right
from urllib.parse import quote, unquote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, table, values

DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, shard int, records long, bytes long, sha256 string"
#: Payload bytes that a shard should have, the compressed bytes beyond which a file is followed by another, and the tasks of the writing stage.
SHARD_BYTES, ROLL_BYTES, MOST_SHARDS = 8 << 20, 64 << 20, 16_384
#: Bytes of records that a Python stage holds at a time.
HELD_BYTES = 8 << 20


def base32(sha1_hex: str) -> str:
    """A digest as WARC files write it."""
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _urn(page_id, digest: str, repeat: int = 0) -> str:
    named = "null" if page_id is None else quote(str(page_id), safe="-") if str(page_id) != "null" else "%6Eull"
    return f"<urn:x-page:{named}:{digest}:{repeat}>" if repeat else f"<urn:x-page:{named}:{digest}>"


def _page_of(urn: str) -> str | None:
    found = urn.strip("<>").split(":")[2]
    return None if found == "null" else unquote(found)


def _line(text: str) -> str:
    """For a header: control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _block_digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def response_record(page_id, url: str, digest: str, payload: bytes) -> bytes:
    """A compressed response record."""
    block = _http(len(payload)) + payload
    return _member(
        [("WARC-Type", "response"), ("WARC-Record-ID", _urn(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", _block_digest(block)), ("Content-Type", "application/http; msgtype=response")],
        block,
    )


def revisit_record(page_id, url: str, digest: str, size: int, refers_to, repeat: int) -> bytes:
    """A compressed revisit record: the HTTP headers only, with the full payload's length and digest."""
    block = _http(size)
    return _member(
        [("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(page_id, digest, repeat)), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", _block_digest(block)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to, digest)), ("Content-Type", "application/http; msgtype=response")],
        block,
    )


def _open(uri: str):
    """A filesystem and a path in it: local, or any that Arrow knows by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _selector(root: str):
    from pyarrow import fs

    return fs.FileSelector(root)


class _Files:
    """The files of one task: temporary until complete."""

    def __init__(self, out: str, roll: int):
        self.fs, self.root = _open(out)
        self.roll, self.attempt, self.done = roll, TaskContext.get().taskAttemptId(), []
        self.stream = None

    def add(self, shard: int, member: bytes) -> None:
        if self.stream is not None and (shard != self.shard or self.bytes >= self.roll):
            self.close()
        if self.stream is None:
            fresh = not self.done or self.done[-1][1] != shard
            self.shard, self.part, self.bytes, self.records = shard, 0 if fresh else self.part + 1, 0, 0
            self.name = f"shard-{shard:05d}-{self.part:04d}.warc.gz"
            self.temporary = f"{self.root}/_temporary-{self.attempt}-{self.name}"
            self.stream, self.digest = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256()
            self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(member)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.bytes, self.digest.hexdigest()))
            self.stream = None


def shard_bounds(ws: Workspace, digests: DataFrame, shard_bytes: int, most_shards: int) -> list[tuple]:
    """The (page_id, sha1) at which each shard but the first begins, from digests(page_id, sha1, n)."""
    total = digests.agg(F.sum(F.col("n") + 1)).first()[0] or 0
    step = max(shard_bytes, -(-total // most_shards))
    if total <= step:
        return []
    cells = digests.groupBy("page_id", "sha1").agg(F.sum(F.col("n") + 1).alias("n"))
    ranges = max(1, min(4096, total // (16 * step)))
    parted = ws.keep(cells.repartitionByRange(ranges, "page_id", "sha1").withColumn("part", F.spark_partition_id()), "cells")
    sums = {r["part"]: r["n"] for r in parted.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, starts = 0, []
    for part in sorted(sums):
        starts.append((part, before))
        before += sums[part]
    first = ws.spark.createDataFrame(starts, "start_part int, before long")
    order = Window.partitionBy("part").orderBy("page_id", "sha1")
    placed = parted.join(F.broadcast(first), F.col("part") == F.col("start_part")).withColumn("at", F.col("before") + F.sum("n").over(order) - F.col("n"))
    # A pair belongs to the shard in which its first byte is; a shard begins at its first pair.
    begins = placed.groupBy(F.floor(F.col("at") / step).alias("shard")).agg(F.min(F.struct("page_id", "sha1")).alias("first")).where("shard > 0")
    return sorted(((r["first"][0] is not None, r["first"][0], r["first"][1]) for r in begins.collect()), key=lambda b: (b[0], b[1] if b[0] else 0, b[2]))


def _in_batches(rows, schema):
    """Arrow batches of rows, each with its bytes as first element, of at most some HELD_BYTES."""
    import pyarrow as pa

    held, part = 0, []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), schema.types)], schema=schema)
    for size, row in rows:
        part.append(row)
        held += size + 200
        if held > HELD_BYTES:
            yield make()
            held, part = 0, []
    if part:
        yield make()


def write_warc(spark: SparkSession, pages: DataFrame, out: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html", most_shards: int = MOST_SHARDS) -> DataFrame:
    """Write the pages below the folder out, which driver and executors share; the manifest."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    ws = Workspace(spark, "warc-digests")
    plain = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kind, arrow_kind = plain.dtypes[0][1], to_arrow_type(plain.schema["page_id"].dataType)
    payload = F.encode("html", "UTF-8")
    digests = ws.keep(plain.select("page_id", F.sha1(payload).alias("sha1"), F.length(payload).cast("long").alias("n")), "digests")
    bounds = shard_bounds(ws, digests, shard_bytes, most_shards)
    shards = len(bounds) + 1

    firsts = ws.keep(digests.where(F.col("n") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first IS NOT NULL").select("sha1", "first"), "firsts")
    revisits = digests.join(firsts, "sha1").where("page_id IS NULL OR page_id <> first").select("page_id", "sha1", "first")
    rows = plain.select("page_id", "url", "html", F.lit(None).cast("string").alias("sha1"), F.lit(None).cast(kind).alias("first"), F.lit(1).alias("kind"))
    told = revisits.select("page_id", F.lit("").alias("url"), F.lit("").alias("html"), "sha1", "first", F.lit(0).alias("kind"))

    built_schema = pa.schema([("shard", pa.int32()), ("page_id", arrow_kind), ("kind", pa.int32()), ("url", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("first", arrow_kind), ("member", pa.binary())])

    def build(batches):
        def records():
            for b in batches:
                for at in range(0, b.num_rows, 100):
                    part = b.slice(at, 100)
                    bodies = part.column(2).cast(pa.large_binary() if pa.types.is_large_string(part.column(2).type) else pa.binary())
                    for i, u, h, s, first, record in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), bodies, part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist()):
                        body = h.as_py()
                        sha1 = hashlib.sha1(body).hexdigest() if record else s
                        digest = base32(sha1)
                        member = response_record(i, u, digest, body) if record else None
                        yield len(member or b""), (bisect_right(bounds, (i is not None, i, sha1)), i, record, u, digest, len(body), first, member)

        yield from _in_batches(records(), built_schema)

    built = rows.unionByName(told).mapInArrow(build, f"shard int, page_id {kind}, kind int, url string, digest string, size long, first {kind}, member binary")
    ordered = built.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def write(batches):
        files, now, first, repeat = _Files(out, roll_bytes), None, None, 0
        for b in batches:
            for row in zip(*(values(c, 100) for c in b.columns)):
                shard, page, record, link, digest, size, refers, member = row
                if (page, digest) != now:
                    now, first, repeat, told = (page, digest), None, 0, False
                if not record:
                    first, told = refers, True
                    continue
                if told:
                    files.add(shard, revisit_record(page, link, digest, size, first, repeat))
                elif repeat and size >= min_bytes:
                    files.add(shard, revisit_record(page, link, digest, size, page, repeat))
                else:
                    files.add(shard, member)
                repeat += 1
        files.close()
        if files.done:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*files.done), kinds)], names=["file", "shard", "records", "bytes", "sha256"])

    filesystem, root = _open(out)
    filesystem.create_dir(root, recursive=True)
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{out}/_manifest-temporary")
    source, target = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_manifest-temporary"), spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_manifest")
    store = source.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(target, True)
    if not store.rename(source, target):
        raise OSError(f"{out}/_manifest can't be committed")
    for left in filesystem.get_file_info(_selector(root)):
        if left.base_name.startswith("_temporary-"):
            filesystem.delete_file(left.path)
    return spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")


def _members(stream):
    """The decompressed gzip members of a stream, one at a time."""
    inflate, data = zlib.decompressobj(31), b""
    parts: list[bytes] = []
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            if parts:
                raise ValueError("a record is cut off")
            return
        parts.append(inflate.decompress(data))
        data = b""
        if inflate.eof:
            yield b"".join(parts)
            data, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, block


def read_warc(spark: SparkSession, out: str, id_type: str = "long") -> DataFrame:
    """A row for each page record of the archive: page_id and refers_to (of id_type), url, record_type, payload_bytes, payload_digest, payload (null for revisits). Digests are verified."""
    import pyarrow as pa

    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")
    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def records(name: str):
        filesystem, root = _open(out)
        with filesystem.open_input_stream(f"{root}/{name}", compression=None) as stream:
            for raw in _members(stream):
                headers, block = parse_record(raw)
                if headers["WARC-Type"] == "warcinfo":
                    continue
                if headers["WARC-Block-Digest"] != _block_digest(block):
                    raise ValueError(f"{headers['WARC-Record-ID']}: the block's digest is wrong")
                http, _, payload = block.partition(b"\r\n\r\n")
                digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
                whole = headers["WARC-Type"] == "response"
                if whole and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{headers['WARC-Record-ID']}: the payload's digest is wrong")
                refers = None if whole else _page_of(headers["WARC-Refers-To"])
                yield _page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI", ""), headers["WARC-Type"], refers, size, digest, payload if whole else None

    def read(batches):
        found = (r for b in batches for name in b.column(0).to_pylist() for r in records(name))
        yield from _in_batches(((len(r[6] or b""), r) for r in found), schema)

    files = manifest.select("file")
    rows = files.repartition(max(1, min(10_000, files.count())), "file").mapInArrow(read, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as read back from the archive written of them."""
    out = Workspace(spark, "warc").path("archive")
    write_warc(spark, table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first, row_number() OVER (PARTITION BY h, page_id) AS again FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, CAST(i // 4 AS INT) * 5 + 1, 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first AND again = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first OR again > 1 THEN first END AS refers_to
FROM f
"""
