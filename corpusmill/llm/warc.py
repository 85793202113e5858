"""WARC archives from a table of pages: a deterministic sharded writer, and a reader.

Records are range-sorted by page id. Shard bounds come from exact sizes of id blocks, so the same rows give the same
files whatever the cluster. A shard's file is closed once its compressed size passes ``roll_bytes``. Tasks write
under temporary names of their own attempt; the manifest table names the attempts that count, and commit() renames
these and removes the rest.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed, pieces_of

ROLL_BYTES, SHARD_BYTES = 64 << 20, 256 << 20
#: Blocks of page ids whose sizes the driver sees; also the bound on the number of shards.
ID_BLOCKS = 4096
LEVEL = 4
WARC_DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {url}')}>"


def one_line(value: str) -> str:
    """A header value: control characters become %XX."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def render(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit of the response with page id ``refers_to``."""
    digest = base32_sha1(payload)
    status = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = status + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, url)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without time or name, so that equal records give equal bytes."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


class Files:
    """A folder of any file system that pyarrow knows by its URI; bare paths are local."""

    def __init__(self, where: str):
        self.fs, self.root = pafs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (pafs.LocalFileSystem(), where)

    def path(self, name: str) -> str:
        return posixpath.join(self.root, name)


MANIFEST = "shard int, part int, name string, temporary string, n_records long, n_bytes long, sha256 string"


def revisits(rows: DataFrame) -> DataFrame:
    """Rows (page_id, digest, refers_to) of records that are not the one with the largest page_id of their payload.

    Payloads are compared by SHA-1 and length; they stay where they are.
    """
    keyed = rows.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("n"))
    last = keyed.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"))
    return keyed.join(last, ["digest", "n"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def shard_of(rows: DataFrame, shard_bytes: int):
    """A column that deals ids to shards in ranges, by exact sums of payload over ID_BLOCKS blocks of ids, and their number."""
    low, high = rows.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return F.lit(0), 1
    width = (high - low) // ID_BLOCKS + 1
    block = F.coalesce(F.floor((F.col("page_id") - F.lit(low)) / F.lit(width)).cast("int"), F.lit(0))
    sizes = rows.groupBy(block.alias("block")).agg(F.sum(F.length("payload") + 600).alias("n")).orderBy("block").collect()
    starts, held = [], 0
    for r in sizes:
        if not starts or held + r["n"] > shard_bytes:
            starts.append(r["block"])
            held = 0
        held += r["n"]
    bounds = F.array(*[F.lit(x) for x in starts])
    return F.size(F.filter(bounds, lambda x: x <= block)) - 1, len(starts)


def write(pages: DataFrame, where: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives under ``where`` (shared by all machines) and return the manifest of committed files.

    Null html is an empty payload, null url an empty one. A null page_id sorts first and never is the response of
    rows with an id; where all ids of a payload are null, or several rows share the largest, each of these is a
    response. An empty table gives no files. Other columns are ignored.
    """
    page_id, payload = F.col(id_col).cast("long").alias("page_id"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload")
    rows = pages.select(page_id, F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload)
    shard, shards = shard_of(rows, shard_bytes)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(where)
        files.fs.create_dir(files.path("_temporary"), recursive=True)
        out, done, now = None, [], None
        ahead, ahead_of = {}, object()  # revisits of the page id at hand, by digest; they are sorted before its pages

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append(now | {"sha256": now["sha256"].hexdigest()})
                out = None

        for piece in pieces_of(batches, "payload", 8 << 20):
            for s, page_id, url, payload, digest, refers in zip(*(piece.column(c).to_pylist() for c in ("shard", "page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if page_id != ahead_of:
                    ahead, ahead_of = {}, page_id
                if digest is not None:
                    ahead[digest] = refers
                    continue
                refers = ahead.get(hashlib.sha1(payload).hexdigest()) if ahead else None
                if out is not None and (s != now["shard"] or now["n_bytes"] >= roll_bytes):
                    close()
                if out is None:
                    part = now["part"] + 1 if now is not None and now["shard"] == s else 0
                    name = f"part-{s:05d}-{part:05d}.warc.gz"
                    now = {"shard": s, "part": part, "name": name, "temporary": f"_temporary/{name}.{uuid.uuid4().hex}", "n_records": 0, "n_bytes": 0, "sha256": hashlib.sha256()}
                    out = files.fs.open_output_stream(files.path(now["temporary"]), compression=None)
                data = gzip_member(render(page_id, url, payload, refers))
                out.write(data)
                now["n_records"] += 1
                now["n_bytes"] += len(data)
                now["sha256"].update(data)
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]))

    # Revisits are merged to their pages in the order of the shard, so payloads are shuffled once.
    marks = revisits(rows).selectExpr("page_id", "cast(null as string) url", "cast(null as binary) payload", "digest", "refers_to")
    both = rows.selectExpr("page_id", "url", "payload", "cast(null as string) digest", "cast(null as bigint) refers_to").unionByName(marks)
    dealt = both.withColumn("shard", shard.cast("int")).repartition(2 * shards, "shard")  # as many partitions as the data need, whatever the session's setting
    ordered = dealt.sortWithinPartitions("shard", "page_id", F.col("digest").asc_nulls_last(), "url", F.xxhash64("payload"))
    manifest = checkpointed(ordered.select("shard", "page_id", "url", "payload", "digest", "refers_to").mapInArrow(put, MANIFEST))
    commit(where, manifest)
    return manifest


def commit(where: str, manifest: DataFrame) -> None:
    """Give the manifest's files their names, write the manifest beside them and remove other attempts' files.

    One row a file: as many as the archive's bytes divided by the roll size. Renaming anew does no harm.
    """
    files = Files(where)
    rows = manifest.orderBy("shard", "part")
    names = []
    for r in rows.toLocalIterator():
        if files.fs.get_file_info(files.path(r["temporary"])).type == pafs.FileType.File:
            files.fs.move(files.path(r["temporary"]), files.path(r["name"]))
        names.append(f"{r['sha256']} {r['n_records']} {r['n_bytes']} {r['name']}\n")
    files.fs.create_dir(files.root, recursive=True)
    with files.fs.open_output_stream(files.path("_MANIFEST.tmp")) as f:
        f.write("".join(names).encode())
    files.fs.move(files.path("_MANIFEST.tmp"), files.path("_MANIFEST"))
    if files.fs.get_file_info(files.path("_temporary")).type == pafs.FileType.Directory:
        files.fs.delete_dir(files.path("_temporary"))


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip member stream, one record in memory at a time."""
    inflate, held, ended = zlib.decompressobj(31), b"", False

    def more() -> bool:
        nonlocal inflate, held, ended
        data = inflate.unused_data if inflate.eof else b""
        if inflate.eof:
            inflate = zlib.decompressobj(31)
        data = data or stream.read(READ_BYTES)
        if not data:
            ended = True
            return False
        held += inflate.decompress(data)
        return True

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held:
                    raise ValueError("the archive ends within a record")
                return
        lines = held[:at].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(headers["content-length"])
        while len(held) < at + 4 + n + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        block, tail = held[at + 4 : at + 4 + n], held[at + 4 + n : at + 8 + n]
        if tail != b"\r\n\r\n" or headers["warc-block-digest"] != "sha1:" + base32_sha1(block):
            raise ValueError("a record's block does not match its headers")
        held = held[at + 8 + n :]
        yield headers, block


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(spark: SparkSession, where: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Rows of all records of the manifest's files; every block is checked against its digest. A revisit's payload
    is null, its length and digest those of the full payload. Without ``with_payload`` payloads are left out."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(where)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with files.fs.open_input_stream(files.path(name), compression=None) as stream:
                    for h, block in records(stream):
                        payload = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if payload is not None and (base32_sha1(payload) != digest or len(payload) != int(h["x-payload-length"])):
                            raise ValueError("a record's payload does not match its headers")
                        rows.append((int(h["x-page-id"]) if h["x-page-id"] else None, h["warc-target-uri"], int(h["x-payload-length"]), digest, h["warc-type"], int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None, payload if with_payload else None))
                        held += len(block)
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("name").repartition(n, F.xxhash64("name")).mapInArrow(get, RECORDS)
