"""Web archives (operator 10): a deterministic, sharded WARC writer and a reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, ranges

#: A file is closed once it holds so many compressed bytes; a shard holds about so many bytes of payload.
ROLL_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_FILES = "name string, records long, bytes long, sha1 string"
READ = "file string, page string, record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id: str | None, digest: str, place: str = "") -> str:
    """place: what tells records of one page and digest apart; empty for the first of them."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest} {place}')}>"


def record(page_id: str | None, url: str, payload: bytes, digest: str, refers_to: str | None, place: str = "") -> bytes:
    """One gzip member: headers are made anew from the content, so equal input gives equal bytes.

    A record's block is an HTTP response: its head, whose Content-Length is that of the whole payload, and the payload, which a
    revisit leaves out.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, place)}", f"WARC-Date: {DATE}"]
    clean = "".join(c if 33 <= ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    if clean:
        lines.append(f"WARC-Target-URI: {clean}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def records(content: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of each record of a file of gzip members; lengths and digests are checked."""
    at, step = 0, 1 << 14
    view = memoryview(content)
    while at < len(content):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:  # a bit at a time: what stands behind a member is copied
            if at >= len(content):
                raise ValueError("the last record is cut short")
            parts.append(inflate.decompress(view[at : at + step]))
            at = min(at + step, len(content)) - len(inflate.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode("ascii").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        sent = dict(x.split(": ", 1) for x in http.decode("ascii").split("\r\n")[1:])
        whole = headers["WARC-Type"] == "revisit" or (len(payload) == int(sent["Content-Length"]) and headers["WARC-Payload-Digest"] == f"sha1:{base32_sha1(payload)}")
        if rest[len(block) :] != b"\r\n\r\n" or lines[0] != "WARC/1.1" or headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or not whole:
            raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
        yield headers, sent, payload


def write_warc(pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes a record for each row to folder/*.warc.gz, then the table folder/manifest (name, records, bytes, sha1), and returns that.

    Shards are ranges of the id with cut points from exact counts, so equal input gives equal files, whatever the
    number of tasks. Tasks write under temporary names, a new one for each attempt, and tell them in a table that holds what
    the attempts that Spark counts have written; these files then get their final names, in tasks, and the manifest comes last:
    without it an archive isn't there. Of equal payloads of at least `least` bytes the one with the smallest id is
    stored, others are revisits; of repeated rows (one id and payload) the first is stored. Null payloads are
    empty; null urls leave the header out; rows without an id are dealt by a hash of their content, each stored whole
    and never referred to. An empty table gives a manifest without files. Other columns, whatever their names, are left behind.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.unhex(F.sha1("payload"))})
    facts = rows.select("id", "size", "sha1")
    # of each payload that occurs under several ids, the smallest id; a row of these for each id that must refer to it
    first = facts.filter((F.col("size") >= least) & F.col("id").isNotNull()).groupBy("sha1").agg(F.min("id").alias("of"), F.max("id").alias("last")).filter("of < last").select("sha1", "of")
    refers = facts.filter(F.col("id").isNotNull()).join(first, "sha1").filter("id <> of").select("id", "sha1", "of").distinct()
    cuts = ranges.cut_points(facts.select("id", (F.col("size") + 512).alias("w")), "id", "w", shard_bytes)
    none = F.lit(None)
    both = rows.select("id", "url", "payload", "sha1", none.cast(pages.schema[id_column].dataType).alias("of"), F.lit(1).alias("kind")).unionByName(refers.select("id", F.lit("").alias("url"), F.lit(b"").alias("payload"), "sha1", "of", F.lit(0).alias("kind")))
    without = -1 - F.pmod(F.xxhash64("sha1", "url"), F.lit(len(cuts) + 1)).cast("int")
    both = both.withColumn("shard", F.when(F.col("id").isNull(), without).otherwise(ranges.place(F.col("id"), cuts)))
    placed = both.repartitionByRange(max(1, min(len(cuts) + 1, 4096)), "shard").sortWithinPartitions("shard", "id", "kind", "sha1", "url")
    base = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex
        system, there = _file_system(f"{base}/_temporary")
        shard = number = None
        buffer, count, known, current, done, seen, within = io.BytesIO(), 0, {}, None, [], {}, 0

        def close():
            nonlocal buffer, count, number
            if count:
                name = f"{attempt}-{len(done)}"
                data = buffer.getvalue()
                system.create_dir(there, recursive=True)
                with system.open_output_stream(f"{there}/{name}", compression=None) as out:
                    out.write(data)
                final = f"part-{shard:06d}-{number:04d}.warc.gz" if shard >= 0 else f"part-x{-1 - shard:06d}-{number:04d}.warc.gz"
                done.append((name, final, count, len(data), hashlib.sha1(data, usedforsecurity=False).hexdigest()))
            buffer, count = io.BytesIO(), 0
            number = 0 if number is None else number + 1

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                id_, sha1, of, kind, at = (columns[k][i].as_py() for k in (0, 3, 4, 5, 6))
                if at != shard:
                    close()
                    shard, number, within = at, 0, 0
                if current != id_ or id_ is None:
                    known, seen, current = {}, {}, id_
                if kind == 0:
                    known[sha1] = of
                    continue
                body = columns[2][i].as_py()
                again = seen.get(sha1, 0)
                seen[sha1] = again + 1
                within += 1
                refers_to, place = known.get(sha1), str(again) if again else ""
                if id_ is None:
                    place = f"{shard}.{within}"
                elif refers_to is None and again and len(body) >= least:
                    refers_to = id_
                buffer.write(record(None if id_ is None else str(id_), columns[1][i].as_py(), body, base64.b32encode(sha1).decode(), None if refers_to is None else str(refers_to), place))
                count += 1
                if buffer.tell() >= roll:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["temporary", "name", "records", "bytes", "sha1"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, there = _file_system(base)
        for batch in batches:
            for old, new in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if system.get_file_info(f"{there}/_temporary/{old}").type == fs.FileType.File:  # else an attempt before has moved it
                    system.move(f"{there}/_temporary/{old}", f"{there}/{new}")
            yield batch.select(["name", "records", "bytes", "sha1"])

    common.in_arrow(placed, write, f"temporary string, {_FILES}").write.parquet(f"{base}/_written")
    told = spark.read.schema(f"temporary string, {_FILES}").parquet(f"{base}/_written")
    common.in_arrow(told, move, _FILES).write.parquet(f"{base}/manifest")
    system, there = _file_system(base)
    for name in ("_temporary", "_written"):
        if system.get_file_info(f"{there}/{name}").type == fs.FileType.Directory:
            system.delete_dir(f"{there}/{name}")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_FILES).parquet(f"{folder.rstrip('/')}/manifest")


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the files that folder/manifest names, each file read by the task that holds its name.

    Revisits have no payload; lengths and digests are those of the full payload. A file that isn't as the manifest says, and a
    damaged record, end the job with an error.
    """
    base = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, there = _file_system(base)
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_stream(f"{there}/{name}", compression=None) as source:
                    content = source.read()
                if len(content) != size:
                    raise ValueError(f"{name} has {len(content)} bytes, the manifest says {size}")
                rows, held = [], 0
                for h, sent, payload in records(content):
                    rows.append((name, h.get("X-Page"), h["WARC-Record-ID"], h["WARC-Type"], h.get("X-Refers-To-Page"), int(sent["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), payload if payloads else None))
                    held += 200 + len(payload)
                    if held > common.BLOCK_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    named = manifest(spark, folder).select("name", "bytes")
    return common.in_arrow(named.repartition(spark.sparkContext.defaultParallelism * 2, "name"), run, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in READ.split(", ")])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    folder = common.scratch(spark, "warc")
    write_warc(pages, folder)
    found = read_warc(spark, folder, payloads=False)
    kind = pages.schema["page_id"].dataType
    return found.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
