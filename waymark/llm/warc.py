"""WARC archives: records written as one gzip stream, normalised to one member per record with
an offset index, and read back by that index.

``normalise`` inflates a whole-file stream once, a chunk at a time, and deflates each record
anew as a member of its own, so any record can be read alone afterwards. At no time is more
than one record's header and one chunk in memory.

Files are written to a temporary name and renamed at the end; names and bytes depend on the
partition alone, so a task that is run again replaces its file by an equal one.

Defined cases: a null html is an empty payload; a null page_id is written as an empty field
and read back as null, and is the least; rows with one page_id and equal payload are all
responses if that page_id is the largest of the payload; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import scratch, shuffle_partitions, written

CHUNK = 1 << 16
#: Raw bytes after which a new archive is begun.
ROLL_BYTES = 64 << 20
_DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, kind: str) -> bytes:
    """One record; a revisit has no block, and the payload's length in a header of its own."""
    block = b"" if kind == "revisit" else payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> dict[str, str]:
    """Fields of a record's header in lower case; lines may be folded or end in LF alone."""
    out: dict[str, str] = {}
    name = ""
    for line in data.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def inflate(src: BinaryIO) -> Iterator[bytes]:
    """Bytes of a gzip file, whether one stream or many members."""
    z, data = zlib.decompressobj(31), b""
    while True:
        data = data or src.read(CHUNK)
        if not data:
            if not z.eof and (part := z.flush()):
                yield part
            return
        if z.eof:
            z = zlib.decompressobj(31)
        part = z.decompress(data, CHUNK)
        data = z.unconsumed_tail or z.unused_data
        if part:
            yield part


def normalise(src: BinaryIO, dst: BinaryIO) -> Iterator[tuple[int, int, str, str]]:
    """Rewrites each record of src as a member of dst; yields offset, length, id and type."""
    parts, buf, at = inflate(src), bytearray(), 0

    def more() -> bool:
        part = next(parts, None)
        if part is not None:
            buf.extend(part)
        return part is not None

    while True:
        while (skip := len(buf) - len(buf.lstrip(b"\r\n"))) == len(buf):
            buf.clear()
            if not more():
                return
        del buf[:skip]
        while (end := min((k + n for m, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (k := buf.find(m)) >= 0), default=-1)) < 0:
            if not more():
                raise ValueError("a record's header is cut off")
        head = bytes(buf[:end])
        fields = headers(head)
        left = int(fields["content-length"])
        z, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0

        def put(data: bytes) -> None:
            nonlocal size
            dst.write(data)
            size += len(data)  # noqa: B023

        put(z.compress(head))
        del buf[:end]
        while left:
            if not buf and not more():
                raise ValueError("a record's block is cut off")
            take = bytes(buf[:left])
            put(z.compress(take))
            left -= len(take)
            del buf[: len(take)]
        put(z.compress(b"\r\n\r\n") + z.flush())
        yield at, size, fields.get("warc-record-id", ""), fields.get("warc-type", "")
        at += size


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _names(folder: str) -> Iterator[str]:
    part, k = TaskContext.get().partitionId(), 0
    while True:
        yield f"{folder}/part-{part:06d}-{k:04d}.warc.gz"
        k += 1


def _write(it: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Monolithic archives of the rows (page_id, url, html, kind, refers_to); yields their names."""
    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    tag = TaskContext.get().taskAttemptId()
    names, out, done = _names(root), None, []
    for b in it:
        for page, url, html, kind, to in zip(*[b.column(i).to_pylist() for i in range(5)]):
            if out is None:
                name, z, raw = next(names), zlib.compressobj(6, zlib.DEFLATED, 31), 0
                out = fs.open_output_stream(f"{name}.{tag}.tmp", compression=None)
            data = record(page, url, (html or "").encode(), to, kind)
            out.write(z.compress(data))
            raw += len(data)
            if raw >= ROLL_BYTES:
                out.write(z.flush())
                out.close()
                fs.move(f"{name}.{tag}.tmp", name)
                done.append(name)
                out = None
    if out is not None:
        out.write(z.flush())
        out.close()
        fs.move(f"{name}.{tag}.tmp", name)
        done.append(name)
    yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])


def _rewrite(it: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Normalised copies of archives; yields their index."""
    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    tag = TaskContext.get().taskAttemptId()
    for b in it:
        for file in b.column(0).to_pylist():
            to = f"{root}/{file.rpartition('/')[2]}"
            with fs.open_input_stream(file, compression=None) as src, fs.open_output_stream(f"{to}.{tag}.tmp", compression=None) as dst:
                rows = list(normalise(src, dst))
            fs.move(f"{to}.{tag}.tmp", to)
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array([to] * len(rows), pa.string()), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))]], names=["file", "offset", "length", "record_id", "kind"])


def _read(it: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Records at (file, offset, length), each inflated by itself."""
    fs, _ = _place(folder)
    page = lambda s: None if s in (None, "<urn:page:>", "<urn:page:None>") else int(s[10:-1])
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html")
    opened, src = None, None
    for b in it:
        rows, held = [], 0
        for file, offset, length in zip(*[b.column(i).to_pylist() for i in range(3)]):
            if file != opened:
                if src is not None:
                    src.close()
                opened, src = file, fs.open_input_file(file)
            data = zlib.decompress(src.read_at(length, offset), 31)
            head, _, rest = data.partition(b"\r\n\r\n")
            h = headers(head)
            kind, block = h["warc-type"], rest[: int(h["content-length"])]
            sha = h["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and digest(block) != sha:
                raise ValueError(f"{h['warc-record-id']}: the payload differs from its digest")
            n = int(h["x-payload-length"]) if kind == "revisit" else len(block)
            rows.append((page(h["warc-record-id"]), n, sha, kind, page(h.get("warc-refers-to")), h.get("warc-target-uri"), block.decode() if kind == "response" else None))
            held += len(block)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(names))
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(names))
    if src is not None:
        src.close()


def with_roles(pages: DataFrame) -> DataFrame:
    """Adds kind and refers_to: of equal payloads the largest page_id is the response.

    Only digests are grouped (with a map-side part); only payloads that occur again come back,
    and they meet the pages by an outer join that AQE can split where one payload is very common.
    """
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    keyed = pages.select("page_id", "url", "html", sha.alias("_sha"))
    twice = keyed.groupBy("_sha").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_sha", "_last")
    both = keyed.join(twice, "_sha", "left")
    again = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return both.select("page_id", "url", "html", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"), F.when(again, F.col("_last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Normalised archives of pages in folder; returns their index (file, offset, length,
    record_id, kind), which is also written beside them."""
    spark = pages.sparkSession
    rows = with_roles(pages).select("page_id", "url", "html", "kind", "refers_to")
    mono = written(rows.mapInArrow(partial(_write, folder=f"{folder}/mono"), "file string"))
    files = mono.repartition(shuffle_partitions(spark), "file")
    index = files.mapInArrow(partial(_rewrite, folder=f"{folder}/records"), "file string, offset long, length long, record_id string, kind string")
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Records of an index: page_id, payload_bytes, payload_digest, record_type, refers_to, url, html."""
    return index.select("file", "offset", "length").mapInArrow(
        partial(_read, folder=f"{folder}/records"), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    folder = scratch(pages.sparkSession)
    return read_archives(write_archives(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
