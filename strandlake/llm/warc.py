"""WARC in seekable Zstandard bundles.

Every task writes bundles of its own: records are grouped into independent frames, and a seek table stands in a
skippable frame at the end. The index maps a record's identifier to bundle, frame and offset inside the frame, so a
reader fetches the table and then single frames. Of equal payloads one is kept as a response and the others refer to it.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, tune, written

#: Fixed values of the seekable format: magic of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Raw bytes after which a frame, and a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 256 << 20
#: Parts that the pages of one payload are dealt into.
SALTS = 8
_INDEX = "record_id string, page_id long, record_type string, bundle string, frame int, offset long, length long"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(record_id: str, page_id: int | None, url: str | None, kind: str, digest: str, payload: bytes, refers_to: int | None, refers_id: str | None) -> bytes:
    """One WARC/1.1 record; a response holds an HTTP message, a revisit its header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http[:15] + b"\r\n\r\n"
    safe = "".join(c if c > " " and c != "\x7f" else "%" + c.encode().hex() for c in (url or "about:blank"))
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", safe),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<{refers_id}>"), ("X-Refers-To-Page-Id", str(refers_to))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, payload) of one record; raises ValueError if it is malformed."""
    head, sep, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1" or not sep:
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise ValueError("record length differs")
    return fields, body[:n].partition(b"\r\n\r\n")[2]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame that lists (compressed, raw) sizes of all frames."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(stream, size: int) -> list[tuple[int, int]]:
    """(place, compressed size) of every frame, from the end of a bundle."""
    stream.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    stream.seek(size - 9 - 8 * n)
    sizes = [x for x, _ in struct.iter_unpack("<II", stream.read(8 * n))]
    out, at = [], 0
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def _write(base: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        pack = zstandard.ZstdCompressor(level=3)
        out, name, frames, rows, buffer, raw = None, "", [], [], io.BytesIO(), 0

        def close_frame() -> None:
            nonlocal buffer
            if data := buffer.getvalue():
                done = pack.compress(data)
                out.write(done)
                frames.append((len(done), len(data)))
                buffer = io.BytesIO()

        def close_bundle() -> pa.RecordBatch:
            nonlocal out, frames, rows, raw
            close_frame()
            out.write(seek_table(frames))
            out.close()
            cols = list(zip(*rows))
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                names=["record_id", "page_id", "record_type", "bundle", "frame", "offset", "length"],
            )
            out, frames, rows, raw = None, [], [], 0
            return batch

        for batch in batches:
            for page, url, html, digest, kind, refers in zip(*(batch.column(i) for i in range(6))):
                if out is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"  # a task that runs twice leaves a bundle that no index lists
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                page, refers, digest, kind = page.as_py(), refers.as_py(), digest.as_py(), kind.as_py()
                own = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}"
                data = record(own, page, url.as_py(), kind, digest, (html.as_py() or "").encode(), refers, kind == "revisit" and f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers}/{digest}')}")
                rows.append((own, page, kind, name, len(frames), buffer.tell(), len(data)))
                buffer.write(data)
                raw += len(data)
                if buffer.tell() >= frame_bytes:
                    close_frame()
                if raw >= bundle_bytes:
                    yield close_bundle()
        if out is not None:
            yield close_bundle()

    return run


def _read(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        unpack = zstandard.ZstdDecompressor()
        name, stream, table, frame, data = None, None, [], -1, b""
        for batch in batches:
            rows = []
            for bundle, k, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bundle != name:
                    if stream:
                        stream.close()
                    stream = store.open_input_file(f"{root}/{bundle}")
                    name, table, frame = bundle, read_seek_table(stream, stream.size()), -1
                if k != frame:
                    stream.seek(table[k][0])
                    frame, data = k, unpack.decompress(stream.read(table[k][1]))
                fields, payload = parse(data[offset : offset + length])
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"digest of {fields['WARC-Record-ID']} differs")
                page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                rows.append((page and int(page), len(payload) if kind == "response" else None, digest, kind, refers and int(refers)))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            )
        if stream:
            stream.close()

    return run


def write(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes bundles into the folder `base`, which all executors reach, and returns the index.

    The payload is the html in UTF-8, empty for null. Of payloads equal and at least `least` bytes long, those with the
    smallest id are responses; rows with a greater id are revisits. Smaller payloads and rows with a null id are always responses.
    Rows equal in id and payload are records of their own with one record id, each with its place in the index. Null URLs are
    written as about:blank. Other columns are not read; an empty table writes no bundle.
    """
    tune(pages.sparkSession, 128)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    # Only digests that occur again are joined, once for each salt; payloads too small to be revisited meet none and lie anywhere.
    again = src.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = again.select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    spread = F.xxhash64("page_id")
    salted = src.withColumn("salt", F.when(F.octet_length("html") >= least, F.pmod(spread, F.lit(SALTS).cast("long"))).otherwise(spread))
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    typed = salted.join(first, ["digest", "salt"], "left").select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to")
    )
    return written(typed.mapInArrow(_write(base, frame_bytes, bundle_bytes), _INDEX), "index")


def read(index: DataFrame, base: str) -> DataFrame:
    """Reads the indexed records: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The payload of a revisit is that of the response it refers to.
    """
    tune(index.sparkSession)
    rows = index.select("bundle", "frame", "offset", "length").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    back = written(rows.mapInArrow(_read(base), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "records")
    plain = back.where("record_type = 'response'")
    sizes = plain.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("size")).distinct()
    visits = back.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left")
    return plain.unionByName(visits.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def archive_folder(spark) -> str:
    """A new folder for bundles in the shared folder."""
    return f"{shared_dir(spark)}/strandlake-warc-{uuid.uuid4().hex}"
