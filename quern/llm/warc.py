"""WARC records in seekable Zstandard bundles.

Pages become WARC/1.1 records. Records are grouped into frames of about
``FRAME`` bytes, each compressed on its own, and a bundle ends with a seek
table (a skippable frame, as in the Zstandard seekable format) that gives every
frame's sizes. An index maps a record to its bundle, its frame and the offset
and length inside the frame; with the seek table that is all a reader needs to
decompress one frame and cut the record out.

Of records with equal payloads of ``least`` bytes or more, the one with the
smallest page_id is a response and the others are revisits that name it.

A record's id follows from its page id and payload digest, so a second run
writes the same records, and the index names it beside the page id; a revisit names the id of the response it repeats.

Which payloads are equal is found on page ids and digests alone, and only the
digests that come more than once are joined to the pages: by broadcast up to
``BROADCAST_ROWS`` of them, so that no payload is shuffled; beyond that, pages
are shuffled by digest once.

Each task writes bundles of its own under fresh names, and the index, written
by Spark, names only those of tasks that ended well; a task that runs again
leaves at most files that nothing refers to.

Defined results
  null html       the empty payload; smaller than ``least``, so a response
  null url        the target URI is left out
  null page_id    a record without page id; such records revisit others but are never the smallest, unless all are null: then all are responses
  repeated rows   rows that repeat the smallest page_id are responses like it, with the same record id
  ties            of rows with one page id, each is a record
  empty table     no bundles, an empty index
  long payloads   a frame holds at least one whole record, however long
  extra columns   not carried
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import shared_path, written

FRAME, BUNDLE = 1 << 18, 64 << 20
#: Fixed values of the Zstandard seekable format: skippable frame, footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
INDEX = "record_id string, page_id long, bundle string, frame int, at int, size int, record_type string"
#: A join side is broadcast only if it has at most so many rows; bytes of records that one reading task takes, about.
BROADCAST_ROWS, PER_TASK = 200_000, 32 << 20


def record_id(page_id: int | None, digest: str) -> str:
    """The URI of the record of a page with that payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:page:{page_id}:sha256:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record with its closing blank lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """page_id, url, record_type, refers_to, digest and payload (None in a revisit) of a record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    revisit = fields["WARC-Type"] == "revisit"
    block = block[: int(fields["Content-Length"])]
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": int(fields["WARC-Page-ID"]) if "WARC-Page-ID" in fields else None,
        "url": url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["WARC-Refers-To-Page-ID"]) if revisit else None,
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": None if revisit else block.partition(b"\r\n\r\n")[2],
    }


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame: compressed and decompressed size of each frame."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file: pa.NativeFile, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the end of a bundle."""
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    file.seek(size - 9 - 8 * n)
    body, out, at = file.read(8 * n), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", body, 8 * i)
        out.append((at, packed, plain))
        at += packed
    return out


class _Bundle:
    def __init__(self, folder: str, fs: pafs.FileSystem):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out, self.frames, self.packer = fs.open_output_stream(f"{folder}/{self.name}", compression=None), [], zstandard.ZstdCompressor(level=3)
        self.size = 0

    def add(self, plain: bytes) -> None:
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain)))
        self.size += len(packed)

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()


def write_bundles(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """Write all rows as records; gives the index. ``folder`` is a URI that all executors reach."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    same = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    same = written(same, "warc-same")
    few = same.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(same) if few else same, "digest", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        bundle, parts, held, index = None, [], 0, []

        def told() -> pa.RecordBatch:
            out = [pa.array(x, t) for x, t in zip(zip(*index, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]
            index.clear()
            return pa.RecordBatch.from_arrays(out, ["record_id", "page_id", "bundle", "frame", "at", "size", "record_type"])

        for batch in batches:
            for key, link, payload, digest, refers in zip(*batch.columns, strict=True):
                if bundle is None:
                    fs.create_dir(path, recursive=True)
                    bundle = _Bundle(path, fs)
                refers = refers.as_py()
                raw = record(key.as_py(), link.as_py(), payload.as_py(), digest.as_py(), refers)
                index.append((record_id(key.as_py(), digest.as_py()), key.as_py(), bundle.name, len(bundle.frames), held, len(raw), "response" if refers is None else "revisit"))
                parts.append(raw)
                held += len(raw)
                if held >= FRAME:
                    bundle.add(b"".join(parts))
                    parts, held = [], 0
                    if bundle.size >= BUNDLE:
                        bundle.close()
                        bundle = None
                        yield told()
        if bundle is not None:
            if parts:
                bundle.add(b"".join(parts))
            bundle.close()
        if index:
            yield told()

    index = written(rows.mapInArrow(write, INDEX), "warc-index")
    return index.withColumn("bundle", F.concat(F.lit(folder + "/"), "bundle"))


def read_records(index: DataFrame) -> DataFrame:
    """Every indexed record, read from its frame: page_id, url, record_type, refers_to, digest, payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, table, frame, plain = None, None, [], None, b""
        unpack = zstandard.ZstdDecompressor()
        types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "digest": pa.string(), "payload": pa.binary()}
        for batch in batches:
            out, size = [], 0
            for bundle, number, at, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bundle != name:
                    fs, path = pafs.FileSystem.from_uri(bundle)
                    name, file, frame = bundle, fs.open_input_file(path), None
                    table = read_seek_table(file, file.size())
                if number != frame:
                    offset, packed, decompressed = table[number]
                    file.seek(offset)
                    frame, plain = number, unpack.decompress(file.read(packed), max_output_size=decompressed)
                out.append(parsed(plain[at : at + length]))
                size += length
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in types.items()], [*types])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in types.items()], [*types])

    # so many tasks as the records' bytes ask for; without a number the few bytes of the index would decide
    total = index.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // PER_TASK))
    places = index.select("bundle", "frame", "at", "size").repartition(tasks, "bundle", F.floor(F.col("frame") / 16)).sortWithinPartitions("bundle", "frame", "at")
    return places.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, digest string, payload binary")


def digest(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's payload is that of the response it names."""
    found = written(records.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha")), "warc-read")
    named = found.where("record_type = 'response'").select(F.col("page_id").alias("to_id"), F.col("sha").alias("to_sha"), F.col("bytes").alias("to_bytes")).distinct()
    revisits = found.where("record_type = 'revisit'")
    joined = revisits.join(named, (revisits.refers_to == named.to_id) & (revisits.digest == named.to_sha), "left")
    own = found.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", "refers_to")
    return own.union(joined.select("page_id", "to_bytes", "to_sha", "record_type", "refers_to"))
