"""WARC archives: written with one gzip member a record, and read in sequence.

Writing: pages whose payloads are equal, and long enough, are stored once; the others are `revisit` records that refer to
it. Payloads are told by SHA-256. Tasks write whole files into the shared folder and report them; only reported files
count, so what a lost or repeated task leaves behind is never read.

Reading: a file is decompressed piece by piece with zlib, member by member. A record's header gives its length, which
frames its block; the digests of block and payload are worked out on the way and compared with those stated. A task
holds one piece of the file and the header, and a payload only where it is asked for, however long the file is. After
a damaged record reading goes on at the next member that begins a record.

Defined cases: null html is an empty payload; a null url gives no target; control and white space characters of a url
are percent-encoded; a null page_id gives no page and ranks below all others; of rows with equal payload and equal page_id one is the response and the others revisit
it; an empty table gives an empty manifest and result; other columns are never read. A damaged member, one that holds
anything but one record, a length or digest that does not fit, or a header over HEADER bytes gives a row with `error`.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import scratch_path, small_batches, steps, written

#: Payloads of fewer bytes are always stored.
LEAST = 1000

#: Compressed bytes from which on a task starts another file; bytes read or decompressed at a time; longest header.
ARCHIVE, PIECE, HEADER = 128 << 20, 1 << 16, 1 << 20

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "file string, records long, bytes long"
RECORD = (
    "file string, offset long, length long, type string, record_id string, date string, uri string, page_id long, refers_to string, "
    "payload_bytes long, payload_digest string, verified boolean, payload binary, error string"
)


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path, which may have a scheme, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pyarrow.fs.LocalFileSystem(), path)


# --- writing ----------------------------------------------------------------------------------------------------------


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{row}')}>"


def member(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as a gzip member of its own. Fields without a value are left out."""
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("WARC-Block-Digest", sha1(block)), ("Content-Length", str(len(block)))] if value is not None)
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + press.flush()


def page_member(row: int, page_id: int | None, url: str | None, size: int, digest: str, refers: int | None, html: str | None) -> bytes:
    """The response of a page, or the revisit record of the row that it refers to: the head of the answer without its payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = None if url is None else re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", record_id(row)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Profile", None if refers is None else PROFILE),
        ("WARC-Refers-To", None if refers is None else record_id(refers)),
        ("Page-ID", None if page_id is None else str(page_id)),
    ]
    return member(fields, head + (html or "").encode("utf-8", "surrogatepass") if refers is None else head)


class Files:
    """The files that one task writes."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.out, self.done = folder, most, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            file = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            store, path = opened(file)
            store.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = store.open_output_stream(path, compression=None)
            self.done.append([file, 0, 0])
            self.add(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.out.write(data)
        self.done[-1][1] += 1
        self.done[-1][2] += len(data)
        if self.done[-1][2] >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def numbered(pages: DataFrame) -> DataFrame:
    """row, page_id, url, html: row is a unique long, page_id itself where ids are neither null nor repeated."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    odd = rows.groupBy("page_id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col("page_id").isNull())
    if odd.isEmpty():
        return rows.withColumn("row", F.col("page_id"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-pages")


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """row, page_id, url, size, digest, refers (the row whose payload a revisit repeats), html (null for revisits)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    size = F.octet_length(payload).cast("long")
    rows = numbered(pages).withColumn("size", size)
    # Short payloads get keys of their own: they meet nothing, wherever they go.
    rows = rows.withColumn("told", F.when(F.col("size") >= least, F.sha2(payload, 256)).otherwise(F.col("row").cast("string")))
    groups = rows.filter(F.col("size") >= least).groupBy("told").agg(F.max(F.struct("page_id", "row")).alias("kept"), F.count("*").alias("n"))
    kept = written(groups.filter("n > 1").select(F.col("told").alias("k_told"), F.col("kept.row").alias("kept")), "kept-payloads")
    joined = rows.join(kept, F.col("told") == F.col("k_told"), "left")
    refers = F.when(F.col("kept") != F.col("row"), F.col("kept"))
    return joined.select("row", "page_id", "url", "size", F.sha1(payload).alias("digest"), refers.alias("refers"), F.when(refers.isNull(), F.col("html")).alias("html"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, most: int = ARCHIVE) -> DataFrame:
    """Writes pages(page_id, url, html) as WARC files into folder, a new one of the shared folder by default -> the manifest: file, records, bytes."""
    spark = pages.sparkSession
    at = folder or scratch_path(spark, "warc")
    out = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        files = Files(at, most)
        for batch in batches:
            for lo, n in steps(batch.column("html")):
                for row in batch.slice(lo, n).to_pylist():
                    files.add(page_member(**row))
        files.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*files.done, strict=True), out, strict=True)] if files.done else [pa.array([], f.type) for f in out], schema=out)

    small_batches(spark)
    return written(planned(pages, least).mapInArrow(run, MANIFEST), "warc-manifest")


# --- reading ----------------------------------------------------------------------------------------------------------


class Damage(Exception):
    """What is wrong with a record."""


class Members:
    """A file's gzip members, decompressed as they are asked for."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.offset, self.waiting, self.out, self.unzip = raw, 0, b"", bytearray(), None

    def seek(self, offset: int) -> None:
        self.raw.seek(offset)
        self.offset, self.waiting = offset, b""

    def more(self) -> bytes:
        """Some bytes of the file that no member has used."""
        data, self.waiting = self.waiting or self.raw.read(PIECE), b""
        self.offset += len(data)
        return data

    def begin(self) -> bool:
        """Starts the next member; False at the end of the file."""
        self.waiting = self.waiting or self.raw.read(PIECE)
        self.unzip, self.out = zlib.decompressobj(31), bytearray()
        return bool(self.waiting)

    def fill(self) -> bool:
        """Adds at most a piece to `out`; False once the member has ended."""
        while not self.unzip.eof:
            data = self.unzip.unconsumed_tail or self.more()
            try:
                got = self.unzip.decompress(data, PIECE)
            except zlib.error as e:
                raise Damage(f"damaged member: {e}") from None
            if self.unzip.eof:  # what follows belongs to the next member
                self.waiting = self.unzip.unused_data + self.waiting
                self.offset -= len(self.unzip.unused_data)
            self.out += got
            if got:
                return True
            if not data and not self.unzip.eof:
                raise Damage("the file ends inside a member")
        return False

    def until(self, mark: bytes) -> bytes:
        """What stands before the next mark, with it."""
        seen = 0
        while (at := self.out.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.out)
            if seen > HEADER:
                raise Damage("the header is too long")
            if not self.fill():
                raise Damage("the header does not end")
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        got = bytes(self.out[:n])
        del self.out[:n]
        return got

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.out and not self.fill():
                raise Damage("the record is shorter than its Content-Length")
            got = self.take(min(n, len(self.out)))
            n -= len(got)
            yield got

    def next_start(self, offset: int) -> int | None:
        """Where the next member that begins a record starts, from offset on."""
        self.seek(offset)
        data, at = b"", offset
        while piece := self.raw.read(PIECE):
            data += piece
            found = data.find(MAGIC)
            while found >= 0:
                self.raw.seek(at + found)
                try:
                    if zlib.decompressobj(31).decompress(self.raw.read(512), 5) == b"WARC/":
                        self.seek(at + found)
                        return at + found
                except zlib.error:
                    pass
                found = data.find(MAGIC, found + 1)
            at, data = at + len(data) - 2, data[-2:]
            self.raw.seek(at + 2)
        return None


def header_fields(head: bytes) -> dict[str, str]:
    """Names, lower-cased, and values; lines that begin with white space go on with the line before."""
    lines = re.sub(rb"\r\n[\x20\t]+", b" ", head).decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, sep, value in (line.partition(":") for line in lines) if sep}


def hex_digest(stated: str | None) -> str | None:
    """A stated SHA-1 in hex or base 32 as hex; None where there is none."""
    kind, _, text = (stated or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return text.lower() if re.fullmatch("[0-9A-Fa-f]{40}", text) else base64.b32decode(text.upper()).hex()
    except ValueError:
        raise Damage(f"no digest: {stated}") from None


def read_record(members: Members, keep: bool) -> dict[str, Any]:
    """The record that the member which has begun holds."""
    head = members.until(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise Damage("no WARC record")
    fields = header_fields(head)
    if not re.fullmatch("[0-9]+", length := fields.get("content-length", "")):
        raise Damage("no Content-Length")
    block, payload, size, kept, answer = hashlib.sha1(), hashlib.sha1(), 0, [], bytearray()
    http = fields.get("content-type", "").startswith("application/http")
    inside = not http
    for piece in members.pieces(int(length)):
        block.update(piece)
        if not inside:
            answer += piece
            at = answer.find(b"\r\n\r\n")
            if at < 0:
                if len(answer) > HEADER:
                    raise Damage("the header of the answer is too long")
                continue
            inside, piece, answer = True, bytes(answer[at + 4 :]), answer[: at + 4]
        payload.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    if b"".join(members.pieces(4)) != b"\r\n\r\n":
        raise Damage("the record is longer than its Content-Length")
    while not members.out and members.fill():
        pass
    if members.out:
        raise Damage("the member holds more than one record")
    stated, kind = hex_digest(fields.get("warc-payload-digest")), fields.get("warc-type")
    revisit = kind == "revisit"
    if hex_digest(fields.get("warc-block-digest")) not in (None, block.hexdigest()):
        raise Damage("the block's digest differs")
    if not revisit and stated not in (None, payload.hexdigest()):
        raise Damage("the payload's digest differs")
    if revisit:  # the head of the answer says how long the payload is
        told = header_fields(bytes(answer)).get("content-length", "")
        size = int(told) if re.fullmatch("[0-9]+", told) else None
    page = fields.get("page-id", "")
    return {
        "type": kind, "record_id": fields.get("warc-record-id"), "date": fields.get("warc-date"), "uri": fields.get("warc-target-uri"),
        "page_id": int(page) if re.fullmatch("-?[0-9]+", page) else None, "refers_to": fields.get("warc-refers-to"), "payload_bytes": size,
        "payload_digest": stated if revisit else payload.hexdigest(), "verified": "warc-block-digest" in fields, "payload": b"".join(kept) if keep and not revisit else None,
    }


def records_of(raw: BinaryIO, keep: bool = False) -> Iterator[dict[str, Any]]:
    """All records of a file in sequence, each with its offset and compressed length; a damaged one has `error`."""
    members = Members(raw)
    while True:
        start = members.offset
        try:
            if not members.begin():
                return
            found = read_record(members, keep)
            yield {"offset": start, "length": members.offset - start} | found
        except Damage as e:
            after = members.next_start(start + 1)
            yield {"offset": start, "error": str(e)}
            if after is None:
                return


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """manifest(file) -> RECORD's columns, a row a record; payload is null unless asked for. A file is read by one task."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    out = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], out.field(c).type) for c in names], schema=out)

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = opened(file)
                rows, held = [], 0
                with store.open_input_file(path) as raw:
                    for record in records_of(raw, payloads):
                        rows.append(record | {"file": file})
                        held += len(record.get("payload") or b"") + 500
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(run, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """The responses and revisits among written records, with refers_page, the page that a revisit repeats. A revisit whose record is missing or has another digest gets an `error`."""
    pages = records.filter(F.col("type").isin("response", "revisit") & F.col("error").isNull())
    stored = pages.filter("type = 'response'").select(F.col("record_id").alias("s_id"), F.col("page_id").alias("refers_page"), F.col("payload_digest").alias("s_digest"))
    again = pages.filter("type = 'revisit'").join(stored, F.col("refers_to") == F.col("s_id"), "left")
    error = F.when(F.col("s_id").isNull(), "nothing to refer to").when(~F.col("s_digest").eqNullSafe(F.col("payload_digest")), "another payload")
    return pages.filter("type = 'response'").withColumn("refers_page", F.lit(None).cast("long")).unionByName(again.withColumn("error", error).drop("s_id", "s_digest"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives pages and reads the archives back -> page_id, payload_bytes, payload_digest, record_type, refers_to. Fails where a record is damaged."""
    records = written(read_archives(write_archives(pages)), "warc-records")
    rows = resolved(records.drop("payload"))
    damage = F.raise_error(F.concat(F.lit("damaged record: "), F.col("error")))
    return rows.select("page_id", "payload_bytes", F.when(F.col("error").isNull(), F.col("payload_digest")).otherwise(damage).alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_page").alias("refers_to"))
