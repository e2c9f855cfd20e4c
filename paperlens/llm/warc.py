"""WARC archives with a two-level capture index.

``write`` stores one gzip member per record in archive files and sorts the captures by reversed-host URL
key into index files: compressed blocks of captures, and behind them a sparse directory with the first key of
each block. ``find`` looks keys up: binary search among the first keys of the index files, then in a
file's directory, then in one block, each read by range. ``read`` fetches the records by range reads in file order.

Files go to a folder that all executors share, under names of their own per attempt: a task that is
run again leaves an unused file. The folder also holds the captures of finished tasks, as Parquet, and a manifest of the
index files of finished tasks, so another session opens an archive by its folder and sees no unused file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlens.llm.arrow import steps
from paperlens.llm.store import opened
from paperlens.operators.frames import broadcast_if_small
from paperlens.session import checkpointed, ensure_checkpoint_dir

# Payloads of fewer bytes are stored every time.
REVISIT_BYTES = 1_000
FILE_BYTES = 256_000_000
BLOCK_CAPTURES = 256
# Records of one archive file that are this near are fetched by one read.
READ_GAP, READ_BYTES = 16_384, 4_000_000
# Bytes of an archive file that one task of a read starts with.
RANGE_BYTES = 16_000_000
DATE = "1970-01-01T00:00:00Z"
MANIFEST, CAPTURES = "manifest.json", "captures"
_LEVEL = 3


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query; scheme, www and fragment do not count."""
    rest = (url or "").partition("#")[0]
    rest = rest.partition("://")[2] or rest
    cut = min((at for at in (rest.find("/"), rest.find("?")) if at >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:] or "/"
    name, _, port = host.partition(":")
    labels = name.removeprefix("www.").split(".")
    key = ",".join(reversed(labels)) + (f":{port}" if port else "") + ")" + path
    return "".join(c if c > " " else f"%{ord(c):02x}" for c in key)


def coded(number: str | None) -> str:
    """A page's number for a line of a header or the index: white space and control characters escaped, null
    as nothing, the empty text as a bare percent sign."""
    if number is None:
        return ""
    return "".join(c if c > " " and c != "%" else f"%{ord(c):02x}" for c in number) or "%"


def decoded(code: str) -> str | None:
    return None if code == "" else "" if code == "%" else unquote(code)


def record_id(number: str | None, digest: str) -> str:
    """Follows from page and payload, so revisits can name the record they refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{coded(number)} {digest}')}>"


def _member(lines: list[str], content: bytes) -> bytes:
    head = "\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(content)}"]).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(content + b"\r\n\r\n") + packer.flush()


def record(number: str | None, url: str, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One record as a gzip member: a response, or a revisit of the page ``refers_to`` with the same payload."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = record_id(number, digest) if refers_to is None else f"<urn:uuid:{uuid.uuid4()}>"
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {own}", f"WARC-Date: {date}",
        "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02x}" for c in url),
        f"WARC-Payload-Digest: {digest}", f"Page-Number: {coded(number)}", f"Payload-Length: {len(payload)}",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    if refers_to is None:
        return _member([*lines, "Content-Type: application/http; msgtype=response"], http.encode() + payload)
    profile = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
    return _member([*lines, f"WARC-Profile: {profile}", f"WARC-Refers-To: {record_id(refers_to, digest)}",
                    f"Refers-To-Page: {coded(refers_to)}",
                    "Content-Type: application/http; msgtype=response"], http.encode())


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record; a response whose payload does not fit its digest is an error."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    content = rest[:int(fields["Content-Length"])]
    payload = content.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response":
        digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != fields["WARC-Payload-Digest"]:
            raise ValueError(f"damaged record of {fields['WARC-Target-URI']}")
    return fields, payload


class _Files:
    """A few open files of a folder, read by range."""

    def __init__(self, folder: str, most: int = 16) -> None:
        self.system, self.path = opened(folder)
        self.most, self.open = most, {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.system.open_input_file(f"{self.path}/{name}")
        file = self.open[name]
        file.seek(offset)
        return file.read(length)


@dataclass
class Archive:
    """A written folder: its captures, per index file the first key and the place of its directory, and its bytes."""

    folder: str
    captures: DataFrame
    index: list[tuple[str, str, int, int]]
    size: int

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "Archive":
        """The archive that ``write`` has left in a folder, in whatever session."""
        system, path = opened(folder)
        with system.open_input_file(f"{path}/{MANIFEST}") as file:
            known = json.loads(file.read())
        captures = spark.read.schema(_CAPTURE).parquet(f"{folder}/{CAPTURES}")
        return cls(folder, captures, [tuple(row) for row in known["index"]], known["size"])


_CAPTURE = "url_key string, number string, file string, offset long, length long"


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url",
          html: str = "html") -> Archive:
    """Write one record per row of ``pages`` and the index of the captures.

    Payloads are the html in UTF-8, null counting as empty. Of equal payloads of ``REVISIT_BYTES`` or
    more the rows with the largest ``key`` are responses, the others revisits of it; a null key
    is smaller than any, and where all are null all rows are responses. Repeated rows are records of their
    own. A null url counts as empty. Keys of any type are kept as text, with white space and control characters
    escaped in the files; a null key is another than the empty text. A very long html is one record, held
    whole by one task. ``folder`` is a new folder in that of ``spark.checkpoint.dir`` by default.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark)
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(f"`{key}`").alias("number"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"),
        F.col(f"`{html}`").alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"),
    )
    # Narrow: only payloads that occur again have a row.
    again = (
        rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size")
        .agg(F.max("number").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "first")
    )
    revisit = F.when(F.col("first").isNotNull() & ~F.col("number").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(broadcast_if_small(checkpointed(again)), ["digest", "size"], "left").select(
        F.col("number").cast("string").alias("number"), "url", "html", revisit.cast("string").alias("refers_to"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        system, path = opened(folder)
        file, name, offset = None, "", 0
        for batch in steps(batches, "html"):
            found = []
            for number, url_, text, refers in zip(*(batch.column(c).to_pylist() for c in (
                    "number", "url", "html", "refers_to")), strict=True):
                if file is None or offset > FILE_BYTES:
                    if file is not None:
                        file.close()
                    name, offset = f"archive-{uuid.uuid4().hex}.warc.gz", 0
                    file = system.open_output_stream(f"{path}/{name}", compression=None)
                member = record(number, url_, (text or "").encode(), refers)
                file.write(member)
                found.append((url_key(url_), number, name, offset, len(member)))
                offset += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[at] for f in found], kind) for at, kind in enumerate(
                    (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))],
                ["url_key", "number", "file", "offset", "length"])
        if file is not None:
            file.close()

    rows.mapInArrow(store, _CAPTURE).write.parquet(f"{folder}/{CAPTURES}")
    captures = spark.read.schema(_CAPTURE).parquet(f"{folder}/{CAPTURES}")
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    known = {"index": _write_index(captures, folder), "size": size}
    # Last, so a folder without a manifest is one that has not been finished.
    with system.open_output_stream(f"{path}/{MANIFEST}", compression=None) as file:
        file.write(json.dumps(known).encode())
    return Archive.open(spark, folder)


def new_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def _write_index(captures: DataFrame, folder: str) -> list[tuple[str, str, int, int]]:
    """Sorted index files; one (first key, file, place and length of the directory) per file."""
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        file, name, offset, directory, held = None, f"index-{uuid.uuid4().hex}", 0, [], []

        def block() -> None:
            nonlocal file, offset
            if not held:
                return
            if file is None:
                file = system.open_output_stream(f"{path}/{name}", compression=None)
            data = zlib.compress("\n".join("\t".join(map(str, row)) for row in held).encode(), _LEVEL)
            file.write(data)
            directory.append(f"{held[0][0]}\t{offset}\t{len(data)}")
            offset += len(data)
            held.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("url_key", "number", "file", "offset", "length")]
            for key, number, *place in zip(*columns, strict=True):
                held.append((key, coded(number), *place))
                if len(held) >= BLOCK_CAPTURES:
                    block()
        block()
        if file is not None:
            data = zlib.compress("\n".join(directory).encode(), _LEVEL)
            file.write(data)
            file.close()
            row = [directory[0].split("\t")[0], name, offset, len(data)]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["first", "file", "offset", "length"])

    ordered = captures.repartitionByRange("url_key", "number", "offset").sortWithinPartitions("url_key", "number", "offset")
    files = checkpointed(ordered.mapInArrow(store, "first string, file string, offset long, length long"))
    # One row per index file.
    return sorted(tuple(row) for row in files.collect())


class Index:
    """Looks up captures; keeps the directories and the last blocks it has read."""

    def __init__(self, folder: str, index: list[tuple[str, str, int, int]]) -> None:
        self.files, self.index = _Files(folder), index
        self.firsts = [row[0] for row in index]
        self.directories: dict[str, list[tuple[str, int, int]]] = {}
        self.blocks: dict[tuple[str, int], list[list[str]]] = {}

    def _directory(self, at: int) -> list[tuple[str, int, int]]:
        _, name, offset, length = self.index[at]
        if name not in self.directories:
            if len(self.directories) >= 16:
                self.directories.clear()
            lines = zlib.decompress(self.files.read(name, offset, length)).decode().split("\n")
            rows = [line.split("\t") for line in lines]
            self.directories[name] = [(key, int(start), int(size)) for key, start, size in rows]
        return self.directories[name]

    def _block(self, name: str, start: int, size: int) -> list[list[str]]:
        if (name, start) not in self.blocks:
            if len(self.blocks) >= 64:
                self.blocks.clear()
            lines = zlib.decompress(self.files.read(name, start, size)).decode().split("\n")
            self.blocks[name, start] = [line.split("\t") for line in lines]
        return self.blocks[name, start]

    def captures(self, key: str) -> Iterator[list[str]]:
        """url_key, number, file, offset and length of every capture of a key."""
        # Captures of a key may begin in the file and the block before the first that starts with it.
        for at in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            directory = self._directory(at)
            firsts = [row[0] for row in directory]
            for _, start, size in directory[max(0, bisect_left(firsts, key) - 1):bisect_right(firsts, key)]:
                rows = self._block(self.index[at][1], start, size)
                keys = [row[0] for row in rows]
                yield from rows[bisect_left(keys, key):bisect_right(keys, key)]


def find(archive: Archive, wanted: DataFrame, url: str = "url") -> DataFrame:
    """(url_key, number, file, offset, length) of every capture of the urls in ``wanted``.

    Each different key is looked up once, in sorted order, so neighbouring keys share blocks. Unknown
    urls have no rows; a null url is the empty one.
    """
    folder, index = archive.folder, archive.index

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())], ["url_key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = [], None
        for batch in batches:
            for key in batch.column("url_key").to_pylist():
                known = known or Index(folder, index)
                for row in known.captures(key):
                    found.append(row)
                    if len(found) >= 10_000:
                        yield table(found)
                        found = []
        yield table(found)

    def table(rows: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.string()), pa.array([decoded(r[1]) for r in rows], pa.string()),
            pa.array([r[2] for r in rows], pa.string()), pa.array([int(r[3]) for r in rows], pa.int64()),
            pa.array([int(r[4]) for r in rows], pa.int64())], ["url_key", "number", "file", "offset", "length"])

    keyed = wanted.select(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url")).mapInArrow(
        keys, "url_key string").distinct()
    ordered = keyed.repartitionByRange("url_key").sortWithinPartitions("url_key")
    return ordered.mapInArrow(search, "url_key string, number string, file string, offset long, length long")


def read(archive: Archive, found: DataFrame, payloads: bool = False) -> DataFrame:
    """The records at the places in ``found``: number, url, payload_bytes, payload_digest (hex SHA-1), record_type,
    refers_to and, if asked for, payload (null for revisits). Neighbours in a file are fetched together; tasks
    are as many as the bytes of the archive need, and each gets ranges of files.
    """
    folder = archive.folder
    kinds = {"number": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.string(), "payload": pa.binary()}
    names = [n for n in kinds if payloads or n != "payload"]

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        files, run = None, []

        def members() -> Iterator[bytes]:
            start, end = run[0][1], max(offset + length for _, offset, length in run)
            data = files.read(run[0][0], start, end - start)
            yield from (data[offset - start:offset - start + length] for _, offset, length in run)

        for batch in batches:
            files = files or _Files(folder)
            for place in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if run and (place[0] != run[-1][0] or place[1] > run[-1][1] + run[-1][2] + READ_GAP
                            or place[1] + place[2] - run[0][1] > READ_BYTES):
                    yield from members()
                    run = []
                run.append(place)
        if run:
            yield from members()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[at] for r in rows], kinds[n]) for at, n in enumerate(names)], names)

        for member in fetched(batches):
            fields, payload = parsed(member)
            response = fields["WARC-Type"] == "response"
            digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            rows.append((
                decoded(fields["Page-Number"]), fields["WARC-Target-URI"],
                len(payload) if response else int(fields["Payload-Length"]), digest, fields["WARC-Type"],
                decoded(fields.get("Refers-To-Page", "")), payload if response else None))
            size += len(payload) if payloads else 0
            if len(rows) >= 2_000 or size > 16_000_000:
                yield batch_of()
                rows, size = [], 0
        yield batch_of()

    schema = ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'binary' if n == 'payload' else 'string'}" for n in names)
    tasks = max(found.sparkSession.sparkContext.defaultParallelism, -(-archive.size // RANGE_BYTES))
    part = F.expr(f"offset div {RANGE_BYTES}")
    ordered = found.select("file", "offset", "length").repartition(tasks, "file", part).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(load, schema)
