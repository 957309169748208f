"""WARC records in ZIP packages, written once and read back by ranges.

A package is a ZIP file with stored members: archives `archive/*.warc.gz`, in which every record is a
gzip member of its own, and indexes `indexes/*.cdx` or `*.cdxj` (also packed, or `.gz`), which have one line per record:
its key, time, and JSON with file name, offset and length. A reader parses the ZIP directory, then the indexes, then reads
records by their ranges; nothing is extracted. An archive that no index names is read from its beginning on.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm import shared

ARCHIVES, INDEXES = "archive/", "indexes/"
DATA, INDEX = ARCHIVES + "data.warc.gz", INDEXES + "index.cdxj"
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: A package is closed once its records have so many bytes.
PACKAGE_BYTES = 64 << 20
#: Digests of repeated payloads of up to this many rows are broadcast; more are joined by shuffle.
BROADCAST_DIGESTS = 200_000
#: Bytes of an archive without an index that are read at once.
CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, under the names that Hadoop has for object stores as well."""
    for scheme in ("s3a://", "s3n://"):
        if uri.startswith(scheme):
            uri = "s3://" + uri.removeprefix(scheme)
    return fs.FileSystem.from_uri(uri)


# ---- records


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record(kind: str, url: str, page_id: int | None, digest: str, payload: bytes, refers_to: int | None, own_id: str | None = None) -> list[bytes]:
    """One WARC record in pieces, without compression. A revisit refers to the response by its id, which page and digest make."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = [http, payload] if kind == "response" else [http]
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {own_id or record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + target,
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {sum(map(len, block))}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Date: {DATE}", f"Refers-To-Page-ID: {refers_to}"]
    return ["\r\n".join(lines).encode() + b"\r\n\r\n", *block, b"\r\n\r\n"]


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the payload: behind the HTTP head in records that have one, else the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    length = int(fields["content-length"])
    if rest[length : length + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    block = rest[:length]
    return fields, block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def sort_key(url: str) -> str:
    """A URL by its host from behind and its path, in lower case, as indexes are sorted."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.lower().replace(" ", "%20")
    return (",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")).lower().replace(" ", "%20")


# ---- ZIP directories


def _end(file) -> tuple[int, int, int]:
    """Entries, size and offset of the central directory, through ZIP64 where it is used."""
    size = file.size()
    tail = file.read_at(min(size, 22 + 0xFFFF), max(0, size - 22 - 0xFFFF))
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries == 0xFFFF or 0xFFFFFFFF in (length, offset):
        locator = file.read_at(20, size - len(tail) + at - 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        end64 = file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if end64[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of directory")
        entries, length, offset = struct.unpack_from("<QQQ", end64, 32)
    return entries, length, offset


def members(file) -> dict[str, tuple[int, int, int, int]]:
    """Offset of the data, packed and full length and method (0: stored, 8: deflated) of each member, by name."""
    entries, length, offset = _end(file)
    directory, at, found = file.read_at(length, offset), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("a directory entry is broken")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, end = at + 46 + n_name, at + 46 + n_name + n_extra
        while extra + 4 <= end:
            tag, n = struct.unpack_from("<HH", directory, extra)
            if tag == 1:  # ZIP64: only the fields that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", directory, extra + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra += 4 + n
        at = end + n_comment
        if not name.endswith("/"):
            local = file.read_at(30, header)
            if local[:4] != b"PK\3\4":
                raise ValueError("a local header is broken")
            found[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed, full, method)
    return found


def _gunzipped(data: bytes) -> bytes:
    out = []
    while data:
        packer = zlib.decompressobj(wbits=31)
        out.append(packer.decompress(data) + packer.flush())
        data = packer.unused_data
    return b"".join(out)


def _index_lines(file, where: dict) -> Iterator[dict]:
    """The entries of all indexes of a package. An index is small beside its archives and is read whole."""
    for name, (begin, packed, _, method) in where.items():
        if not name.startswith(INDEXES) or not name.removesuffix(".gz").endswith((".cdx", ".cdxj")):
            continue
        data = file.read_at(packed, begin)
        data = zlib.decompress(data, wbits=-15) if method == 8 else data
        for line in (_gunzipped(data) if name.endswith(".gz") else data).splitlines():
            if (at := line.find(b"{")) >= 0 and not line.startswith(b"!"):  # a line without JSON, or of the head, names no record
                yield json.loads(line[at:])


def _scanned(file, begin: int, size: int) -> Iterator[bytes]:
    """The records of a stored archive without an index, one gzip member after the other."""
    packer, out, at = zlib.decompressobj(wbits=31), [], 0
    while at < size:
        data = file.read_at(min(CHUNK, size - at), begin + at)
        at += len(data)
        while data:
            out.append(packer.decompress(data))
            data = packer.unused_data
            if packer.eof:
                yield b"".join(out)
                packer, out = zlib.decompressobj(wbits=31), []
    if out:
        raise ValueError("an archive ends within a record")


def read_package(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a package: those that its indexes name, by range, then those of archives that no index names."""
    where = members(file)
    archives = {name: place for name, place in where.items() if name.startswith(ARCHIVES) and name.endswith((".warc.gz", ".warc"))}
    if any(method for *_, method in archives.values()):
        raise ValueError("an archive is not stored")
    named = set()
    for entry in _index_lines(file, where):
        name = entry.get("filename") or (DATA if DATA in archives else next(iter(archives), DATA))
        name = name if name in archives else ARCHIVES + name
        if name not in archives:
            raise ValueError("an index names an archive that is not there")
        named.add(name)
        begin, size, _, _ = archives[name]
        offset, length = int(entry["offset"]), int(entry["length"])
        if offset + length > size:
            raise ValueError("an index entry leaves the archive")
        raw = file.read_at(length, begin + offset)
        yield parse_record(zlib.decompress(raw, wbits=31) if raw[:2] == b"\x1f\x8b" else raw)
    for name, (begin, size, _, _) in archives.items():
        if name not in named:
            if not name.endswith(".gz"):
                raise ValueError("an archive that is not compressed has no index")
            yield from map(parse_record, _scanned(file, begin, size))


class Package:
    """Writes one package; the index goes behind the records, in the order of its keys."""

    def __init__(self, stream, zip64: bool = True, name: str = ""):
        self.stream, self.at, self.index, self.name, self.ids = stream, 0, [], name, set()
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
        self.zip64, self.data = zip64, self.zip.open(DATA, "w", force_zip64=zip64)

    def own_id(self, page_id: int | None, digest: str) -> str:
        """The id that page and digest make, where a page has one and this is its first record here; else one of this record alone."""
        known = record_id(page_id, digest)
        if page_id is None or known in self.ids:
            return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.name} {len(self.index)}')}>"
        self.ids.add(known)
        return known

    def add(self, pieces: list[bytes], url: str, entry: dict) -> None:
        packer, before = zlib.compressobj(1, wbits=31), self.at
        for piece in (*map(packer.compress, pieces), packer.flush()):
            self.data.write(piece)
            self.at += len(piece)
        entry = {"url": url, **entry, "filename": DATA.removeprefix(ARCHIVES), "offset": str(before), "length": str(self.at - before)}
        self.index.append(f"{sort_key(url)} {DATE[:19].translate(str.maketrans('', '', '-:T'))} {json.dumps(entry)}")

    def close(self) -> None:
        self.data.close()
        with self.zip.open(INDEX, "w", force_zip64=self.zip64) as index:
            for line in sorted(self.index):
                index.write(line.encode("utf-8", "surrogatepass") + b"\n")
        self.zip.close()
        self.stream.close()


# ---- on Spark


def with_revisits(pages: DataFrame, payload: Column) -> DataFrame:
    """page_id, url, payload (binary), digest and refers_to, which is null for responses.

    The smallest page_id of equal payloads is found by a partially aggregated minimum, which payloads do not cross. Its digests are
    few beside the pages and broadcast up to BROADCAST_DIGESTS; the join of more is one that adaptive execution can split where one payload
    has a large share of rows. Null page_ids and repeated rows of the smallest page_id are responses. Null url or payload: empty.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(payload, F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    seen = rows.where(F.length("payload") >= LEAST_REVISIT).groupBy(F.col("digest").alias("seen")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    seen = shared.written(seen.where((F.col("n") > 1) & F.col("first").isNotNull()).select("seen", "first"), "warc-digests")
    return rows.join(F.broadcast(seen) if seen.count() <= BROADCAST_DIGESTS else seen, F.col("digest") == F.col("seen"), "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to")
    )


def write_packages(records: DataFrame, base: str) -> DataFrame:
    """Writes the records to packages under `base`; returns path, n_records and n_bytes of each.

    Every attempt of a task writes files of its own, and the returned table, itself written,
    names those of the attempts that counted. A task holds one record and an index at a time; a payload must stay below 2 GB.
    An empty table gives no packages.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(base)
        files.create_dir(root, recursive=True)
        task, done, package, n = TaskContext.get(), [], None, 0

        def closed():
            package.close()
            done.append((f"{base}/{name}", n, package.at))

        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (column[row].as_py() for column in batch.columns)
                if package is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.wacz"
                    package, n = Package(files.open_output_stream(f"{root}/{name}"), name=f"{base}/{name}"), 0
                kind = "response" if refers_to is None else "revisit"
                pieces = record(kind, url, page_id, digest, payload, refers_to, package.own_id(page_id, digest))
                package.add(pieces, url, {"page_id": page_id, "digest": f"sha256:{digest}", "mime": "text/html" if kind == "response" else "warc/revisit", "status": "200"})
                n += 1
                if package.at >= PACKAGE_BYTES:
                    closed()
                    package = None
        if package is not None:
            closed()
        path, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "n_records", "n_bytes"])

    columns = records.select("page_id", "url", "payload", "digest", "refers_to")
    return shared.written(columns.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_packages(manifest: DataFrame) -> DataFrame:
    """The response and revisit records of the packages named by the column `path`, also of packages made elsewhere; payload is null for revisits.

    Numbers of pages, which only packages of our own have, are null for others; a payload's length and digest are taken from
    it where its record does not give them. Records of other types are left out. No packages: no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = file_system(uri)
                rows, size = [], 0
                with files.open_input_file(path) as file:
                    for fields, payload in read_package(file):
                        kind, number = fields["warc-type"], lambda x, fields=fields: int(fields[x]) if x in fields else None
                        if kind not in ("response", "revisit"):
                            continue
                        whole = kind == "response"
                        length = len(payload) if whole else number("payload-length")
                        digest = fields.get("warc-payload-digest", "" if not whole else hashlib.sha256(payload).hexdigest()).removeprefix("sha256:")
                        rows.append((number("page-id"), fields.get("warc-target-uri"), kind, number("refers-to-page-id"), length, digest, payload if whole else None))
                        size += len(payload)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return manifest.select("path").repartition(shared.partitions(manifest.sparkSession)).mapInArrow(read, RECORD)


def op8_zip_warc(spark, sf_dir):
    """Every page written to packages as response or revisit, and read back from them. Null html: an empty payload."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_packages(with_revisits(pages, F.col("html").cast("binary")), shared.scratch(spark, "warc"))
    records, response = read_packages(manifest), F.col("record_type") == "response"
    return records.select(
        "page_id",
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest"""
