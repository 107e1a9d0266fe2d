"""WARC records in ZIP-packaged archives, read by ranges without extraction.

Writing: every task appends its rows as separately compressed WARC records to a
stored member of a ZIP file in the shared folder, followed by an index of their
offsets; repeated payloads become revisits. Reading: the end of a file leads to its
central directory (or to the ZIP64 one), that to the stored members, the index member
to the records, and each record is one range of the file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm import text as T
from milepost.session import fresh_path

MIN_REVISIT = 1000
ARCHIVE_BYTES = 1 << 28
#: Bytes read at once, and bytes of one file that one task is given at once.
READ_BYTES, BLOCK = 1 << 22, 1 << 23
_DATE = "2000-01-01T00:00:00Z"
_DATA, _INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed values of the ZIP format: signatures, and the largest values of short fields.
_END, _END64, _LOCATOR, _ENTRY = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF

_MANIFEST = "archive string, records bigint, bytes bigint"
_MEMBERS = "archive string, member string, start bigint, size bigint, crc bigint"
_PLACES = "archive string, start bigint, length bigint"
_RECORDS = (
    "id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, intact boolean, payload binary"
)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


# Writing


def with_revisits(rows: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """``rows(id, url, payload)`` with ``digest`` and, for revisits, ``refers_to``.

    Of rows with equal payloads of ``least`` bytes or more, those of the largest id are
    responses and the others refer to them; a null id is the smallest.
    """
    rows = rows.withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("bigint"))
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size")
    groups = groups.agg(F.max("id").alias("last"), F.count("*").alias("n"))
    # Written, so that its size is known: a small one is broadcast, else a payload that
    # very many rows share is split at run time.
    groups = T.stored(groups.where("n > 1").drop("n"), "payloads")
    older = F.col("id").isNull() | (F.col("id") < F.col("last"))
    return rows.join(groups, ["digest", "size"], "left").select(
        "id", "url", "payload", "digest", F.when(older, F.col("last")).alias("refers_to")
    )


def _urn(row: int | None) -> str:
    return f"<urn:row:{'' if row is None else row}>"


def _visible(url: str) -> str:
    """The address with blanks, control characters and other alphabets percent-encoded."""
    return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in url.encode())


def _record(row, url, payload: bytes, digest: str, refers_to) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(row)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([] if url is None else [f"WARC-Target-URI: {_visible(url)}"]),
        *([] if refers_to is None else [
            f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}",
        ]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        "", "",
    ]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _packed(record: bytes) -> bytes:
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gzip.compress(record) + gzip.flush()


class _Archive:
    """One ZIP file being written, front to back."""

    def __init__(self, root: str, name: str):
        self.path = f"{root}/{name}"
        store, place = fs.FileSystem.from_uri(self.path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(place)
        self.zip = zipfile.ZipFile(_Forward(self.out), "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(_DATA), "w", force_zip64=True)
        self.lines: list[bytes] = []
        self.at = 0

    def add(self, row, url, payload, digest, refers_to) -> None:
        body = _packed(_record(row, url, payload, digest, refers_to))
        about = {"filename": _DATA, "offset": self.at, "length": len(body)}
        key = "-" if url is None else _visible(url)
        self.lines.append(f"{key} {_DATE} {json.dumps(about)}\n".encode())
        self.data.write(body)
        self.at += len(body)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        index = zipfile.ZipInfo(_INDEX)
        with self.zip.open(index, "w", force_zip64=True) as out:
            for line in sorted(self.lines):
                out.write(line)
        listed = [{"path": i.filename, "bytes": i.file_size} for i in self.zip.infolist()]
        self.zip.writestr("datapackage.json", json.dumps({"resources": listed}))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return self.path, len(self.lines), size


class _Forward:
    """A stream that cannot go back, for ``zipfile``."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


def _write(root: str, limit: int):
    def run(batches):
        task = TaskContext.get()
        name = f"part-{task.partitionId()}-{task.taskAttemptId()}"
        archive, done = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to")]
            for row in zip(*columns, strict=True):
                if archive is None:
                    archive = _Archive(root, f"{name}-{len(done)}.wacz")
                archive.add(*[v.as_py() for v in row])
                if archive.at >= limit:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        kinds = [pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=_names(_MANIFEST)
        )

    return run


def write(
    rows: DataFrame, root: str | None = None, least: int = MIN_REVISIT, limit: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write a record for each of ``rows(id, url, payload)``; returns ``(archive, records, bytes)``.

    Archives lie in ``root``, a folder that all executors can write to (by default a
    new one in the shared folder), and start anew beyond ``limit`` bytes. A repeated
    task writes files of its own; only those of the finished attempt are returned. A
    null payload is empty; a null url is left out of its record. Repeated rows are
    records each. No rows give no archive. One payload is held in memory at a time.
    """
    root = root or fresh_path(rows.sparkSession, "archives")
    rows = rows.select(
        F.col("id").cast("bigint").alias("id"), "url",
        F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary")).alias("payload"),
    )
    return T.stored(with_revisits(rows, least).mapInArrow(_write(root, limit), _MANIFEST), "manifest")


# Reading


class _File:
    """A file read by ranges."""

    def __init__(self, uri: str):
        store, place = fs.FileSystem.from_uri(uri)
        self.uri, self.file = uri, store.open_input_file(place)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        data = self.file.read_at(length, start)
        if len(data) != length:
            raise ValueError(f"{self.uri}: ends before byte {start + length}")
        return data


def directory(size: int, read: Callable[[int, int], bytes]) -> tuple[int, int, int]:
    """``(start, bytes, entries)`` of the central directory of a ZIP file.

    The end record is searched behind the longest possible comment. Where a ZIP64
    locator stands before it, the ZIP64 end record counts instead.
    """
    first = max(0, size - 22 - _MAX16)
    tail = read(first, size - first)
    at = tail.rfind(_END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = first + at
    locator = read(end - 20, 20) if end >= 20 else b""
    if locator[:4] == _LOCATOR:
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack_from("<QQQ", record, 32)
    elif entries == _MAX16 or _MAX32 in (length, start):
        raise ValueError("no ZIP64 locator")
    return start, length, entries


def _long_fields(extra: bytes, fields: list[int]) -> list[int]:
    """Sizes and offset, taken from the ZIP64 extra field where the short ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return [next(values) if v == _MAX32 else v for v in fields]
        at += 4 + length
    return fields


def members(size: int, read: Callable[[int, int], bytes]) -> Iterator[tuple[str, int, int, int]]:
    """``(name, first byte, size, crc)`` of the stored members of a ZIP file."""
    start, length, entries = directory(size, read)
    data = read(start, length)
    at = 0
    for _ in range(entries):
        if data[at : at + 4] != _ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, whole, n, e, c = struct.unpack_from("<IIIHHH", data, at + 16)
        (local,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n : at + 46 + n + e]
        whole, packed, local = _long_fields(extra, [whole, packed, local])
        if method == 0 and not flags & 1:
            head = read(local, 30)  # its name and extra field may differ in length
            n_local, e_local = struct.unpack_from("<HH", head, 26)
            yield name, local + 30 + n_local + e_local, whole, crc
        at += 46 + n + e + c


def _find_members(batches):
    for batch in batches:
        found = []
        for uri in batch.column("archive").to_pylist():
            file = _File(uri)
            found += [(uri, *m) for m in members(file.size, file.read)]
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 3]
        columns = list(zip(*found, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=_names(_MEMBERS)
        )


def _lines(file: _File, start: int, size: int) -> Iterator[bytes]:
    rest = b""
    for at in range(start, start + size, READ_BYTES):
        *whole, rest = (rest + file.read(at, min(READ_BYTES, start + size - at))).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _find_records(batches):
    """Places of records, from the lines of index members; batches hold whole archives' members."""
    for batch in batches:
        out: list[tuple[str, int, int]] = []
        for uri, found in zip(
            batch.column("archive").to_pylist(), batch.column("members").to_pylist(), strict=True
        ):
            place = {m["member"]: m["start"] for m in found}
            file = _File(uri)
            for m in found:
                if not (m["member"].startswith("indexes/") and m["member"].endswith((".cdx", ".cdxj"))):
                    continue
                for line in _lines(file, m["start"], m["size"]):
                    if b"{" not in line:  # a header line
                        continue
                    about = json.loads(line[line.index(b"{") :])
                    name = about["filename"]
                    base = place.get(name, place.get(f"archive/{name}"))
                    if base is None:
                        raise ValueError(f"{uri}: no stored member {name}")
                    out.append((uri, base + int(about["offset"]), int(about["length"])))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)],
            names=_names(_PLACES),
        )


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _number(urn: str | None) -> int | None:
    got = (urn or "").strip("<>").removeprefix("urn:row:")
    return int(got) if got else None


def parse(record: bytes) -> tuple:
    """One record's columns. Of a revisit, size and digest are those of what it refers to."""
    head, _, rest = record.partition(b"\r\n\r\n")
    about = _fields(head)
    block = rest[: int(about["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = base64.b32decode(about["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(_fields(http)["content-length"])
    common = _number(about["warc-record-id"]), about.get("warc-target-uri"), about["warc-type"]
    if about["warc-type"] == "revisit":
        return (*common, _number(about.get("warc-refers-to")), size, told, True, None)
    digest = hashlib.sha1(payload).hexdigest()
    return (*common, None, len(payload), digest, (len(payload), digest) == (size, told), payload)


def _read_records(with_payload: bool):
    def run(batches):
        file, held, first = None, b"", 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            places = list(zip(*[batch.column(c).to_pylist() for c in _names(_PLACES)], strict=True))
            for k, (uri, start, length) in enumerate(places):
                if file is None or file.uri != uri:
                    file, held, first = _File(uri), b"", 0
                if not first <= start <= start + length <= first + len(held):
                    # Neighbouring records come with one read.
                    stop = start + length
                    for other, a, n in places[k + 1 :]:
                        if other != uri or a != stop or stop + n - start > READ_BYTES:
                            break
                        stop += n
                    held, first = file.read(start, stop - start), start
                body = held[start - first : start - first + length]
                row = parse(zlib.decompress(body, 31))
                for column, v in zip(out, row if with_payload else (*row[:-1], None), strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(),
                     pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=_names(_RECORDS)
            )

    return run


def listing(archives: DataFrame) -> DataFrame:
    """``(archive, member, start, size, crc)``: the stored members of ``archives(archive)``."""
    return archives.select("archive").mapInArrow(_find_members, _MEMBERS)


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of ``archives(archive)``.

    ``id, url, record_type, refers_to, payload_bytes, payload_digest, intact, payload``:
    size and digest of a response are measured on what was read, and ``intact`` tells
    whether its headers say the same; those of a revisit are the full payload's, by its
    headers. A revisit has a null payload, as have all without ``with_payload``. An
    archive without index members has no records; a broken one is an error.
    """
    few = F.collect_list(F.struct("member", "start", "size")).alias("members")
    of = listing(archives).groupBy("archive").agg(few)  # a handful of members each
    places = T.stored(of.mapInArrow(_find_records, _PLACES), "places")
    # Places are small and payloads are not: tasks are counted by the bytes to be read.
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, total // (8 * BLOCK) + 1)
    dealt = places.repartition(int(tasks), "archive", F.expr(f"start div {BLOCK}"))
    ordered = dealt.sortWithinPartitions("archive", "start")
    return ordered.mapInArrow(_read_records(with_payload), _RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records of :func:`read` with the payloads of revisits filled in.

    A revisit of what is not among the records keeps a null payload.
    """
    columns = records.columns
    responses = records.where("record_type = 'response' AND id IS NOT NULL AND payload IS NOT NULL")
    found = responses.groupBy(F.col("id").alias("refers_to"), "payload_digest")
    found = found.agg(F.first("payload").alias("_payload"))
    rows = records.join(found, ["refers_to", "payload_digest"], "left")
    return rows.withColumn("payload", F.coalesce("payload", "_payload")).select(*columns)


def report(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)``, read them back: one row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A null html is
    an empty payload; repeated rows and rows without page_id are records each; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(
        F.col("page_id").alias("id"), "url", F.col("html").cast("binary").alias("payload")
    )
    return read(write(rows, root), with_payload=False).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def oracle(least: int = MIN_REVISIT) -> str:
    """The report as SQL."""
    return f"""
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d
        FROM pages),
    g AS (SELECT n, d, max(page_id) AS last FROM p WHERE n >= {least} GROUP BY n, d),
    r AS (
        SELECT p.*, CASE WHEN page_id IS NULL OR page_id < last THEN last END AS refers_to
        FROM p LEFT JOIN g USING (n, d))
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
           CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
    FROM r
    """


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table, with this package's settings applied."""
    return T.configure(spark).read.parquet(f"{sf_dir}/pages.parquet")
