"""WARC archives with the index first.

Tasks write gzip archives, one member per record, and give back one index row per record: file, offset, length, URL, digest. Readers
select from the index, sort it by file and offset and join neighbouring byte ranges into one read each.

Payloads are compared by SHA-1; only the row with the smallest id of equal payloads is stored, the others become revisit records.
Archives are written through a file system of pyarrow, so a folder can be local, HDFS or an object store. A task that is run again
writes a file of its own; the index names the files that count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftfield.operators.ranks import join_per_key
from driftfield.session import cut_lineage, scratch_path

MAX_FILE_BYTES = 1 << 30
GAP_BYTES = 1 << 16
READ_BYTES = 8 << 20
TASK_BYTES = 16 << 20
#: A record's head is no longer than this.
HEAD_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string, refers_to bigint"
_SAFE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%")


_OWN = re.compile(r"<urn:page:(-?\d*)>")


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id_of(record_id: str | None) -> int | None:
    m = _OWN.fullmatch(record_id or "")
    return int(m[1]) if m and m[1] else None


def build_record(page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit that has the HTTP head alone. URLs are percent-encoded where a header could not hold them."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with a space goes on with the one before. Of repeated names the first counts."""
    fields: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            fields.setdefault(name, value.strip())
    return fields


def parse_record(raw: bytes) -> dict:
    """Fields of one uncompressed record of any type and of WARC 0.17 to 1.1.

    Raises ValueError for what is not a whole record, and for a whole payload that has another SHA-1 than it says. ``payload`` is what follows
    the HTTP head in HTTP records and the block in others; null for revisits, whose ``payload_bytes`` are what their HTTP head says (0 if
    it says nothing). Records without a digest get that of their payload.
    """
    first, _, rest = raw.partition(b"\r\n")
    head, _, rest = rest.partition(b"\r\n\r\n")
    fields = _headers(head)
    if not first.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
        raise ValueError("not a record")
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]) or rest[len(block) :].strip(b"\r\n"):
        raise ValueError("not a whole record")
    kind = fields.get("warc-type", "").lower()
    http: dict[str, str] = {}
    payload = block
    if fields.get("content-type", "").lower().startswith("application/http") or (kind == "revisit" and block.startswith(b"HTTP/")):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(top.partition(b"\r\n")[2])
    said = fields.get("warc-payload-digest", "")
    digest = said[5:].upper() if said.lower().startswith("sha1:") else None
    whole = kind != "revisit" and "warc-truncated" not in fields
    if kind != "revisit":
        size, own = len(payload), base32_sha1(payload)
        # a digest of transfer-encoded content is not that of the bytes stored
        if digest and whole and len(digest) == 32 and digest != own and "transfer-encoding" not in http:
            raise ValueError("payload and digest differ")
        digest = digest or own
    else:
        size = int(http.get("content-length", "0")) if http.get("content-length", "0").isdigit() else 0
    url = fields.get("warc-target-uri")
    ours = _OWN.fullmatch(fields.get("warc-record-id", ""))
    return {
        "page_id": _id_of(fields.get("warc-record-id")), "url": unquote(url) if url and ours else url and url.strip("<>"), "record_type": kind, "refers_to": _id_of(fields.get("warc-refers-to")),
        "payload_digest": digest, "payload_bytes": size, "payload": None if kind == "revisit" else payload,
        "record_id": fields.get("warc-record-id"), "refers_to_id": fields.get("warc-refers-to"), "date": fields.get("warc-date"),
    }


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` with ``_sha1`` and, for rows that become revisits, ``_first``: the smallest page_id of equal payloads.

    Payloads below ``least`` bytes are never revisits. Only ids and digests meet by digest; the texts meet their decision by id.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("_sha1"))
    narrow = pages.select("page_id", F.sha1(html).alias("_sha1"), F.octet_length(html).alias("n")).where(F.col("n") >= least)
    firsts = narrow.groupBy("_sha1").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1 and _first is not null").drop("n")
    revisits = join_per_key(narrow.drop("n"), firsts, "_sha1").where("not (page_id <=> _first)").distinct()
    revisits = revisits.select(F.coalesce("page_id", F.lit(-1)).alias("_id"), F.col("_sha1").alias("_digest"), "_first", F.col("page_id").isNull().alias("_none"))
    same = (F.coalesce(keyed["page_id"], F.lit(-1)) == revisits["_id"]) & (keyed["_sha1"] == revisits["_digest"]) & (keyed["page_id"].isNull() == revisits["_none"])
    return keyed.join(revisits, same, "left").select("page_id", "url", "payload", "_sha1", "_first")


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record for every row of ``pages(page_id, url, html)`` and return the index, itself written as a table.

    Null html is an empty payload; a null URL gives no target header. Rows that repeat an id give a record each; where they hold the
    smallest id of their payload, all of them are responses. An empty table gives no file and an empty index.
    """
    system, root = pafs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = {k: [] for k in ("file", "offset", "length", "url", "digest", "page_id", "record_type", "refers_to")}
            for page_id, url, payload, sha1, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "_sha1", "_first"))):
                if out is None or at >= MAX_FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = _member(build_record(page_id, url, digest, payload, first, first is not None))
                out.write(member)
                for key, value in zip(rows, (name, at, len(member), url, digest, page_id, "response" if first is None else "revisit", first)):
                    rows[key].append(value)
                at += len(member)
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], list(rows))
        if out is not None:
            out.close()

    return cut_lineage(decide(pages, least).mapInArrow(run, _INDEX))


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Join sorted (file, offset, length) into reads: (file, start, end, records). A record read twice is one read."""
    file, start, end, held = None, 0, 0, []
    for name, offset, length in rows:
        if held and (name != file or offset - end > GAP_BYTES or offset + length - start > READ_BYTES):
            yield file, start, end, held
            held = []
        if not held:
            file, start, end = name, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield file, start, end, held


def _unpacked(member: bytes) -> bytes:
    """A record's bytes, whether it is a gzip member or stored as it is."""
    return zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member


def read_records(selected: DataFrame, folder: str, with_payload: bool = True, with_names: bool = False) -> DataFrame:
    """The records that rows of the index name: (page_id, url, record_type, refers_to, payload_digest, payload_bytes[, payload]).

    ``payload`` is null for revisits. Every whole payload's digest is computed again; a record that does not match fails the job.
    ``with_names`` adds record_id, refers_to_id and date as the archive has them, for archives of other writers.
    """
    total = selected.agg(F.sum("length")).first()[0] or 0
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint"
    schema += (", payload binary" if with_payload else "") + (", record_id string, refers_to_id string, date string" if with_names else "")
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*((c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        opened, source = None, None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))
            for file, start, end, records in _ranges(rows):
                if file != opened:
                    opened, source = file, fs.open_input_file(f"{top}/{file}")
                source.seek(start)
                data = source.read(end - start)
                found = [parse_record(_unpacked(data[o - start : o - start + n])) for o, n in records]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(names, types)], list(names))

    parts = max(1, -(-int(total) // TASK_BYTES))
    ordered = selected.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, schema)


def _plain_members(source, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of an uncompressed archive, by the lengths that heads name."""
    at = 0
    while at < size:
        source.seek(at)
        head = source.read(min(HEAD_BYTES, size - at))
        blank = head.find(b"\r\n\r\n")
        if blank < 0:
            raise ValueError(f"no record head at {at}")
        length = blank + 4 + int(_headers(head[:blank]).get("content-length", "0"))
        source.seek(at)
        record = source.read(length)
        tail = source.read(min(4, size - at - length))
        length += len(tail) - len(tail.lstrip(b"\r\n"))
        yield at, length, record
        at += length


def _gzip_members(source, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of an archive of gzip members, read on from one to the next."""
    at, data = 0, b""  # ``data`` has been read and is not used up
    source.seek(0)
    while at < size:
        packer, out, begin = zlib.decompressobj(31), [], at
        while not packer.eof:
            if not data:
                data = source.read(READ_BYTES)
                if not data:
                    raise ValueError(f"the member at {begin} ends early")
            out.append(packer.decompress(data))
            used = len(data) - len(packer.unused_data)
            at, data = at + used, packer.unused_data
        yield begin, at - begin, b"".join(out)


def index_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index (see ``write_archives``) of all records in the ``.warc`` and ``.warc.gz`` files of a folder, whoever wrote them.

    A file is a task's work, because where a member begins is known only once the one before is unpacked. ``page_id`` and ``refers_to`` are null
    where record ids are not of this module; warcinfo records and others have their own ``record_type``. An empty folder gives an empty index.
    """
    system, root = pafs.FileSystem.from_uri(folder)
    listed = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    names = sorted(f.base_name for f in listed if f.is_file and f.base_name.endswith((".warc", ".warc.gz")))
    files = spark.createDataFrame([(n,) for n in names], "file string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                source = fs.open_input_file(f"{top}/{name}")
                size = source.size()
                packed = source.read(2) == b"\x1f\x8b"
                for offset, length, record in (_gzip_members if packed else _plain_members)(source, size):
                    r = parse_record(record)
                    row = (name, offset, length, r["url"], r["payload_digest"], r["page_id"], r["record_type"], r["refers_to"])
                    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in _INDEX.split(", ")])

    return cut_lineage(files.repartition(max(1, len(names))).mapInArrow(run, _INDEX))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages below the shared folder, read all records back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, least), folder, with_payload=False)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x FROM p),
f AS (SELECT x, min(page_id) AS first FROM h GROUP BY x)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM h JOIN f USING (x)
"""
