import base64
import gzip
import hashlib
import io
import re

import pytest

from driftfield.llm import warc as A
from driftfield.session import scratch_path

PAGES = [
    (1, "http://a.example/x", "<p>é</p>"), (2, "http://a.example/y", "<p>é</p>"), (3, None, "other"), (4, "http://b.example/ ä\r\nX: 1%41", None), (5, "u", ""),
    (6, "u", "tail\r\n\r\nWARC/1.1\r\n"), (7, "u", "z" * 300_000), (0, "u", "other"), (None, "u", "nobody"), (None, None, "<p>é</p>"), (3, None, "other"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in PAGES], "page_id bigint, url string, html string, digest string")


def want(least=0):
    first = {}
    for p, _, h in PAGES:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, u, h in PAGES:
        raw = (h or "").encode()
        f = first.get(h or "")
        f = None if f is None or p == f or len(raw) < least else f
        out.append((p, u, "response" if f is None else "revisit", f, base64.b32encode(hashlib.sha1(raw).digest()).decode(), len(raw)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 1, 100])
def test_round_trip(spark, pages, least):
    folder = scratch_path(spark, "warc-test")
    index = A.write_archives(pages, folder, least)
    got = A.read_records(index, folder).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want(least)
    payloads = {(r["page_id"], r["payload_digest"]): r["payload"] for r in got if r["record_type"] == "response"}
    assert all(base64.b32encode(hashlib.sha1(p).digest()).decode() == d for (_, d), p in payloads.items())
    one = A.read_records(index.where("page_id = 7"), folder).collect()
    assert [(r["page_id"], len(r["payload"])) for r in one] == [(7, 300_000)]


def test_archives_are_plain_gzip_members(spark, pages, tmp_path):
    index = A.write_archives(pages, str(tmp_path / "w"))
    records = sum(len(re.findall(rb"(?m)^WARC-Type: ", gzip.open(io.BytesIO(f.read_bytes())).read())) for f in (tmp_path / "w").iterdir())
    assert records == len(PAGES) == index.count()


def test_damage_is_noticed(spark, pages, tmp_path):
    raw = A.build_record(1, "u", A.base32_sha1(b"abc"), b"abc", None, False)
    assert A.parse_record(raw)["payload"] == b"abc"
    for bad in (raw[:-5], raw.replace(b"abc", b"abd")):
        with pytest.raises(ValueError):
            A.parse_record(bad)


def test_neighbouring_ranges_are_one_read():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 30, 5), ("a", 30 + A.GAP_BYTES + 6, 5), ("b", 0, A.READ_BYTES), ("b", A.READ_BYTES, 1)]
    got = list(A._ranges(rows))
    assert [(f, s, e, len(r)) for f, s, e, r in got] == [("a", 0, 35, 3), ("a", 36 + A.GAP_BYTES, 41 + A.GAP_BYTES, 1), ("b", 0, A.READ_BYTES, 1), ("b", A.READ_BYTES, A.READ_BYTES + 1, 1)]


def test_empty(pages):
    assert A.round_trip(pages.where("page_id < -5")).collect() == []


def foreign(version, kind, block, *, http=True, digest=None, more=()):
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "warc-date: 2020-01-01T00:00:00Z", "WARC-Target-URI: http://x.org/a%20b", *more]
    lines += [f"Content-Type: {'application/http; msgtype=response' if http else 'application/warc-fields'}", f"Content-Length: {len(block)}"]
    lines += [f"WARC-Payload-Digest: {digest}"] if digest else []
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


FOREIGN = {
    "plain 1.0": (foreign("1.0", "response", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nbody"), "response", b"body"),
    "no head at all": (foreign("1.1", "response", b"HTTP/1.0 200\r\n\r\n"), "response", b""),
    "warcinfo": (foreign("1.0", "warcinfo", b"software: y\r\n", http=False), "warcinfo", b"software: y\r\n"),
    "folded header": (foreign("1.0", "resource", b"data", http=False, more=["X-Long: a", "  b"]), "resource", b"data"),
    "chunked": (foreign("1.1", "response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n", digest="sha1:" + A.base32_sha1(b"body")), "response", None),
    "other digest": (foreign("1.1", "response", b"HTTP/1.1 200 OK\r\n\r\nbody", digest="sha256:00"), "response", b"body"),
    "revisit": (foreign("1.1", "revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n", digest="sha1:" + "A" * 32), "revisit", None),
}


@pytest.mark.parametrize("case", FOREIGN)
def test_records_of_other_writers(case):
    raw, kind, payload = FOREIGN[case]
    got = A.parse_record(raw)
    assert got["record_type"] == kind and got["record_id"] == "<urn:uuid:1>" and got["page_id"] is None and got["url"] == "http://x.org/a%20b"
    if payload is not None:
        assert got["payload"] == payload and got["payload_bytes"] == len(payload)
    if kind == "revisit":
        assert got["payload_bytes"] == 12 and got["payload_digest"] == "A" * 32
    with pytest.raises(ValueError):
        A.parse_record(raw.replace(b"WARC/", b"WRC/"))


def test_index_of_existing_archives(spark, pages, tmp_path, monkeypatch):
    """Own archives, and foreign ones packed and plain: the index found by reading names the same records as the writer's."""
    monkeypatch.setattr(A, "READ_BYTES", 1 << 10)
    folder = tmp_path / "w"
    written = A.write_archives(pages, str(folder))
    columns = ["file", "offset", "length", "page_id", "record_type", "refers_to", "digest"]
    assert sorted(map(tuple, A.index_archives(spark, str(folder)).select(*columns).collect()), key=repr) == sorted(map(tuple, written.select(*columns).collect()), key=repr)
    other = tmp_path / "o"
    other.mkdir()
    raws = [raw for raw, _, _ in FOREIGN.values()]
    (other / "a.warc").write_bytes(b"".join(raws))
    (other / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in raws))
    (other / "c.txt").write_bytes(b"no archive")
    index = A.index_archives(spark, str(other))
    assert index.groupBy("file").count().count() == 2 and index.count() == 2 * len(raws)
    got = A.read_records(index, str(other), with_names=True).collect()
    assert sorted(r["record_type"] for r in got) == sorted(2 * [k for _, k, _ in FOREIGN.values()]) and {r["record_id"] for r in got} == {"<urn:uuid:1>"}
    assert A.index_archives(spark, str(tmp_path / "none")).collect() == []
