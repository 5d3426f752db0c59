import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import leastid, warc
from siltstone.runtime import scratch

LONG = "<p>eine lange Seite</p>" * 200_000
ROWS = [(k, f"http://a.example/{k}?q=x y\n", f"<html>page {k % 40} " + "é日😀" * (k % 60) + "</html>") for k in range(200)] + [
    (500, None, None), (501, "u", ""), (502, "u", "x" * 99), (503, "u", "x" * 99), (504, "u", "x" * 100), (505, "u", "x" * 100), (-3, "u", "x" * 100), (506, "u", "é" * 50), (507, "u", "é" * 50),
    (None, "u", "x" * 100), (None, "u", "only without id " * 10), (None, "u", "only without id " * 10), (508, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n" * 9), (509, "", LONG), (510, "", LONG),
    (511, "u", "twice " * 30), (511, "u", "twice " * 30), (512, "u", "\x1f\x08\0\r\n\r\n" * 40), *((600 + k, "u", "hot " * 50) for k in range(120)),
]


def brute(rows):
    least = {}
    for k, _, html in rows:
        if k is not None:
            least[html or ""] = min(k, least.get(html or "", k))
    out = []
    for k, _, html in rows:
        data = (html or "").encode()
        first = least.get(html or "")
        again = len(data) >= 100 and first is not None and (k is None or k > first)
        out.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], "page_id long, url string, html string, first int, payload string")


def files(folder):
    d = folder.removeprefix("file://")
    return [os.path.join(d, f) for f in sorted(os.listdir(d)) if f.startswith("part-")]


@pytest.mark.parametrize(("compress", "small"), [(True, False), (False, True)])
def test_round_trip(spark, monkeypatch, compress, small):
    if small:
        monkeypatch.setattr(leastid, "BROADCAST_ROWS", 0)
    folder = scratch(spark, "warc")
    warc.write(pages(spark).repartition(3), folder, compress, archive_bytes=20_000)
    found = warc.salvage(spark, folder)
    assert sorted(map(tuple, warc.digest(found).collect()), key=repr) == sorted(brute(ROWS), key=repr)
    assert warc.gaps(found).count() == 0 and warc.unresolved(found).count() == 0
    texts = {r.record: r.payload.decode() for r in found.where("kind = 'response'").collect()}
    refer = {r.record: r.refers_to for r in found.where("kind = 'revisit'").collect()}
    for k, _, html in ROWS:
        rid = warc.record_id(k, hashlib.sha256((html or "").encode()).hexdigest())
        assert texts[refer.get(rid, rid)] == (html or "")
    names = files(folder)
    assert len(names) > 5 and found.where("kind = 'warcinfo'").count() == len(names)
    for name in names:  # other readers see whole records, one behind the other
        with open(name, "rb") as f:
            data = f.read()
        assert data.startswith(b"\x1f\x8b" if compress else b"WARC/1.1\r\n") and data.endswith(b"\0" if compress else b"\r\n\r\n")
        data = gzip.decompress(data) if compress else data
        assert data.endswith(b"\r\n\r\n")
    assert found.where("url like '%x%20y%0A%'").count() == 200


def archive(n=30, compress=True, seed=1):
    """(content, [(first byte, end, record id)]) of an archive."""
    rng = random.Random(seed)
    content, spans = b"", []
    for k in range(n):
        payload = rng.randbytes(rng.randrange(1, 4000)) if k % 2 else f"text {k} ".encode() * rng.randrange(1, 300)
        one = warc.page_record(k, f"http://a/{k}", payload, hashlib.sha256(payload).hexdigest(), None)
        one = warc.member(one) if compress else one
        spans.append((len(content), len(content) + len(one), k))
        content += one
    return content, spans


def check(content, spans, hurt, lost=()):
    """All records but the hurt ones come back, and records and gaps cover every byte once."""
    found = list(warc.scan(content))
    got = [warc.page_of(f.record) for f in found if f.reason is None]
    assert got == [k for _, _, k in spans if k not in hurt and k not in lost]
    at = 0
    for f in found:
        assert f.offset == at and f.length > 0
        at = f.offset + f.length
    assert at == len(content)
    assert bool([f for f in found if f.reason]) == bool(hurt)
    return [f for f in found if f.reason]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_after_damage(compress):
    content, spans = archive(compress=compress)
    check(content, spans, set())
    rng = random.Random(2)
    for _ in range(60):  # a flipped byte costs one record
        at = rng.randrange(len(content))
        broken = bytearray(content)
        broken[at] ^= rng.randrange(1, 256)
        hit = {k for a, b, k in spans if a <= at < b}
        found = list(warc.scan(bytes(broken)))
        got = {warc.page_of(f.record) for f in found if f.reason is None}
        assert got - {k for *_, k in spans} <= {None} and {k for *_, k in spans} - hit <= got
        assert sum(f.length for f in found) == len(content)
    a, b, k = spans[4]
    middle = (a + b) // 2
    (gap,) = check(content[:middle] + bytes([content[middle] ^ 255]) + content[middle + 1 :], spans, {4})
    assert (gap.offset, gap.length) == (a, b - a)
    (gap,) = check(content[:a] + content[a + 11 :], spans, {4})  # its beginning is lost
    assert (gap.offset, gap.length) == (a, b - a - 11)
    (gap,) = check(content[:middle] + content[middle + 5 :], spans, {4})  # bytes are missing inside
    assert (gap.offset, gap.length) == (a, b - a - 5)
    (gap,) = check(content[:a] + b"junk in between\r\n" + content[a:], spans, {-1})
    assert (gap.offset, gap.length) == (a, 17)
    d = spans[6][1]
    found = check(content[: b - 20] + content[d - 10 :], spans, {4, 5, 6})  # from inside one to inside another
    assert sum(g.length for g in found) == b - a - 20 + 10
    (gap,) = check(content[: spans[-1][0] + 20], spans, {29})  # cut off at the end
    assert "cut off" in gap.reason or "no end" in gap.reason
    assert [f.reason is None for f in warc.scan(b"nothing of the kind")] == [False] and not list(warc.scan(b"")) and not list(warc.scan(b"\0\0\0"))


@pytest.mark.parametrize("compress", [True, False])
def test_wrong_digest_quarantines_the_record_alone(compress):
    inner = warc.page_record(77, None, b"inside", hashlib.sha256(b"inside").hexdigest(), None)
    bad = warc.page_record(5, "u", inner * 3, "0" * 64, None)
    good = warc.page_record(6, "u", b"fine", hashlib.sha256(b"fine").hexdigest(), None)
    parts = [warc.member(x) if compress else x for x in (good, bad, bad, good)]
    found = list(warc.scan(b"".join(parts)))
    assert [(f.reason, warc.page_of(f.record)) for f in found] == [(None, 6), ("payload: digest", None), ("payload: digest", None), (None, 6)]
    assert [f.length for f in found] == [len(p) for p in parts]


def test_records_of_other_writers():
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nwarc-record-id:<urn:uuid:1>\r\nContent-Length:  3\r\nContent-Type: text/plain\r\nWARC-Block-Digest: sha1:ABC\r\n\r\nabc\r\n\r\n"
    two = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Length: 0\r\nWARC-Payload-Digest: sha256:AB\r\n\r\n\r\n\r\n"
    for content in (one + two, gzip.compress(one) + gzip.compress(two) + b"\0" * 9, gzip.compress(one + two)):
        a, b = warc.scan(content)
        assert (a.kind, a.record, a.payload, a.payload_bytes) == ("resource", "<urn:uuid:1>", b"abc", 3) and (b.kind, b.payload, b.payload_digest) == ("revisit", None, "ab")
        assert warc.page_of(a.record) is None
    for broken in (one.replace(b"Content-Length:  3", b"Content-Length: -3"), one.replace(b"warc-record-id", b"x"), one.replace(b"abc\r", b"ab\r"), one.replace(b"WARC-Type:", b"WARC-Type")):
        (gap,) = warc.scan(broken)
        assert gap.reason and gap.length == len(broken)


def test_damaged_archives_of_a_job(spark):
    folder = scratch(spark, "warc")
    rows = [r for r in ROWS if r[0] is not None and r[0] < 200]
    warc.write(pages(spark, rows).repartition(2), folder, archive_bytes=1 << 20)
    name = files(folder)[0]
    os.remove(os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc"))
    with open(name, "r+b") as f:
        size = f.seek(0, 2)
        f.seek(size // 2)
        f.write(b"\xff" * 40)
    found = warc.salvage(spark, folder)
    log = warc.gaps(found).collect()
    assert len(log) == 1 and log[0].length >= 40 and log[0].offset < size // 2 + 40 and log[0].archive.endswith(os.path.basename(name))
    got, want = set(map(tuple, warc.digest(found).collect())), set(brute(rows))
    assert got < want and len(want) - len(got) in (1, 2)
    lost = {r[0] for r in want - got}
    wanting = {r[4] for r in got if r[4] in lost}
    assert {warc.page_of(r.refers_to) for r in warc.unresolved(found).collect()} == wanting


def test_empty_table(spark):
    folder = scratch(spark, "warc")
    warc.write(pages(spark, []), folder)
    assert warc.digest(warc.salvage(spark, folder)).count() == 0
    assert warc.salvage(spark, folder, with_payload=False).where(F.col("payload").isNotNull()).count() == 0
