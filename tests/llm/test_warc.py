"""Archives: the own reader against ``zipfile``, and round trips of records."""

import hashlib
import io
import random
import struct
import zipfile
from collections import Counter

import pytest

from milepost.llm import warc

PAGES = "page_id bigint, url string, html string, payload string"


def page_rows():
    rng = random.Random(9)
    long = ["".join(rng.choices("abc <>é\n", k=1200)) for _ in range(4)]
    rows = [(k, f"http://h{k}/a b?é=1\n", long[k % 3], None) for k in range(40)]
    rows += [(100 + k, "http://x/", "short", None) for k in range(3)]
    rows += [(200, None, None, "x"), (201, "", "", None), (202, "u", "e" * 999, None),
             (203, "u", "e" * 999, None), (204, "u", "e" * 1000, None), (205, "u", "e" * 1000, None),
             (206, "u", "z" * 300_000, None), (None, "n", long[3], None), (207, "n", long[3], None),
             (None, "m", "q" * 1100, None), (None, "m", "q" * 1100, None)]
    return [*rows, rows[0], rows[38], rows[38]]


def by_hand(rows):
    last = {}
    for k, _, html, _ in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and k is not None:
            last[body] = max(last.get(body, k), k)
    out = []
    for k, _, html, _ in rows:
        body = (html or "").encode()
        to = last.get(body)
        to = to if to is not None and (k is None or k < to) else None
        kind = "response" if to is None else "revisit"
        out.append((k, len(body), hashlib.sha1(body).hexdigest(), kind, to))
    return Counter(out)


def test_pages_equal_plain_python(corpus):
    df = corpus.createDataFrame(page_rows(), PAGES).repartition(3)
    got = warc.report(df)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == by_hand(page_rows())
    assert warc.report(df.limit(0)).count() == 0


def test_payloads_come_back(corpus, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 3000)
    rows = page_rows()
    df = corpus.createDataFrame(rows, PAGES).selectExpr(
        "page_id AS id", "url", "CAST(html AS binary) AS payload"
    )
    archives = warc.write(df.repartition(2), limit=4000)
    assert archives.count() > 2
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.resolved(warc.read(archives)).collect()
    assert all(r.intact for r in got)
    want = Counter((k, (html or "").encode()) for k, _, html, _ in rows)
    assert Counter((r.id, bytes(r.payload)) for r in got) == want
    assert {r.url for r in got} >= {"http://h1/a%20b?%C3%A9=1%0A", None, "u"}


def read_from(body):
    return len(body), lambda start, length: body[start : start + length]


@pytest.mark.parametrize("seekable", [True, False])
def test_members_equal_those_of_zipfile(seekable):
    rng = random.Random(1)
    out = io.BytesIO()
    target = out if seekable else warc._Forward(out)
    names = ["a", "dir/é日本", "c" * 300, "big", "packed"]
    bodies = {n: rng.randbytes(rng.randint(0, 500)) for n in names}
    with zipfile.ZipFile(target, "w") as z:
        z.comment = b"PK\x05\x06 in a comment " + b"x" * 90 if seekable else b""
        for n in names:
            info = zipfile.ZipInfo(n)
            info.compress_type = zipfile.ZIP_DEFLATED if n == "packed" else zipfile.ZIP_STORED
            with z.open(info, "w", force_zip64=n == "big") as member:
                member.write(bodies[n])
    size, read = read_from(out.getvalue())
    found = {n: read(start, length) for n, start, length, _ in warc.members(size, read)}
    assert found == {n: b for n, b in bodies.items() if n != "packed"}


def test_zip64_directory(monkeypatch):
    # More members than a short field counts make zipfile write the ZIP64 records.
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(9):
            z.writestr(f"m{k}", bytes([k]) * (200 * k))
    body = out.getvalue()
    assert b"PK\x06\x06" in body and b"PK\x06\x07" in body
    # The short fields say that only the long ones count.
    at = body.rindex(b"PK\x05\x06")
    body = body[: at + 8] + struct.pack("<HHII", 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF) + body[at + 20 :]
    size, read = read_from(body)
    found = {n: read(start, length) for n, start, length, _ in warc.members(size, read)}
    assert found == {f"m{k}": bytes([k]) * (200 * k) for k in range(9)}


def test_broken_archives_are_errors():
    for body in (b"", b"PK", b"x" * 100):
        with pytest.raises(ValueError):
            list(warc.members(*read_from(body)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b")
    whole = out.getvalue()
    with pytest.raises(ValueError):
        list(warc.members(*read_from(whole.replace(b"PK\x01\x02", b"PK\x01\x09"))))
