"""Archives: round trips through ZIP packages, and revisits."""

import base64
import hashlib
import io
import zipfile

import pytest

from leafwork.llm import warc

from .conftest import collected


def test_pages_round_trip(ready):
    html = ["<p>one</p>", "<p>one</p>", "", None, "two \U0001f600", "x" * 300_000, "<p>one</p>", "two \U0001f600", "<p>one</p>"]
    ids = [1, 2**60 + 1, 3, 4, 5, 6, 7, 5, None]
    rows = [(i, None if k == 2 else f"http://h/{k}", h, "digest", 1) for k, (i, h) in enumerate(zip(ids, html, strict=True))]
    pages = ready.createDataFrame(rows, "page_id bigint, url string, html string, digest string, revisit int")
    found = collected(warc.archive_pages(ready, pages, payload=True))
    assert len(found) == len(rows)
    for row, text in ((r, html[ids.index(r["page_id"])]) for r in found):
        payload = (text or "").encode()
        holder = max((i for i, h in zip(ids, html, strict=True) if (h or "") == (text or "") and i is not None), default=None)
        assert row["payload_bytes"] == len(payload)
        assert row["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert row["record_type"] == ("response" if row["page_id"] == holder else "revisit")
        assert row["refers_to"] == (None if row["page_id"] == holder else holder)
        assert (row["payload"] is None) == (row["record_type"] == "revisit")
        assert row["payload"] is None or bytes(row["payload"]) == payload


def test_small_payloads_are_all_responses(ready):
    pages = ready.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id bigint, url string, html string")
    found = {r["page_id"]: r["record_type"] for r in collected(warc.archive_pages(ready, pages, min_bytes=4))}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_no_pages(ready):
    pages = ready.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive_pages(ready, pages).count() == 0


def _package(raw):
    return warc.Package(lambda at, n: raw[at : at + n], len(raw))


def test_zip64_and_compressed_members(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"a" * 500)
        with z.open(zipfile.ZipInfo("b"), "w", force_zip64=True) as member:
            member.write(b"b" * 700)
        z.writestr("packed", b"c" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    raw = out.getvalue()
    assert b"PK\x06\x06" in raw
    package = _package(raw)
    for name, size in (("a", 500), ("b", 700)):
        at, n = package.locate(name)
        assert raw[at : at + n] == name.encode() * size
    with pytest.raises(ValueError, match="no stored member"):
        package.locate("packed")


@pytest.mark.parametrize("raw", [b"", b"not a zip", b"PK\x05\x06" + b"\xff" * 18])
def test_broken_packages(raw):
    with pytest.raises(ValueError):
        _package(raw)


def test_wrong_payload_is_noticed():
    raw = warc.record(1, "u", b"payload", warc.digest(b"other"), None, False, "2020-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw)
