"""The archives' index: its lines, archives written elsewhere, and whole round trips."""

import gzip
import io
import json
import zipfile

import pytest

from clickrank.llm import mixing, warc_zip


def test_index_lines():
    line = warc_zip.index_line("https://me@www.Example.com:80/A b?q=1", "response", "ABC", 7, 9)
    key, stamp, fields = line.split(" ", 2)
    assert key == "com:80,example,www)/a%20b?q=1" and len(stamp) == 14
    assert json.loads(fields)["digest"] == "sha1:ABC" and json.loads(fields)["url"] == "https://me@www.Example.com:80/A%20b?q=1"
    assert warc_zip.surt("") == "-" and " " not in warc_zip.surt("no address at all")
    text = "!meta {\"format\": \"x\"}\n CDX N b a\n" + line
    assert warc_zip.index_entries(text.encode()) == [("archive/data.warc.gz", 7, 9)]


def elsewhere(tmp_path, index_name, entries=True):
    """An archive with two WARC members and a compressed index, as another writer makes it."""
    out, lines = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for n in ("one", "two"):
            block = b"HTTP/1.1 200 OK\r\n\r\n" + n.encode()
            record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x/" + n.encode() \
                + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
            data = b"".join([b"skip", gzip.compress(record)])
            z.writestr(f"archive/{n}.warc.gz", data)
            lines.append(f"x)/{n} 20200101000000 " + json.dumps({"filename": f"{n}.warc.gz", "offset": "4", "length": str(len(data) - 4)}))
        if entries:
            z.writestr(index_name, gzip.compress("\n".join(lines).encode()) if index_name.endswith(".gz") else "\n".join(lines))
    path = tmp_path / "x.wacz"
    path.write_bytes(out.getvalue())
    return f"file://{path}"


@pytest.mark.parametrize("name", ["indexes/index.cdx.gz", "indexes/a.cdxj"])
def test_archives_written_elsewhere(spark, tmp_path, name):
    manifest = spark.createDataFrame([(elsewhere(tmp_path, name), 2)], "archive string, records long")
    rows = warc_zip.read_archives(manifest).collect()
    assert sorted((r.url, bytes(r.payload), r.page_id, r.payload_digest) for r in rows) == [
        ("http://x/one", b"one", None, None), ("http://x/two", b"two", None, None)]


def test_archive_without_index(spark, tmp_path):
    manifest = spark.createDataFrame([(elsewhere(tmp_path, "-", entries=False), 2)], "archive string, records long")
    with pytest.raises(Exception, match="no index"):
        warc_zip.read_archives(manifest).collect()


def test_long_and_repeated_pages(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"page {i % 7}" * (1 + 200_000 * (i == 5)), 1) for i in range(60)] + [(5, None, "", 1)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, OFFSET int")
    got = warc_zip.read_archives(warc_zip.write_archives(pages, warc_zip.ArchiveConfig(archive_bytes=2000))).collect()
    largest = {}
    for i, _, text, _ in rows:
        largest[text] = max(i, largest.get(text, -1))
    want = sorted((i, u or "", len(t), "response" if i == largest[t] else "revisit", -1 if i == largest[t] else largest[t]) for i, u, t, _ in rows)
    assert sorted((r.page_id, r.url, r.payload_bytes, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == want


def test_budgets_beyond_doubles(spark):
    leaves = spark.createDataFrame([("a", "en", "1", 2 ** 60 + 1)], "domain string, language string, source string, tokens long")
    r, = mixing.leaf_budgets(leaves, mixing.MixConfig(target_permille=999, max_epochs=2)).collect()
    assert (r.budget, r.epochs, r.rest) == ((2 ** 60 + 1) * 999 // 1000, 0, (2 ** 60 + 1) * 999 // 1000)
    r, = mixing.leaf_budgets(leaves, mixing.MixConfig(target_tokens=2 ** 61 + 1, max_epochs=2)).collect()
    assert (r.budget, r.epochs, r.rest) == (2 ** 61 + 1, 1, 2 ** 60)
