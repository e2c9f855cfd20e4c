import gzip
import hashlib
import re
from collections import Counter
from pathlib import Path

import pytest

from paperlens.llm import warc

BIG = "<p>" + "same text " * 200
ROWS = [
    (1, "http://www.example.com/a?x=1#top", BIG), (2, "https://example.com/b", BIG), (3, "http://b.example.com/", BIG),
    (3, "http://b.example.com/", BIG), (4, "http://example.com/a?x=1", "short"), (5, "http://other.org", "short"),
    (6, None, None), (None, "http://c.org/\tx y", BIG + "é"), (None, "http://c.org/z", BIG), (7, "ümlaut.example/ä", "ä" * 2_000),
    (8, "", ""),
]
SCHEMA = "page_id long, url string, html string"


def wanted(rows):
    out = []
    for number, _, html in rows:
        payload = (html or "").encode()
        same = [n for n, _, h in rows if (h or "").encode() == payload and n is not None]
        first = max(same, default=None)
        revisit = len(payload) >= 1_000 and first is not None and number != first
        out.append((str(number) if number is not None else None, len(payload), hashlib.sha1(payload).hexdigest(),
                    "revisit" if revisit else "response", str(first) if revisit else None))
    return Counter(out)


def got(df):
    return Counter((r["number"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())


@pytest.mark.parametrize("captures", [1, 2, 256])
def test_all_records_come_back(spark, monkeypatch, captures):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", captures)
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    archive = warc.write(pages)
    assert got(warc.read(archive, warc.find(archive, pages))) == wanted(ROWS)
    payloads = {r["url"]: r["payload"] for r in warc.read(archive, archive.captures, payloads=True).collect()}
    assert bytes(payloads["ümlaut.example/ä"]).decode() == "ä" * 2_000


def test_keys_with_any_characters(spark, tmp_path):
    """Tabs, line breaks, percent signs and the empty text in keys, read back by another handle of the folder."""
    rows = [("a\tb", "http://a/1", BIG), ("line\r\nWARC-Type: x", "http://a/2", BIG + "x"), ("", "http://a/3", "y" * 2_000),
            (None, "http://a/4", "y" * 2_000), ("%", "http://a/5", "z"), ("%25 é\n", "http://a/5", BIG), ("  ", "http://a/6", "z")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)
    warc.write(pages, f"file://{tmp_path}/new")
    (tmp_path / "new" / "archive-unused.warc.gz").write_bytes(b"left by a task that was run again")
    archive = warc.Archive.open(spark, f"file://{tmp_path}/new")
    assert got(warc.read(archive, warc.find(archive, pages))) == wanted(rows)
    assert sorted(repr(r["number"]) for r in warc.find(archive, pages).collect()) == sorted(repr(r[0]) for r in rows)
    assert archive.captures.count() == len(rows)


def test_revisits_name_the_record_they_refer_to(spark, tmp_path):
    warc.write(spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path}/new")
    files = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "new").glob("*.warc.gz")).decode()
    ids = dict.fromkeys(re.findall("WARC-Record-ID: (.*?)\r\n", files))
    refers = re.findall("WARC-Refers-To: (.*?)\r\n", files)
    assert len(refers) == sum(n for r, n in wanted(ROWS).items() if r[3] == "revisit") > 0 and set(refers) <= set(ids)


def test_a_very_long_page(spark):
    rows = [(1, "http://a", "<p>" + "x y" * 4_000_000), (2, "http://a", "<p>" + "x y" * 4_000_000), (3, "http://a", "z")]
    pages = spark.createDataFrame(rows, SCHEMA)
    archive = warc.write(pages)
    assert got(warc.read(archive, warc.find(archive, pages))) == wanted(rows)


def test_reads_use_as_many_tasks_as_the_bytes_need(spark, plan, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 100)
    archive = warc.write(spark.createDataFrame(ROWS, SCHEMA))
    found = warc.find(archive, spark.createDataFrame(ROWS, SCHEMA))
    text = plan(warc.read(archive, found))
    assert f", {-(-archive.size // 100)}), REPARTITION_BY_NUM" in text


def test_lookup_of_single_urls(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    archive = warc.write(pages)

    def found(url):
        return sorted(r["number"] or "" for r in warc.find(archive, spark.createDataFrame([(url,)], "url string")).collect())

    assert found("http://example.com/a?x=1") == ["1", "4"]
    assert found("http://b.example.com/") == ["3", "3"]
    assert found("http://nowhere.example/") == []
    assert found(None) == ["6", "8"]


def test_files_are_plain_warc(spark, tmp_path):
    archive = warc.write(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), f"file://{tmp_path}/new")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "new").glob("*.warc.gz"))
    assert data.count(b"WARC/1.0\r\n") == len(ROWS) and data.count(b"WARC-Type: revisit") == sum(
        n for r, n in wanted(ROWS).items() if r[3] == "revisit")
    assert archive.captures.count() == len(ROWS)


def test_url_keys():
    assert warc.url_key("https://WWW.Example.com:80/Path?q=1#f") == "com,example:80)/Path?q=1"
    assert warc.url_key("example.com") == "com,example)/" and warc.url_key(None) == ")/"


def test_a_damaged_payload_is_an_error():
    import zlib

    good = warc.record("1", "http://a", b"payload", None)
    text = zlib.decompress(good, 31).replace(b"payload", b"pAyload")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(packer.compress(text) + packer.flush())


def test_empty_table_and_more_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    archive = warc.write(none)
    assert warc.read(archive, warc.find(archive, none)).count() == 0
    more = spark.createDataFrame([(1, "http://a", "x", "f", 3)], SCHEMA + ", file string, offset long")
    archive = warc.write(more)
    assert warc.read(archive, warc.find(archive, more)).count() == 1
