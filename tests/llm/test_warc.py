"""Archives: whole records back, revisits by digest, damage noticed."""

from __future__ import annotations

import glob
import gzip
import hashlib
import zlib

import pytest

from evkit.llm import warc as W

SCHEMA = "page_id long, url string, html string, kind string"


def capture_rows(spark, pages, path, **settings):
    W.write_archive(pages, path, **settings)
    return W.assemble(W.read_records(spark, path)).select("capture", "request", "metadata", W.payload_bytes().alias("bytes")).collect()


def pages_of():
    same, other = "S" * 1500, "é𝄞\r\n\r\n" * 300
    texts = [same, "short", other, same, "short", None, "", same, "WARC/1.1\r\n\r\n" * 200, other, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000,
             "z" * 3_000_000]
    return [(100 - i, f"http://h/{i}\r\nX: 1" if i % 2 else None, t, "clash") for i, t in enumerate(texts)]


@pytest.mark.parametrize("file_bytes", [64 << 20, 1000])
def test_captures_come_back(spark, tmp_path, monkeypatch, file_bytes):
    monkeypatch.setattr(W, "FILE_BYTES", file_bytes)
    pages = pages_of()
    rows = capture_rows(spark, spark.createDataFrame(pages, SCHEMA).repartition(3), f"{tmp_path}/warc")
    assert len(rows) == len(pages)
    files = glob.glob(f"{tmp_path}/warc/part-*")
    assert (len(files) > 10) == (file_bytes == 1000)
    groups = {}
    for i, _, text, _ in pages:
        groups.setdefault(text or "", []).append(i)
    got = {int(r["capture"]["record_id"][:-1].rsplit(":", 1)[1]): r for r in rows}
    for i, url, text, _ in pages:
        data = (text or "").encode()
        r, capture = got[i], got[i]["capture"]
        last = max(groups[text or ""])
        again = len(data) >= 1000 and i != last
        assert capture["kind"] == ("revisit" if again else "response")
        assert capture["refers_to"] == (f"<urn:capture:response:{last}>" if again else None)
        assert capture["digest"] == "sha1:" + hashlib.sha1(data).hexdigest() and r["bytes"] == len(data)
        assert capture["payload"] == ("" if again else text or "")
        assert r["request"]["concurrent_to"] == r["metadata"]["concurrent_to"] == capture["record_id"]
        assert r["request"]["head"].startswith("GET ") and "\n" not in capture["uri"]


def test_pages_without_id_and_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "x" * 2000, "c"), (1, "u", "x" * 2000, "c"), (2, "u", "x" * 2000, "c")], SCHEMA)
    rows = capture_rows(spark, pages, f"{tmp_path}/a")
    assert sorted(r["capture"]["kind"] for r in rows) == ["response", "revisit"]
    assert capture_rows(spark, pages.limit(0), f"{tmp_path}/b") == []


def test_damage_is_noticed(spark, tmp_path):
    W.write_archive(spark.createDataFrame([(1, "u", "payload " * 200, "c")], SCHEMA), f"{tmp_path}/w")
    (path,) = [p for p in glob.glob(f"{tmp_path}/w/part-*") if len(open(p, "rb").read()) > 30]
    whole = gzip.decompress(open(path, "rb").read())
    assert len(list(W._parse(gzip.compress(whole)))) == 3
    # Members one after the other, as other writers have them.
    cut = whole.index(b"WARC/1.1", 10)
    assert len(list(W._parse(gzip.compress(whole[:cut]) + gzip.compress(whole[cut:])))) == 3
    with pytest.raises(ValueError, match="digest"):
        list(W._parse(gzip.compress(whole.replace(b"payload payload", b"paYload payload", 1))))
    with pytest.raises(ValueError, match="ends within"):
        list(W._parse(gzip.compress(whole[:-20])))
    with pytest.raises((ValueError, zlib.error)):
        list(W._parse(gzip.compress(whole)[:-30]))
