import gzip
import hashlib
import io
import zlib

import pytest

from factsieve.llm import warc

PAGES = [(1, "http://a/", "short"), (2, "http://b/", "same " * 300), (3, None, "same " * 300), (9, "http://c/\r\nX: y", "same " * 300), (4, "http://d/", None), (5, "http://e/", ""),
         (6, "http://f/", "short"), (7, "é", "naïve é " * 400), (7, "é", "naïve é " * 400), (None, None, "only null " * 200), (None, "u", "only null " * 200), (8, "", "big\r\n\r\nWARC/1.1\r\n" * 200_000)]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)


def test_round_trip(spark, pages, monkeypatch):
    got = warc.round_trip(pages).collect()
    assert len(got) == len(PAGES)
    top = {}
    for i, _, h in PAGES:
        if h and len(h.encode()) >= 1000:
            top[h] = max(top.get(h, i) or -1, i or -1)
    want = sorted(((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in PAGES), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=str) == want
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str)
    assert kinds == sorted([(1, "response", None), (2, "revisit", 9), (3, "revisit", 9), (9, "response", None), (4, "response", None), (5, "response", None), (6, "response", None),
                            (7, "response", None), (7, "revisit", 7), (None, "response", None), (None, "revisit", None), (8, "response", None)], key=str)
    assert {r.url for r in got if r.page_id == 9} == {"http://c/%0D%0AX: y"}


def test_members_and_index(spark, pages):
    folder = warc.shared_folder(spark, "test")
    archives = warc.write_archives(warc.decide(pages), f"{folder}/whole", archive_bytes=2000)
    names = [r.archive for r in archives.collect()]
    assert len(names) > 3 and sum(r.records for r in archives.collect()) == len(PAGES)
    index = warc.normalise(archives, f"{folder}/members").collect()
    assert len(index) == len(PAGES)
    for name in names:
        store, path = warc.file_system(name)
        whole = store.open_input_stream(path, compression=None).read()
        engine = zlib.decompressobj(31)
        text = engine.decompress(whole)
        assert engine.eof and not engine.unused_data  # one stream
        rows = sorted((r.offset, r.length) for r in index if r.archive.endswith(path.rpartition("/")[2]))
        store, path = warc.file_system(next(r.archive for r in index if r.archive.endswith(path.rpartition("/")[2])))
        members = store.open_input_stream(path, compression=None).read()
        assert b"".join(zlib.decompress(members[o : o + n], 31) for o, n in rows) == text == gzip.decompress(members)
        assert [o for o, _ in rows] == [0, *(o + n for o, n in rows)][:-1] and sum(rows[-1]) == len(members)


def test_damaged_and_odd_streams(tmp_path):
    record = warc.make_record(1, "u", "00" * 20, 3, b"abc", None, "s")
    out = lambda: warc.Whole(str(tmp_path / "x" / "y.gz"))
    two = gzip.compress(record + b"\r\n") + gzip.compress(b"") + gzip.compress(record)
    assert [h["x-page-id"] for _, _, h in warc.split_members(io.BytesIO(two), out())] == ["1", "1"]
    assert list(warc.split_members(io.BytesIO(b""), out())) == []
    for bad in (gzip.compress(record)[:-20], gzip.compress(record[:-9]), gzip.compress(b"WARC/1.1\r\nno end"), gzip.compress(b"HTTP/1.1\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.split_members(io.BytesIO(bad), out()))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
