import hashlib

import pytest

from rowtide.llm import warc

DDL = "page_id long, url string, html string, payload string, sha1 int"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "shared text of a page " * 100
    rows = [(i, f"http://h/{i}", f"<html>{i} " + "text of page " * (i % 90)) for i in range(120)]
    rows += [(200, "http://h/a", big), (201, None, big), (199, "http://h/ b\r\nx", big), (202, "http://h/n", None), (203, "u", ""),
             (204, "u", "x" * 999), (205, "u", "x" * 999), (206, "u", "y" * 1000), (207, "u", "y" * 1000), (207, "u", "y" * 1000),
             (None, "u", "y" * 1000), (300, "u", "ä\n" * 500_000)]
    return spark.createDataFrame([(*r, "p", 1) for r in rows], DDL)


def test_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages, path, archive_bytes=20_000)
    found = warc.read(spark, path).collect()
    payloads = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    keeper = {}
    for i, p in payloads:
        keeper[p] = max(keeper.get(p, -1), -1 if i is None else i)
    expected = []
    for i, p in payloads:
        again = len(p) >= 1000 and keeper[p] != i
        expected.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", keeper[p] if again else None,
                         None if again else p))
    key = lambda r: (str(r[0]), r[3])
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                    None if r["payload"] is None else bytes(r["payload"])) for r in found), key=key) == sorted(expected, key=key)
    urls = {r["page_id"]: r["url"] for r in found}
    assert urls[201] is None and urls[199] == "http://h/%20b%0D%0Ax"
    assert len({r["archive"] for r in found}) > 3


def test_archive_layout():
    import zstandard

    made = [warc.record(i, "u", b"<html>some page text " * 20 + str(i).encode(), "00" * 20, 9, None) for i in range(200)]
    data = warc.archive(made)
    frames = list(warc.frames(data))
    assert frames[0][0] == warc.DICTIONARY_MAGIC and frames[0][1] == 0 and frames[0][2] > 8
    assert len(frames) == 202 and frames[-1][2] == len(data)
    dictionary = zstandard.ZstdCompressionDict(data[8: frames[0][2]])
    _, begin, end = frames[57]
    assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[begin:end]) == made[55]
    assert len(data) - frames[0][2] < sum(len(zstandard.compress(m)) for m in made)


def test_damage_is_found(spark, tmp_path):
    bad = warc.archive([warc.record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), 3, None)])
    (tmp_path / "x.warc.zst").write_bytes(bad)
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, str(tmp_path)).collect()


def test_empty(spark, pages, tmp_path):
    warc.write(pages.limit(0), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0
