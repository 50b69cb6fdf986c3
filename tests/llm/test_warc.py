import hashlib
import uuid

import pytest

from frameprobe.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.fixture
def pages(spark):
    same = "y" * 150
    rows = [(1, "http://a/\r\nb", "plain"), (2, None, None), (3, "u", ""), (4, "u", same), (5, "u", same), (6, "u", "z" * 99),
            (7, "u", "z" * 99), (8, "u", FAKE * 3), (9, "u", "x" + FAKE[:40] + "WARC/1.0\r\n"), (10, "u", "WARC/1.0\r\n" * 50),
            (11, "u", FAKE[:-4]), (12, "u", "é𝄞" * 5000), (None, "u", "alone " * 30), (None, "u", same), (4, "u", same),
            (13, "u", "\r\n\r\n" * 40), (14, "u", FAKE * 3)]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("split", ["1m", "300b"])
def test_round_trip(spark, shared_folder, pages, split):
    path = f"{shared_folder}/{uuid.uuid4().hex}"
    warc.write_archive(pages.drop("payload").coalesce(2), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = warc.read_archive(spark, path).collect()
        found = warc.resolved(warc.read_archive(spark, path, with_payload=False)).select(
            warc.page_of("id").alias("page"), "payload_bytes", "payload_digest", "type", warc.page_of("refers").alias("refers")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    least = {}
    for page, data in rows:
        if page is not None and len(data) >= 100:
            least[data] = min(page, least.get(data, page))
    want = [(page, len(data), hashlib.sha256(data).hexdigest(),
             "revisit" if data in least and page != least[data] else "response",
             least[data] if data in least and page != least[data] else None) for page, data in rows]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    answers = sorted((d for p, d in rows if not (d in least and p != least[d])))
    assert sorted(bytes(r.payload) for r in records if r.type == "response") == answers


def test_no_pages(spark, shared_folder, pages):
    path = f"{shared_folder}/{uuid.uuid4().hex}"
    warc.write_archive(pages.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_pointer_jumping_reaches_only_the_chain(spark):
    edges = [("f", 10 * i, 10 * (i + 1)) for i in range(37)] + [("f", 5, 20), ("g", 3, 9), ("g", 0, 4)]
    got = warc.reachable(spark.createDataFrame(edges, "file string, at long, next long")).collect()
    assert sorted((r.file, r.at) for r in got) == [("f", 10 * i) for i in range(37)] + [("g", 0)]
