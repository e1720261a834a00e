import gzip
import hashlib
import io
import random

import pytest

from tallymark.llm import warc
from tallymark.llm.queries import QUERIES
from tests.llm.conftest import LONG

BIG = "<html>" + "ü" * 600 + "</html>"


def page_table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "page_id long, url string, html string, type string, payload string, n long").repartition(parts)


def wide(rows):
    return [(*r, "clash", "clash", 7) for r in rows]


def expected(rows):
    """By page: size, digest, type and response, straight from the rule."""
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == data and i is not None]
        first = max(same) if len(data) >= 1000 and same else page_id
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if first == page_id else "revisit", None if first == page_id else first))
    return sorted(out, key=str)


def run(spark, pages, **options):
    read = warc.stage(warc.read_archives(warc.write_archives(pages, **options)))
    return read, warc.resolved(read)


ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://a/ü b\r\nX: 1", "short"),
    (7, "http://a/7", "short"), (8, "http://a/8", LONG), (8, "http://a/8", LONG), (9, "http://a/9", LONG), (None, "http://none", BIG),
    (None, None, "x" * 999), (10, "http://a/10", "\r\n\r\nWARC/1.1\r\n\x00 " * 400), (11, "", "y" * 1000), (12, "", "y" * 1000), (12, "", "y" * 1000),
    (13, "", "z" * 999), (14, "", "z" * 999),
]


def test_round_trip_of_edge_rows(spark):
    read, whole = run(spark, page_table(spark, wide(ROWS)))
    got = [(int(r.id) if r.id else None, r.payload_bytes, r.payload_digest, r.type, int(r.refers_to) if r.refers_to else None) for r in whole.collect()]
    assert sorted(got, key=str) == expected(ROWS)
    assert read.filter("error IS NOT NULL").count() == 0
    payloads = sorted(((r.id or ""), bytes(r.payload).decode()) for r in whole.collect())
    assert payloads == sorted((str(i or ""), h or "") for i, _, h in ROWS)
    assert {r.url for r in whole.filter("id = '6'").collect()} == {"http://a/ü%20b%0D%0AX:%201"}


def test_empty_table_and_small_archives(spark):
    pages = page_table(spark, wide(ROWS))
    assert run(spark, pages.filter("false"))[1].count() == 0
    listed = warc.write_archives(pages, archive_bytes=1)
    assert listed.count() == len(ROWS) and warc.read_archives(listed, payloads=False).filter("payload IS NULL").count() == len(ROWS)


def test_hot_payload_is_looked_up_by_broadcast(spark):
    rows = [(i, "u", BIG if i % 3 == 0 else f"{i % 700} " * 400) for i in range(3000)]
    _, whole = run(spark, page_table(spark, wide(rows)))
    got = [(int(r.id), r.payload_bytes, r.payload_digest, r.type, int(r.refers_to) if r.refers_to else None) for r in whole.collect()]
    assert sorted(got, key=str) == expected(rows)


def test_other_readers_find_gzip_members(spark, tmp_path):
    warc.write_archives(page_table(spark, wide(ROWS), 1), folder=str(tmp_path / "out"))
    listed = warc.archives_in(spark, str(tmp_path / "out"))
    assert warc.read_archives(listed).count() == len(ROWS)
    text = gzip.open(next((tmp_path / "out").glob("*.warc.gz"))).read()
    assert text.count(b"WARC-Type: revisit") == 6 and text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


@pytest.fixture
def members():
    rng = random.Random(5)
    return [warc.page_record(str(i), f"http://a/{i}", rng.randbytes(rng.randrange(0, 5000)).hex().encode(), None) for i in range(40)]


def read_all(data):
    return list(warc.records(io.BytesIO(data)))


@pytest.mark.parametrize("block", [7, 100, 4096, 1 << 18])
def test_any_block_size_reads_the_same(members, monkeypatch, block):
    whole = read_all(b"".join(members))
    monkeypatch.setattr(warc, "BLOCK", block)
    assert read_all(b"".join(members)) == whole and [r["id"] for r in whole] == [str(i) for i in range(40)]


def test_damage_costs_one_record(members):
    for damage in (lambda m: m[:40] + b"\x00\xff\x00" + m[43:], lambda m: m[: len(m) // 2], lambda m: b"noise" * 30, lambda m: m[:-8] + b"\0" * 8):
        data = b"".join(damage(m) if i == 17 else m for i, m in enumerate(members))
        got = read_all(data)
        assert [r["id"] for r in got if r["error"] is None] == [str(i) for i in range(40) if i != 17]
        assert [r["payload_digest"] for r in got if r["error"]] == [None]
    assert read_all(b"".join(members)[:-5])[-1]["error"].startswith("damaged member") and read_all(b"") == []


def test_wrong_digest_length_and_framing_are_errors():
    def packed(text):
        return read_all(gzip.compress(text))[0]["error"]

    body = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n%s\r\nhello\r\n\r\n"
    assert packed(body % b"") is None
    assert packed(body % b"WARC-Block-Digest: sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA\r\n") == "block digest differs"
    assert packed(body % b"WARC-Payload-Digest: sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA\r\n") == "payload digest differs"
    assert packed(body % b"WARC-Payload-Digest: sha1:aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d\r\n") is None
    assert packed(body.replace(b": 5", b": 4") % b"") == "not closed after its Content-Length"
    assert packed(body.replace(b": 5", b": 50") % b"") == "shorter than its Content-Length"
    assert packed(body.replace(b": 5", b": five") % b"") == "no Content-Length"
    assert packed(b"hello") == "not a WARC record"


def test_query_over_the_smallest_pages(spark, folder):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op13_warc"](spark, folder).collect()]
    assert sorted(got, key=str) == expected(rows)
