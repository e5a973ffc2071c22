"""WARC archives: round trip, revisits, and lookups in the two-level index."""

import base64
import gzip
import hashlib
import random

import pytest

from twinspect.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, offset string").repartition(3)


def plain(rows, least=0):
    """Rows as archived() gives them."""
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
    out, seen = [], {}
    for r in sorted(rows, key=order):
        data = (r[2] or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = digest in seen and len(data) >= least
        out.append((r[0], len(data), digest, "revisit" if again else "response", seen[digest] if again else None))
        seen.setdefault(digest, r[0])
    return sorted(out, key=str)


ROWS = [
    (5, "http://a.example/x", "<p>one</p>", "o"), (3, "http://b.example/", "<p>one</p>", "o"), (9, "http://b.example/", "<p>öne</p>", "o"), (4, None, None, "o"), (8, "", "", "o"),
    (3, "http://b.example/", "<p>one</p>", "o"), (3, "http://a.example/", "<p>one</p>", "o"), (2, "http://two.example/a b\r\nc", "x\r\n\r\nWARC/1.1\r\n\r\ny", "o"), (2, "http://two.example/a b\r\nc", "x\r\n\r\nWARC/1.1\r\n\r\ny", "o"),
    (None, "http://n.example/", "<p>none</p>", "o"), (None, "http://n.example/", "<p>none</p>", "o"), (7, "http://big.example/", "long " * 400_000, "o"), (6, "http://big.example/", "long " * 400_000, "o"),
]


@pytest.mark.parametrize("least", [0, 8])
def test_pages_come_back(spark, tmp_path, least):
    got = [tuple(r) for r in warc.archived(pages(spark, ROWS), str(tmp_path / "w"), least).collect()]
    assert sorted(got, key=str) == plain(ROWS, least)


def test_many_copies_and_hot_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, f"http://h{k % 7}.example/{k}", f"<p>{rng.randint(0, 40)}</p>", "") for k in range(900)] + [(1, "http://same.example/", "hot", "")] * 300
    rng.shuffle(rows)
    got = [tuple(r) for r in warc.archived(pages(spark, rows), str(tmp_path / "w")).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_archives_are_gzip_and_warc(spark, tmp_path):
    warc.write_archives(pages(spark, ROWS), str(tmp_path / "w"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert text.count(b"WARC/1.1\r\nWARC-Type: re") == len(ROWS)
    rest, n = text, 0
    while rest:
        head, _, rest = rest.partition(b"\r\n\r\n")
        size = next(int(x.split(b": ")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))
        assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        rest, n = rest[size + 4 :], n + 1
    assert n == len(ROWS)


def test_lookups_by_url(spark, tmp_path):
    rows = [(k, f"https://h{k % 9}.example.org:443/p{k % 50}?q=1#f", f"<p>{k}</p>", "") for k in range(700)] + [(1000 + k, "http://one.example/all", f"{k}", "") for k in range(120)]
    warc.write_archives(pages(spark, rows), str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w"))
    index = warc.build_index(records, str(tmp_path / "i"), block_lines=16)
    urls = ["http://one.example/all", "http://H3.example.org/p3?q=1", "http://h3.example.org/p", "http://zzz.example/", "http://0.example/", "http://one.example/al", None]
    got = {(r.want, r.page_id) for r in warc.captures(index, spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    want = {("example,one)/all ", 1000 + k) for k in range(120)} | {("org,example,h3)/p3?q=1 ", k) for k in range(700) if k % 9 == 3 and k % 50 == 3}
    assert got == want and index.directory.count() >= 820 // 16


def test_keys():
    assert warc.url_key("http://www.Example.com/a?b#c") == "com,example,www)/a?b"
    assert warc.url_key("https://me@x.org:8443") == "org,x:8443)/" and warc.url_key("urn:a") == "urn:a"


def test_empty_table(spark, tmp_path):
    assert warc.archived(pages(spark, []), str(tmp_path / "w")).collect() == []
