import gzip
import hashlib
import io

import pytest

from voltide.llm import warc


def expect(rows):
    best = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            best[b] = max(p, best.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        keep = best.get(b)
        revisit = keep is not None and keep != p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    big, mid = "é<p>" * 30_000, "x" * 1000
    rows = [(1, "u", big), (2, None, big), (3, "http://a/\r\nb", mid), (9, "v", mid), (9, "v", mid), (4, "w", "y" * 999), (5, "w", "y" * 999), (6, "", None), (7, "z", ""), (None, "z", mid), (8, "s", "0\r\n\r\n" * 400)]
    df = spark.createDataFrame([(*r, "more") for r in rows], "page_id long, url string, html string, Digest string").repartition(3)
    got = warc.round_trip(df)
    assert got.where("error is not null").count() == 0
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == expect(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_segments_out_of_order_and_damage():
    parts = [(2, b"cd", None), (1, b"ab", None), (3, b"e", 5)]
    assert warc.join_segments(parts) == (b"abcde", None)
    assert warc.join_segments(parts[:2])[1] == "no last segment"
    assert "missing" in warc.join_segments(parts[1:])[1]
    assert "missing" in warc.join_segments([*parts, parts[0]])[1]
    assert "total" in warc.join_segments([(1, b"a", 3)])[1]


def test_chunks():
    for body in (b"", b"a", b"x" * 9999, b"0\r\n\r\n"):
        assert warc.unchunk(warc.chunked(body, 100)) == body
    assert warc.unchunk(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"5\r\nab\r\n0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.unchunk(bad)


def test_records_are_standard_gzip_members():
    raw = b"".join(warc.page_records(5, "http://a", b"q" * 5000, hashlib.sha1(b"q" * 5000).hexdigest(), None, "<urn:x>", 1000, 300))
    records = list(warc.parse_records(gzip.GzipFile(fileobj=io.BytesIO(raw))))
    assert len(records) > 4 and records[0][0]["warc-type"] == "response" and {h["warc-type"] for h, _ in records[1:]} == {"continuation"}
    assert warc.decode(b"".join(b for _, b in records), None)[0] == 5000
