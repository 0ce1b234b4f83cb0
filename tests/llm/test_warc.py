import base64
import gzip
import hashlib
import re
from pathlib import Path

import pytest

from clickloom.llm import warc

ROWS = [
    (1, "u1", "same"), (2, "u2", "same"), (3, None, "same"), (4, "a\r\nX: y", None), (5, "", ""), (6, "u", "A\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nB\r\n"),
    (7, "u", "\r\n\r\nWARC/1.0\r\n"), (7, "u", "\r\n\r\nWARC/1.0\r\n"), (8, "u", "é日😀" * 20_000), (9, "u", "end\r\n\r\n"), (10, "u", "end\r\n"), (11, "u", "end\r\n\r\nWARC/1.0"), (None, "u", "same"), (None, "u", "alone"),
]


def expected(rows, least=0):
    best = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        other = best.get(h or "") if best.get(h or "") != i else None
        out.append((None if i is None else str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other is not None else "response", None if other is None else str(other)))
    return sorted(out, key=repr)


def got(df):
    rows = df.collect()
    assert all(r.sound for r in rows)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "c", "c") for r in rows], "page_id bigint, url string, html string, payload string, record_type string").repartition(3)


def test_round_trip(spark, tmp_path):
    for name, least in (("a", 0), ("b", 5)):
        assert warc.write(warc.resolve(pages(spark), min_bytes=least), f"{tmp_path}/{name}") == len(ROWS)
        assert got(warc.read(spark, f"{tmp_path}/{name}")) == expected(ROWS, least)
    full = {r.page_id: r.payload for r in warc.read(spark, f"{tmp_path}/a", payload=True).where("record_type = 'response'").collect()}
    assert full["8"].decode() == ROWS[8][2] and full["7"] == b"\r\n\r\nWARC/1.0\r\n"


def test_files_are_warc(spark, tmp_path):
    warc.write(warc.resolve(pages(spark, ROWS[:3])), f"{tmp_path}/w")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").glob("*.gz"))
    n = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.0\r\n")
        size = int(head.rpartition(b"Content-Length: ")[2])
        assert rest[size : size + 4] == b"\r\n\r\n"
        raw, n = rest[size + 4 :], n + 1
    assert n == 3


def test_headers_are_fresh(spark, tmp_path):
    """Record ids are unique, revisits name the response's, dates are of the writing."""
    warc.write(warc.resolve(pages(spark)), f"{tmp_path}/h")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "h").glob("*.gz"))
    ids = re.findall(rb"WARC-Record-ID: (\S+)", raw)
    assert len(set(ids)) == len(ids) == len(ROWS) and all(re.fullmatch(rb"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", i) for i in ids)
    same = [h for h in raw.split(b"WARC/1.0\r\n") if b"WARC-Target-URI: u3\r\n" in h or b"X-Page-Id: 3\r\n" in h][0]
    refers = set(re.findall(rb"WARC-Refers-To: (\S+)", raw))
    assert refers <= set(ids) and re.search(rb"WARC-Record-ID: (\S+)", same)[1] in refers
    assert b"WARC-Date: 1970" not in raw


def test_a_short_archive_is_an_error(spark, tmp_path):
    warc.write(warc.resolve(pages(spark, [(i, "u", f"payload {i} " * 50) for i in range(3)]).coalesce(1)), f"{tmp_path}/s")
    (file,) = [p for p in Path(tmp_path, "s").glob("*.gz") if len(gzip.decompress(p.read_bytes()))]
    raw = gzip.decompress(file.read_bytes())
    Path(tmp_path, "cut").mkdir()
    for cut in (60, 700, len(raw) - 40):
        Path(tmp_path, "cut", "a.gz").write_bytes(gzip.compress(raw[:-cut]))
        with pytest.raises(Exception, match="ends inside a record|without whole headers"):
            warc.read(spark, f"{tmp_path}/cut").collect()


def test_empty(spark, tmp_path):
    warc.write(warc.resolve(pages(spark).where("false")), f"{tmp_path}/e")
    assert warc.read(spark, f"{tmp_path}/e").count() == 0


def test_query(spark, sf):
    from clickloom.llm.queries import op6_warc_revisits

    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    mine = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else str(r.refers_to)) for r in op6_warc_revisits(spark, sf).collect()), key=repr)
    assert mine == expected(rows)
