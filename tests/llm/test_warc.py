import gzip
import hashlib
import io
import random

import duckdb
import pytest

from basketlens.llm import queries, warc

from .util import SF, docs_frame

SCHEMA = "page_id long, url string, html string"


def pages(seed=0, n=60):
    rng = random.Random(seed)
    hot = "hot " * 300
    rows = [(i, f"http://x/{i}", hot if i % 3 == 0 else "é" * rng.choice([0, 3, 600]) + str(rng.randrange(4)) * rng.choice([5, 999, 1000, 1001])) for i in range(n)]
    rows += [(1000, None, None), (1001, "u\r\nx: y", ""), (1002, "big", "big page " * 100_000), (1003, "a", "same" * 249), (1004, "b", "same" * 249),
             (1005, "a", "SAME" * 250), (1006, "b", "SAME" * 250), (1006, "b", "SAME" * 250), (None, "n", "no id " * 200)]
    return rows


def expected(rows):
    by = {}
    for i, _, h in rows:
        by.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((x for x in by[h or ""] if x is not None), default=None)
        revisit = len(raw) >= 1000 and i != top and len(by[h or ""]) > 1 and top is not None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [500, 4096, 32 << 20])
def test_round_trip(spark, split):
    rows = pages()
    manifest = warc.write(docs_frame(spark, rows, SCHEMA))
    assert sum(r.records for r in manifest.collect()) == len(rows)
    out = warc.read(manifest, split_bytes=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == expected(rows)
    text = {(i, (h or "").encode()) for i, _, h in rows}
    for r in out:
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or (r.page_id, bytes(r.payload)) in text)
    assert {r.page_id: r.url for r in out}[1001] == "u%0D%0Ax: y" and {r.page_id: r.url for r in out}[1000] is None


def test_archives_are_standard_gzip_with_one_member_a_record(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2_000)
    manifest = warc.write(docs_frame(spark, pages(1, 30), SCHEMA))
    files = manifest.collect()
    assert len(files) > 3
    for f in files:
        with open(f.path.removeprefix("file:"), "rb") as src:
            raw = src.read()
        assert len(raw) == f.bytes and gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type: ") == f.records
    assert warc.read(manifest, payloads=False).count() == len(pages(1, 30))


@pytest.mark.parametrize("step", [1, 13, 256, 10_000])
def test_every_record_is_owned_by_the_range_it_starts_in(step):
    rng = random.Random(step)
    raws = [rng.randbytes(rng.choice([0, 10, 3000])) + warc.MAGIC + b"\x00\x00" + warc.encode_record(7, "u", b"inner") for _ in range(12)]  # members within members
    blob = b"".join(warc.encode_record(i, f"u{i}", p) for i, p in enumerate(raws))
    seen = []
    for start in range(0, len(blob), step):
        seen += [warc.decode_record(r) for r in warc.scan_range(io.BytesIO(blob), len(blob), start, min(len(blob), start + step))]
    assert [(r[0], r[6]) for r in seen] == list(enumerate(raws))


def test_false_magic_and_damage():
    good = warc.encode_record(1, "u", random.Random(1).randbytes(3000))
    junk = b"xx" + warc.MAGIC + b"not a member" + gzip.compress(b"a member, but no record")
    assert [warc.decode_record(r)[0] for r in warc.scan_range(io.BytesIO(junk + good), len(junk + good), 0, len(junk + good))] == [1]
    with pytest.raises(Exception):
        [warc.decode_record(r) for r in warc.scan_range(io.BytesIO(good[:1000] + b"\0" * 40 + good[1040:]), len(good), 0, len(good))]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.scan_range(io.BytesIO(good[:-100]), len(good) - 100, 0, len(good)))


def test_empty_table(spark):
    manifest = warc.write(docs_frame(spark, [], SCHEMA))
    assert manifest.count() == 0 and warc.read(manifest).count() == 0


def test_extra_columns(spark):
    df = docs_frame(spark, [(1, "u", "h", "x", True)], SCHEMA + ", payload string, revisit boolean")
    assert [(r.page_id, bytes(r.payload)) for r in warc.read(warc.write(df)).collect()] == [(1, b"h")]


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({queries.OP9_SQL}) ORDER BY page_id").fetchall()
    assert [tuple(r) for r in queries.QUERIES["op9_warc"](spark, SF).orderBy("page_id").collect()] == want
