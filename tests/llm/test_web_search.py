import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from revoicer.llm import nearest, url_filter, warc

PAGES = [
    (1, "http://a.example.com/x?q=1", "<p>one</p>"), (2, "https://B.example.com/y#f", "<p>two</p>"), (3, "http://a.example.com/x?q=1", "<p>one</p>"), (4, None, None), (5, "", ""), (6, "http://u:p@c.org:8080/p/q/r/s", "é" * 5000),
    (7, "nothing", "<p>one</p>"), (7, "nothing", "<p>one</p>"), (8, "http://a.example.com/new\nline", "x"), (None, "http://d.net/", "<p>two</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as hash", "3 as size", "4 as file")


def expected(min_bytes=0):
    newest = {}
    for i, _, h in PAGES:
        if i is not None:
            newest[h or ""] = max(newest.get(h or "", i), i)
    out = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        full = len(raw) < min_bytes or newest.get(h or "") in (i, None)
        out.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if full else "revisit", str(None if full else newest[h or ""])))
    return sorted(out)


@pytest.mark.parametrize("min_bytes,block", [(0, 512), (0, 2), (5, 1)])
def test_archives(pages, min_bytes, block, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", block)
    folder = warc.archive_folder(pages)
    files = warc.write_archives(pages, folder, min_bytes, archives=3)
    rows = warc.read_archives(files, folder, payloads=True).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in rows) == expected(min_bytes)
    texts = {(i, (h or "").encode()) for i, _, h in PAGES}
    assert all((r.page_id, bytes(r.payload)) in texts for r in rows if r.record_type == "response")
    fs, root = warc.file_system(folder)
    from pyarrow import fs as afs

    found = [f for f in fs.get_file_info(afs.FileSelector(root)) if f.path.endswith(".warc.gz")]
    whole = b"".join(gzip.decompress(fs.open_input_file(f.path).read()) for f in found)
    assert whole.count(b"WARC/1.1\r\n") == len(PAGES)


def test_lookup(spark, pages):
    folder = warc.archive_folder(pages)
    files = warc.write_archives(pages, folder, archives=2)
    asked = spark.createDataFrame([("http://a.example.com/x?q=1",), ("https://b.EXAMPLE.com/y",), ("http://none.example.com/",), (None,)], "url string")
    got = sorted((str(r.asked), str(r.page_id)) for r in warc.lookup(files, folder, asked).collect())
    assert got == [("None", "4"), ("None", "5"), ("http://a.example.com/x?q=1", "1"), ("http://a.example.com/x?q=1", "3"), ("https://b.EXAMPLE.com/y", "2")]


def test_no_pages(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damaged_records_raise():
    raw = warc.record_bytes(1, "http://a/", b"body", warc.sha1(b"body"), None)
    assert warc.parsed(raw)["payload"] == b"body"
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(raw.replace(b"body", b"bady"))


# ---- dated lists ------------------------------------------------------------


def test_intervals_and_verdicts(spark):
    entries = spark.createDataFrame([("example.com", "block", 10), ("example.com", "remove", 20), ("a.example.com", "allow", 12), ("a.example.com/x", "block", 15), ("org", "block", 0), (None, "block", 0), ("b.example.com", "block", None)], "key string, action string, at long")
    rows = [(1, "http://b.example.com/", 9), (1, "http://b.example.com/", 10), (2, "http://b.example.com/", 20), (3, "http://A.example.com/y", 13), (4, "http://a.example.com/x/z", 15), (5, "http://a.example.com/xx", 15), (6, "https://u@c.org:1/", 5), (7, None, 5), (8, "odd", 5), (9, "http://c.org/", None), (6, "https://u@c.org:1/", 5)]
    captures = spark.createDataFrame(rows, "id long, url string, fetched_at long").selectExpr("*", "1 as key", "2 as level", "3 as salt")
    out = url_filter.judge(captures, entries).collect()
    got = sorted((r.id, str(r.fetched_at), r.verdict, str(r.key), r.n_active) for r in out)
    assert got == sorted([
        (1, "9", "none", "None", 0), (1, "10", "block", "example.com", 1), (2, "20", "none", "None", 0), (3, "13", "allow", "a.example.com", 2), (4, "15", "block", "a.example.com/x", 3), (5, "15", "allow", "a.example.com", 2),
        (6, "5", "block", "org", 1), (6, "5", "block", "org", 1), (7, "5", "none", "None", 0), (8, "5", "none", "None", 0), (9, "None", "none", "None", 0),
    ])
    assert {r.verdict for r in url_filter.judge(captures, entries.limit(0)).collect()} == {"none"} and url_filter.judge(captures.limit(0), entries).count() == 0


# ---- nearest ----------------------------------------------------------------


def brute(rows, step, top):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [g for k, g in enumerate(good) if not any(i == g[0] and (w == g[1]).all() for i, w in good[:k])]
    out = []
    for q, x in good:
        if q % step == 0:
            near = sorted((-float(x @ y), i) for i, y in good if i != q)[:top]
            out += [(q, k + 1, i, round(-s, 9)) for k, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 40])
def test_nearest(spark, block, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "QUERIES", 7)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=16).astype(np.float32)]) for i in range(200)]
    rows += [(300 + i, rows[40][1]) for i in range(60)]  # one vector many times: ties
    rows += [(400, None), (401, [0.0] * 16), (420, [float("nan")] * 16), (440, [None] * 16), (460, [1.0] * 3), (None, rows[0][1]), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as block", "3 as ids")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in nearest.search(df).collect())
    want = brute(rows, 20, 20)
    assert len(got) == len(want) and len({g[:3] for g in got} & {w[:3] for w in want}) >= 0.98 * len(want)
    assert nearest.search(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in nearest.search(few).collect()] == [(0, 1, 4.0)]


def test_estimates_are_unbiased_within_bounds():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(500, 64)), rng.normal(size=(40, 64))
    centre, turn = x.mean(axis=0), nearest.rotation(64)
    guess, deviation = nearest.estimate(nearest.Codes(*nearest.encode(x, centre, turn)), q, centre, turn)
    off = (guess - q @ x.T) / deviation
    assert abs(off.mean()) < 0.1 and 0.7 < off.std() < 1.3 and (np.abs(off) < nearest.WIDTH).mean() > 0.95


def test_column_functions(spark):
    r = spark.range(1).select(warc.url_key(F.lit("HTTP://u:p@A.b.Com:80/x?y#z")).alias("k"), url_filter.url_keys(F.lit("http://a.b.com/p/q"), 9).alias("u")).first()
    assert r.k == "com,b,a)/x?y" and r.u == ["com", "b.com", "a.b.com", "a.b.com/p", "a.b.com/p/q"]


def test_deep_paths_addresses_and_long_histories(spark):
    entries = [("h.com/a/b/c/d/e", "block", 5), ("[2001:db8::1]", "block", 0)] + [("long.com", "block" if t % 2 else "remove", t) for t in range(300)]
    captures = [(1, "http://h.com/a/b/c/d/e/f", 5), (2, "http://h.com/a/b/c/d", 9), (3, "http://[2001:DB8::1]:8080/x", 1), (4, "http://long.com/", 7), (5, "http://long.com/", 8), (6, "http://h.com/a/b/c/d/e", 4)]
    out = url_filter.judge(spark.createDataFrame(captures, "id long, url string, fetched_at long"), spark.createDataFrame(entries, "key string, action string, at long")).collect()
    assert {r.id: r.verdict for r in out} == {1: "block", 2: "none", 3: "block", 4: "block", 5: "none", 6: "none"}


def test_odd_urls_come_back(spark):
    urls = ["http://x.com/a\r\nb", "http://x.com/a", "http://x.com/a#1", "http://x.com/a#2", "http://[::1]:80/z", None, "", " no url ", "http://y/\u00e9\n"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert {r.page_id: r.url for r in warc.round_trip(pages).collect()} == dict(enumerate(urls))
    assert pages.select(warc.url_key(pages.url)).collect()[4][0] == "[::1])/z"
