import hashlib
import random

from pyspark.sql import functions as F

from shotlab.llm import common, warc
from tests.conftest import SF01

SCHEMA = "page_id long, url string, html string, payload string, gap int, digest string"


def rows():
    long = "é" * 60
    return [(5, "http://a", long, "x", 1, "y"), (3, "http://b\r\nWARC/1.1", long, "x", 1, None), (9, None, long, None, None, None), (7, "", "short", None, None, None),
            (8, "u", "short", None, None, None), (1, "u", None, None, None, None), (2, "u", "", None, None, None), (None, "u", long, None, None, None), (3, "u", long, None, None, None),
            (11, "u", "WARC/1.1\r\n\r\n" * 50 + "\x1f\x8b\x08", None, None, None), (12, "u", "z" * 3_000_000, None, None, None), (None, "u", "q" * 200, None, None, None), (None, "u", "q" * 200, None, None, None)]


def expected(pages):
    first = {}
    for i, _, h, *_ in pages:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, _, h, *_ in pages:
        raw = (h or "").encode()
        to = first.get(raw)
        to = None if to == i else to
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_edge_cases(spark):
    for options in ({}, {"compressed": False}, {"roll_bytes": 1}):
        got = warc.round_trip(spark.createDataFrame(rows(), SCHEMA).repartition(3), **options).drop("url").collect()
        assert sorted(map(tuple, got), key=str) == expected(rows())
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark):
    p = common.table(spark, SF01, "pages")
    got = warc.round_trip(p).drop("url").collect()
    assert sorted(map(tuple, got), key=str) == expected([tuple(r) for r in p.select("page_id", "url", "html").collect()])


def archive(n, compressed):
    import zlib
    out, at = [], []
    for i in range(n):
        body = f"<p>{i} ".encode() + bytes(f"WARC/1.1 {i}\r\n", "ascii") * (i % 5)
        raw = warc.record(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None, "1970-01-01T00:00:00Z")
        if compressed and i % 3:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = z.compress(raw) + z.flush()
        at.append(sum(map(len, out)))
        out.append(raw)
    return b"".join(out), at + [sum(map(len, out))]


def test_salvage_recovers_every_whole_record():
    rnd = random.Random(7)
    for trial in range(40):
        data, at = archive(30, trial % 2)
        hurt, bad = bytearray(data), set()
        for i in rnd.sample(range(30), 6):
            where = rnd.randrange(at[i], at[i + 1])
            hurt[where] ^= 0x5A
            bad.add(i)
        found = list(warc.salvage_bytes(bytes(hurt)))
        assert [x[1] for x in found[1:]] == [x[2] for x in found[:-1]] and found[0][1] == 0 and found[-1][2] == len(data)
        ids = [x[4]["page_id"] for x in found if not x[0]]
        assert set(range(30)) - bad <= set(ids) and len(ids) == len(set(ids))
        assert all(x[3] for x in found if x[0])


def test_cut_file_and_garbage():
    data, at = archive(10, True)
    found = list(warc.salvage_bytes(b"junk" + data[:at[9] + 10]))
    assert [x[4]["page_id"] for x in found if not x[0]] == list(range(9))
    assert [(x[1], x[2]) for x in found if x[0]] == [(0, 4), (4 + at[9], 4 + at[9] + 10)]
    assert list(warc.salvage_bytes(b"")) == []


def test_gaps_are_logged(spark, tmp_path):
    data, at = archive(10, True)
    (tmp_path / "a.warc.gz").write_bytes(data[:at[3] + 20] + data[at[4]:])
    found = warc.salvage(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string"), payloads=True)
    assert found.where("not gap").count() == 9 and found.where(F.col("payload").isNotNull()).count() == 9
    gap = found.where("gap").collect()
    assert [(g["at"], g["end"]) for g in gap] == [(at[3], at[3] + 20)] and gap[0]["reason"]
