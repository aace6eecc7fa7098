import io
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shotlab.llm import common, pfor
from shotlab.llm.tokens import tokenizer, word_bpe
from tests.conftest import SF01
from tests.llm import data


def expected(docs):
    tok, out, at = tokenizer(word_bpe()), [], 0
    for i, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_whole_table(spark):
    d = common.table(spark, SF01, "documents")
    docs = sorted(tuple(r) for r in d.select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in pfor.round_trip(d, file_bytes=200_000).collect())
    assert got == expected(docs)


def test_edge_cases(spark):
    some = data.rows()
    docs = sorted(((r[0], r[1]) for r in some), key=lambda r: (r[0] is not None, r[0]))
    for per_file in (400, 1 << 20):
        got = pfor.round_trip(data.docs(spark, some), file_bytes=per_file).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(docs)
    assert pfor.round_trip(data.empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 49407), st.integers(0, 2**32 - 1)), max_size=1500))
def test_blocks_round_trip(ids):
    a = np.array(ids, np.uint32)
    blocks = pfor.encode_blocks(a)
    assert pfor.decode_blocks(b"".join(blocks), len(blocks)).tolist() == ids


def test_range_reads_use_the_index(tmp_path):
    rnd, docs = random.Random(2), []
    out = io.BytesIO()
    w = pfor.Writer(out)
    for i in range(400):
        ids = np.array([rnd.randrange(49408) if rnd.random() < 0.1 else rnd.randrange(500) for _ in range(rnd.choice([0, 1, 700, 3000]))], np.uint32)
        docs.append(ids)
        w.add(i, ids)
    w.close()
    path = tmp_path / "x.pfor"
    path.write_bytes(out.getvalue())
    r, every = pfor.Reader(str(path)), np.concatenate(docs)
    assert r.n == len(every) and len(out.getvalue()) < 4 * len(every)
    for _ in range(50):
        at = rnd.randrange(len(every))
        n = rnd.randrange(min(5000, len(every) - at) + 1)
        assert (r.read_range(at, n) == every[at:at + n]).all()
    assert r.checksums().tolist() == [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
