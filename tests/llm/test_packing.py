import random
import zlib
from collections import defaultdict

import numpy as np

from shotlab.llm import common, packing
from shotlab.llm.tokens import WordEncoder, tokenizer, word_bpe
from tests.conftest import SF01
from tests.llm import data


def check(docs, got, size):
    """Pieces, checksums and gapless sequences against the library's ids."""
    tok, want = tokenizer(word_bpe()), []
    for i, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, at, len(ids[at:at + size]), zlib.crc32(ids[at:at + size].tobytes())) for k, at in enumerate(range(0, len(ids), size))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= size
    return len(bins), sum(r.length for r in got)


def test_whole_table(spark):
    d = common.table(spark, SF01, "documents")
    bins, total = check([tuple(r) for r in d.select("doc_id", "text").collect()], packing.pack(d).collect(), 2048)
    assert bins <= 1.01 * total / 2048 + 1


def test_edge_cases(spark):
    some = data.rows()
    check([(r[0], r[1]) for r in some], packing.pack(data.docs(spark, some), size=64).collect(), 64)
    assert packing.pack(data.empty(spark)).count() == 0


def test_plan_uses_every_piece_once():
    rnd = random.Random(3)
    for size in (1, 7, 64, 300):
        counts = [0] + [rnd.choice([0, 0, 1, 2, 50, 1000]) for _ in range(size)]
        bins, used = packing.plan(counts, size), [0] * (size + 1)
        for repeats, content in bins:
            assert sum(n * t for n, t in content) <= size
            for n, t in content:
                used[n] += repeats * t
        assert used == counts


def test_two_fit_finds_the_tightest_pair():
    rnd = random.Random(4)
    for _ in range(300):
        size = rnd.randint(2, 30)
        left = np.array([0] + [rnd.choice([0, 0, 1, 2]) for _ in range(size)])
        gap = rnd.randint(1, size)
        best = max((a + b for a in range(1, gap) for b in range(a, gap) if left[a] and left[b] and (a != b or left[a] > 1) and a + b <= gap), default=None)
        got = packing.two_fit(left, gap)
        assert (sum(got) if got else None) == best
        if got:
            assert left[got[0]] and left[got[1]] and (got[0] != got[1] or left[got[0]] > 1)


def test_second_fit_beats_greedy():
    assert len(packing.plan([0, 0, 0, 0, 3, 0, 1, 0], 10)) >= 1
    counts = [0] * 11
    for n in (6, 3, 2, 2):
        counts[n] += 1
    assert packing.plan(counts, 10)[0] == (1, [(6, 1), (2, 2)])


def test_encoder_equals_the_library():
    tok, enc = tokenizer(word_bpe()), WordEncoder(word_bpe(), memo=10)
    texts = [r[1] or "" for r in data.rows() if r[0] != 7] + ["don't we've I'll 's 'S x² ½ ª ٣", "''s !'s 4a5b ×÷ ǅ ŉ ǰ ẞ ſ", "ΑΣ ς a<|b <|endoftext|>x", "\xa0c\x0bd"]
    for t in texts:
        assert enc.ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids, t
