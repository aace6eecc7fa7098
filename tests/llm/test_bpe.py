import hashlib
import random

from shotlab.llm import bpe, common
from shotlab.llm.tokens import ODD, WordEncoder, tokenizer, word_bpe
from tests.conftest import SF01
from tests.llm import data


def expected(docs):
    tok, sha = tokenizer(word_bpe()), lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def test_whole_table_equals_the_library(spark):
    d = common.table(spark, SF01, "documents")
    want = expected([tuple(r) for r in d.select("doc_id", "text").collect()])
    for words in (5000, 0):  # the lexicon changes no result
        assert sorted(map(tuple, bpe.report(d, lexicon_words=words).collect()), key=str) == want


def test_edge_cases(spark):
    some = data.rows()
    assert sorted(map(tuple, bpe.report(data.docs(spark, some)).collect()), key=str) == expected([r[:2] for r in some])
    assert bpe.report(data.empty(spark)).count() == 0


def test_transducer_is_minimal_and_exact():
    rnd = random.Random(5)
    entries = {"".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 7))): tuple(rnd.randrange(9) for _ in range(rnd.randint(1, 4))) for _ in range(600)}
    lex = bpe.Lexicon(bpe.compile_lexicon(entries))
    words = [*entries, "", "zz", "abcabcabcabc", "é", "a" * 300]
    assert lex.lookup(words) == [entries.get(w) for w in words]
    # right languages of states, by brute force: as many as states
    def below(prefix, tails):
        return frozenset(t[len(prefix):] for t in tails if t.startswith(prefix))
    raw = [w.encode() for w in entries]
    prefixes = {w[:i] for w in raw for i in range(len(w) + 1)}
    assert len({below(p, raw) for p in prefixes}) == len(lex.final)
    none = bpe.Lexicon(bpe.compile_lexicon({}))
    assert none.lookup(["a", ""]) == [None, None]


def test_merge_equals_the_library_model():
    tok, voc, rnd = tokenizer(word_bpe()), bpe.vocabulary(word_bpe()), random.Random(6)
    for _ in range(2000):
        w = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéüñßœ") for _ in range(rnd.randint(1, 14)))
        assert list(voc.merge(w)) == tok.encode(w, add_special_tokens=False).ids, w


def test_frequent_words_stay_within_the_bound(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + 1000 // (i + 1)) for i in range(300)], "word string, n long")
    for most in (0, 1, 5, 40, 1000):
        got = {r.word for r in bpe.frequent(counts, most).collect()}
        assert len(got) <= most and got == {f"w{i}" for i in range(len(got))}
    assert bpe.frequent(counts, 1000).count() == 300 and bpe.frequent(counts, 40).count() > 30


def test_encode_returns_ids_and_texts(spark):
    tok = tokenizer(word_bpe())
    some = [r for r in data.rows() if r[0] != 7]
    got = bpe.encode(data.docs(spark, some), bpe.build_lexicon(data.docs(spark, some), lexicon_words=20)).collect()
    want = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in some]
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == sorted((str(i), ids, tok.decode(ids, skip_special_tokens=False)) for i, ids in want)


def test_every_plain_code_point_equals_the_library():
    tok, words, voc = tokenizer(word_bpe()), WordEncoder(word_bpe()), bpe.vocabulary(word_bpe())
    cs = [c for c in map(chr, range(0x250)) if not ODD.search(c)]
    assert len(cs) > 500
    for c in [*cs, "Ə", "Ɓ", "Ⱥ"]:
        for text in (c, f"a{c}b", f"{c}li baki", f"X{c}", f"1{c} {c}{c}'s", f"BAKI {c}LI"):
            want = tok.encode(text, add_special_tokens=False).ids
            assert words.ids(text).tolist() == want, (hex(ord(c)), text)
            assert [i for w in voc.segments(text) for i in voc.merge(w)] == want, (hex(ord(c)), text)


def test_one_very_long_word_equals_the_library():
    """100 000 letters without a space, and words around the length from which a heap is used."""
    import random
    import time

    from shotlab.llm.bpe import LONG, vocabulary
    from shotlab.llm.tokens import tokenizer, word_bpe

    rnd = random.Random(3)
    voc, tok = vocabulary(word_bpe()), tokenizer(word_bpe())
    words = ["".join(rnd.choices("etaoinshrdlu", k=n)) for n in (LONG - 1, LONG, LONG + 1, 300, 5000)] + ["ab" * 2000, "a" * 3001]
    for w in words:
        assert list(voc.merge(w)) == tok.encode(w, add_special_tokens=False).ids
    long, start = "".join(rnd.choices("etaoinshrdlu", k=100_000)), time.time()
    assert list(voc.merge(long)) == tok.encode(long, add_special_tokens=False).ids and time.time() - start < 20
