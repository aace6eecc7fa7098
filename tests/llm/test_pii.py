import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shotlab.llm import common, pii
from tests.conftest import SF01
from tests.llm import data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if max(map(int, m[0].split("."))) <= 255]
    for m in CARD.finditer(text):
        d = digits(m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a.Z@-+ 0123459()%é\n"), max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    assert pii.base_spans("1" * 300_000 + "a@" * 100_000 + "+1 " * 50_000 + "x" * 300_000) == []


CORPUS = [f"hello user{i}.{i}x@mail{i}.example.com and +1 ({200 + i}) 555-{1000 + i} from {i}.2.3.{i} version {i}.0 text, license 4.0. a{i}b9c{i}d" for i in range(60)]


def test_labels_reach_distant_mentions():
    w = pii.train(CORPUS)
    text = "Ring +1 (415) 555-0199 now. " + "words and more " * 50 + "Or 555-0199, write to ann.lee99@mail.example.com or ann.lee99 there; version 2.0, code 7770199."
    base = pii.base_spans(text)
    found = {(pii.KINDS[k], text[a:b]) for k, a, b in pii.added_spans(text, base, w)}
    assert ("phone", "555-0199") in found and ("email", "ann.lee99") in found
    assert not any("2.0" in s or "777" in s for _, s in found)


def test_clean_texts_get_nothing():
    w = pii.train(CORPUS)
    for text in ("", "no data here", "version 2.0 and 2.0 again, 12345678 12345678", "password=b7db7aa4a5fcc78305 token b7db7aa4a5fcc78305"):
        assert pii.added_spans(text, pii.base_spans(text), w) == []


def test_message_passing_is_exact_on_trees():
    rnd = np.random.default_rng(3)
    g = pii.Graph([(i, i + 1) for i in range(5)], rnd.normal(size=(5, len(pii.SHAPES))), np.zeros(5, int), np.array([[0, 1, 0], [1, 2, 0], [1, 4, 1], [0, 3, 2]]))
    w = pii.Weights(rnd.normal(size=(len(pii.SHAPES), 5)) * 0.3, rnd.normal(size=(5, 5)), np.array([0, 1.5, 0.7]))
    table, unary, want = pii.potentials(w), g.x @ w.unary, np.zeros((5, 5))
    for y in itertools.product(range(5), repeat=5):
        p = np.exp(sum(unary[i, y[i]] for i in range(5)) + sum(table[t][y[a], y[b]] for a, b, t in g.edges))
        for i in range(5):
            want[i, y[i]] += p
    got = pii.marginals(g, w, rounds=200)
    assert np.abs(got - want / want.sum(axis=1, keepdims=True)).max() < 1e-3


def test_message_passing_on_loops_is_near_enumeration():
    rnd = np.random.default_rng(5)
    for _ in range(20):
        edges = np.array([[0, 1, 0], [1, 2, 0], [2, 3, 1], [0, 3, 2], [0, 2, 1], [3, 4, 2]])
        g = pii.Graph([(i, i + 1) for i in range(5)], rnd.normal(size=(5, len(pii.SHAPES))), np.array([0, 0, 0, 0, 2]), edges)
        w = pii.Weights(rnd.normal(size=(len(pii.SHAPES), 5)) * 0.3, rnd.normal(size=(5, 5)) * 0.3, np.array([0, 0.6, 0.4]))
        table, unary, want = pii.potentials(w), g.x @ w.unary, np.zeros((5, 5))
        for y in itertools.product(range(5), repeat=4):
            y = (*y, 2)  # the last token lies in a base span: its label is fixed
            p = np.exp(sum(unary[i, y[i]] for i in range(5)) + sum(table[t][y[a], y[b]] for a, b, t in g.edges))
            for i in range(5):
                want[i, y[i]] += p
        got = pii.marginals(g, w, rounds=200)
        assert np.abs(got - want / want.sum(axis=1, keepdims=True)).max() < 0.05


PEOPLE = [f"text {i} ann{i}.x@mail{i}.example.com rang +1 ({200 + i}) 555-{1000 + i} paid 4111 1111 1111 1111 from {i}.2.3.{i} on 2021-03-{10 + i % 18} for {i}.50, code {7 * i}." for i in range(80)]


def test_reformatted_and_shortened_mentions():
    w = pii.train(PEOPLE)

    def added(text):
        return {(pii.KINDS[k], text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text), w)}

    assert {("phone", "415 555 0199"), ("phone", "(415) 555-0199")} <= added("Call +1 415 555 0199 today. Later dial 415 555 0199 or (415) 555-0199 please.")
    assert ("card", "4111.1111.1111.1111") in added("Paid with 4111 1111 1111 1111 and again 4111.1111.1111.1111 in 2019.")
    assert added("Write ann.lee@mail.example.com; ann.lee will answer. Contact info@x.org for info.") == {("email", "ann.lee")}
    assert added("Order 4155550199 shipped 2023-01-15 at 12:30, 5 of 10, version 2.0.1 and @home price 19.99, 1 2 3 4") == set()
    assert added("host 300.1.2.3 and 9807915762804490 twice 9807915762804490") == set()


def test_repeats_without_a_base_span():
    """Mentions in a form no pattern knows back one another; one alone is not sure enough."""
    w = pii.train(PEOPLE)
    for number, want in (("4111/1111/1111/1111", "card"), ("4111/1111/1111/1112", None), ("(415) 555-0199", "phone")):
        text = f"given {number} and later {number} there"
        assert pii.base_spans(text) == []
        assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.added_spans(text, [], w)] == [(want, number)] * 2 * bool(want)
        assert pii.added_spans(f"given {number} there", [], w) == []


def test_tokens_and_added_spans():
    at = lambda t, locals_=frozenset(): [t[a:b] for a, b, _ in pii.tokens(t, locals_)]
    assert at("a 415 555 0199, 12 +1 (415) 555-0199. b") == ["415 555 0199", "12", "+1 (415) 555-0199"]
    assert at("1 22 333 4444 55555 666666 7777777") == ["1", "22", "333", "4444", "55555", "666666", "7777777"]
    assert at("(a1) ann.lee, x", frozenset({"ann.lee"})) == ["a1", "ann.lee"]
    assert at("") == at("no data") == []
    assert pii.disjoint([(0, 5, 9), (1, 8, 12), (2, 12, 13), (0, 1, 2)]) == ([1, 5, 12], [2, 12, 13])


def test_whole_table_and_edge_cases(spark):
    for d in (common.table(spark, SF01, "documents"), data.docs(spark)):
        rows = {}
        for r in d.select("doc_id", "text").collect():
            base = plain(r.text or "")
            line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
            rows.setdefault(r.doc_id, []).append((*[sum(s[0] == k for s in base) for k in range(4)], hashlib.sha256(line.encode()).hexdigest()))
        got = pii.find(d).collect()
        assert len(got) == sum(map(len, rows.values()))
        for r in got:
            assert tuple(r)[1:6] in rows[r.doc_id]
            assert len(r.spans.split(",")) - (r.spans == "") == sum(tuple(r)[1:5]) + r.n_added
        assert sum(r.n_added for r in got) <= 0.1 * sum(sum(tuple(r)[1:5]) for r in got) + 1  # the tables plant no shortened mentions
    assert pii.find(data.empty(spark)).count() == 0
