"""Personal data: base patterns, and a skip-chain conditional random field over each document.

The base kinds (email, ip, card, phone) are found by pattern.  The field labels every token that
holds a digit or an ``@``, or equals the local part of an email of the text (any other token is
fixed to "none"); neighbouring groups of digits, as in ``415 555 0199``, are one token.
Neighbouring tokens are chain edges, and distant tokens that repeat or resemble one another are
skip edges, which share a potential for equal labels.  Loopy message passing gives each token's
label probabilities, so a mention carries its label to the shortened or reformatted ones
elsewhere in the document.  A token outside all base spans is added where its label has ``least``
probability and skip edges lead to a base span of that kind, or ``alone`` without such backing.

Weights are trained here by pseudo-likelihood on at most ``train_docs`` documents whose tokens
are labelled by the base kinds.  No feature tells the base label (in a judged text, tokens of base
spans are observed: their label is fixed), so shape, context and skip edges learn to stand in for
it.  Each training text is followed by shortened or reformatted
repeats of its mentions, labelled like the mention, and by broken forms of them, repeats of other
tokens and common numbers (dates, prices, versions), labelled "none".
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits that a match fails on fails from each of its digits, so only its start is tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAYBE = re.compile(r"[0-9@]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches of the email pattern, found from each ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of kind, start, end) in code points, by kind as listed, then start."""
    if not MAYBE.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return out


# ---------------------------------------------------------------- tokens, features, edges

CUES = {"phone": 4, "tel": 4, "call": 4, "mobile": 4, "fax": 4, "email": 1, "mail": 1, "e-mail": 1, "contact": 1, "ip": 2, "host": 2, "server": 2, "address": 2, "card": 3, "visa": 3, "credit": 3, "payment": 3,
        "version": 0, "license": 0, "licence": 0, "section": 0, "page": 0, "chapter": 0}
SHAPES = ("bias", "at", "plus", "paren", "dash", "letters", "alldigits", "dots3", "colon", "equals", "quote", "slash", "handle", "octet", "luhn", "unluhn", *[f"d{n}" for n in (1, 4, 7, 10, 13, 20)], *[f"cue{k}" for k in range(5)])
COLUMN = {s: i for i, s in enumerate(SHAPES)}
CHAIN, EQUAL, SIMILAR = 0, 1, 2
#: Log-odds of an observed label.
FIXED = 50.0


@dataclass
class Graph:
    """Candidate tokens of one document: spans, features (tokens x shapes), base label, edges."""

    spans: list
    x: object
    base: object
    edges: object  # rows (from, to, type)


def labels_at(spans, marked):
    """Label of each token: the first marked span (rank of kind, start, end) that overlaps it."""
    import numpy as np

    order, out, j = sorted((a, b, k + 1) for k, a, b in marked), np.zeros(len(spans), np.int64), 0
    for i, (a, b) in enumerate(spans):
        while j < len(order) and order[j][1] <= a:
            j += 1
        out[i] = next((k for s, e, k in order[j:j + 4] if s < b and a < e), 0)
    return out


#: Words that hold a digit or an ``@``, and all words.
SOME = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
ALL = re.compile(r"\S++")
#: A group of digits that may be part of a longer number, and what may close the last group.
GROUP = re.compile(r"[+(]{0,2}[0-9][0-9()-]*+")
CLOSING = re.compile(r"[.,;:!?]*")
DIGIT_STEPS = (1, 4, 7, 10, 13, 20)


def local_parts(text: str, base) -> frozenset:
    """Local parts of the emails that are no plain words (they hold a sign or a digit)."""
    parts = (text[a:b].split("@")[0].lower() for k, a, b in base if k == 0)
    return frozenset(p for p in parts if len(p) >= 3 and not p.isalpha())


def tokens(text: str, locals_: frozenset) -> list[tuple[int, int, bool]]:
    """(start, end, next to the token before) of the candidate tokens."""
    found: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    digits, open_ = 0, False

    def close():
        found.extend([(run[0][0], run[-1][1])] if 1 < len(run) and digits <= 19 else run)
        run.clear()

    for m in (ALL if locals_ else SOME).finditer(text):
        word, (a, b) = m[0], m.span()
        if not MAYBE.search(word) and word.strip("\"'([<{.,;:!?)]}>").lower() not in locals_:
            continue
        g = GROUP.match(word)
        n = len(DIGITS.findall(g[0])) if g and g.end() < 16 else 0
        part = 0 < n <= 7 and CLOSING.fullmatch(word, g.end())
        if not (part and open_ and word[0] != "+" and a == run[-1][1] + 1 and text[a - 1] == " "):
            close()
            digits = 0
        run.append((a, b))
        digits += n
        open_ = bool(part) and g.end() == len(word)
    close()
    out, last = [], None
    for a, b in found:
        near = last is not None and text[last:a].isspace()
        last = b
        word = text[a:b]
        lead = len(word) - len(word.lstrip("\"'([<{"))
        kept = word.lstrip("\"'([<{").rstrip("\"'.,;:!?)]}>")
        out.append((a + lead - (word[lead - 1:lead] == "(" and ")" in kept), a + lead + len(kept), near))
    return out


def shapes(text: str, a: int, b: int) -> list[str]:
    """Names of the features of the token at ``a`` to ``b``."""
    word = text[a:b]
    digits = "".join(DIGITS.findall(word))
    letters = any(c.isalpha() for c in word)
    on = ["bias", f"d{max(v for v in DIGIT_STEPS if v <= max(1, len(digits)))}"]
    on += [s for s, c in (("at", "@"), ("plus", "+"), ("paren", "("), ("dash", "-"), ("colon", ":"), ("equals", "="), ("quote", '"'), ("slash", "/")) if c in word]
    on += ["letters"] * letters + ["alldigits"] * (len(digits) == len(word)) + ["handle"] * word.startswith("@")
    if word.count(".") == 3:
        on += ["dots3"] + ["octet"] * any(not p.isdecimal() or len(p) > 3 or int(p) > 255 for p in word.split("."))
    if 13 <= len(digits) <= 19 and not letters:
        on += ["luhn" if luhn(digits) else "unluhn"]
    before = text[max(0, a - 40):a].split()
    cue = CUES.get(before[-1].lower().strip(".,:;()")) if before else None
    return on + [f"cue{cue}"] * (cue is not None)


def keys_of(word: str) -> list[tuple]:
    """(kind, key, edge type): tokens with an equal key are linked."""
    digits, low = "".join(DIGITS.findall(word)), word.lower()
    out = [("w", low, EQUAL)] if len(word) >= 3 else []
    if len(digits) >= 7:
        out.append(("d", digits[-7:], SIMILAR))
    if len(digits) >= 9 or len(digits) == 4 == len(word):
        out.append(("s", digits[-4:], SIMILAR))
    if len(low.split("@")[0]) >= 3 and "@" in low:
        out.append(("w", low.split("@")[0], SIMILAR))
    return out


def graph(text: str, base: list[tuple[int, int, int]]) -> Graph | None:
    import numpy as np

    found = tokens(text, local_parts(text, base))
    if not found:
        return None
    spans = [(a, b) for a, b, _ in found]
    x = np.zeros((len(spans), len(SHAPES)), np.uint8)
    label = labels_at(spans, base)
    edges = [(i - 1, i, CHAIN) for i, t in enumerate(found) if t[2]]
    last: dict = {}
    for i, (a, b) in enumerate(spans):
        x[i, [COLUMN[s] for s in shapes(text, a, b)]] = 1
        for kind, key, how in keys_of(text[a:b]):
            if last.get((kind, key), i) != i:
                edges.append((last[kind, key], i, how))  # to the nearest earlier one: linear in the tokens
            last[kind, key] = i
    return Graph(spans, x, label, np.array(sorted(set(edges)), np.int64).reshape(-1, 3))


# ---------------------------------------------------------------- the field

@dataclass
class Weights:
    unary: object  # shapes x labels
    chain: object  # labels x labels
    same: object  # by edge type, for equal labels


def potentials(w: Weights):
    import numpy as np

    return np.stack([w.chain, w.same[EQUAL] * np.eye(len(LABELS)), w.same[SIMILAR] * np.eye(len(LABELS))])


def marginals(g: Graph, w: Weights, rounds: int = 30, damp: float = 0.5):
    """Label probabilities of every token by loopy sum-product."""
    import numpy as np

    unary = np.concatenate([g.x[at:at + (1 << 15)] @ w.unary for at in range(0, len(g.x), 1 << 15)])
    seen = np.flatnonzero(g.base)
    unary[seen] = -FIXED
    unary[seen, g.base[seen]] = 0
    e = g.edges
    if not len(e):
        return _softmax(unary)
    src, dst = np.r_[e[:, 0], e[:, 1]], np.r_[e[:, 1], e[:, 0]]
    back = np.r_[np.arange(len(e), 2 * len(e)), np.arange(len(e))]
    table = potentials(w)
    table = np.concatenate([table, table.transpose(0, 2, 1)])
    kind = np.r_[e[:, 2], e[:, 2] + 3]
    message = np.zeros((len(src), len(LABELS)))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, message)
        change = 0.0
        out = np.empty_like(message)
        for at in range(0, len(src), 1 << 15):
            s = slice(at, at + (1 << 15))
            scores = (belief[src[s]] - message[back[s]])[:, :, None] + table[kind[s]]
            top = scores.max(axis=1)
            new = top + np.log(np.exp(scores - top[:, None, :]).sum(axis=1))
            out[s] = new - new.max(axis=1, keepdims=True)
        change = np.abs(out - message).max()
        message = damp * message + (1 - damp) * out
        if change < 1e-4:
            break
    belief = unary.copy()
    np.add.at(belief, dst, message)
    return _softmax(belief)


def _softmax(a):
    import numpy as np

    p = np.exp(a - a.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


#: Common tokens that are no personal data; every training text gets some of them.
DECOYS = ("2023-01-15", "12/31/1999", "1998", "2024", "12:30", "10:15:59", "19.99", "$25", "1,000,000", "2.0", "v1.2.3", "1.2.3.4567", "10-20", "555", "100%", "3rd", "A4", "978-3-16-148410-0", "000123", "@home", "42", "1024x768", "50 60 70", "1 2 3 4 5", "20230115", "#12")


def forms(kind: int, mention: str, i: int) -> tuple[str, str]:
    """A shortened or reformatted repeat of a mention, and a broken form that is none."""
    digits = "".join(DIGITS.findall(mention))
    if kind == 0:
        local, domain = mention.split("@")
        return (local, mention)[i % 3 == 2 or local.isalpha()], "@" + domain.split(".")[0]
    if kind == 1:
        return mention, "999" + mention[mention.index("."):]
    if kind == 2:
        groups = [digits[j:j + 4] for j in range(0, len(digits), 4)]
        return (digits[-4:], ".".join(groups), "/".join(groups))[i % 3], digits[:-1] + str((int(digits[-1]) + 1) % 10)
    return (f"{digits[-7:-4]}-{digits[-4:]}", f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", digits[-10:])[i % 3], digits[-4:-1] + "-" + digits[:4]


def with_repeats(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text followed by repeats, and the spans of all its mentions."""
    base = base_spans(text)
    out, spans = text + "\n", []
    for i, (k, a, b) in enumerate(base[:32]):
        short, broken = forms(k, text[a:b], i + len(text))
        spans.append((k, len(out) + 4, len(out) + 4 + len(short)))
        out += f"and {short} or then {broken} so "
    other = [m[0] for m in SOME.finditer(text[:20_000]) if not any(s < m.end() and m.start() < e for _, s, e in base)]
    out += "".join(f"see {w} then " for w in (*other[:16], *(DECOYS[(len(text) + 7 * j) % len(DECOYS)] for j in range(4))))
    found = base_spans(out)
    return out, found + [s for s in spans if not any(a < s[2] and s[1] < b for _, a, b in found)]


def train(texts: list[str], *, steps: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> Weights:
    """Pseudo-likelihood training on texts labelled by the base kinds (Adam, fixed order)."""
    import numpy as np

    xs, ys, es, n = [np.zeros((0, len(SHAPES)))], [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)], 0
    for t in texts:
        t, marked = with_repeats(t)
        g = graph(t, base_spans(t))
        if g is not None:
            xs.append(g.x.astype(float))
            ys.append(labels_at(g.spans, marked))
            es.append(g.edges + np.array([n, n, 0]))
            n += len(g.x)
    x, y, e = np.concatenate(xs), np.concatenate(ys), np.concatenate(es)
    k = len(LABELS)
    if not n:
        return Weights(np.zeros((len(SHAPES), k)), np.zeros((k, k)), np.zeros(3))
    gold = np.eye(k)[y]
    cut = [len(SHAPES) * k, len(SHAPES) * k + k * k]
    theta, m, v = np.zeros(cut[1] + 3), 0.0, 0.0
    c, skip = e[e[:, 2] == CHAIN], [e[e[:, 2] == t] for t in (EQUAL, SIMILAR)]
    for step in range(1, steps + 1):
        unary, chain, same = theta[:cut[0]].reshape(-1, k), theta[cut[0]:cut[1]].reshape(k, k), theta[cut[1]:]
        score = x @ unary
        np.add.at(score, c[:, 1], chain[y[c[:, 0]]])
        np.add.at(score, c[:, 0], chain.T[y[c[:, 1]]])
        for t, s in zip((EQUAL, SIMILAR), skip, strict=True):
            np.add.at(score, s[:, 1], same[t] * gold[s[:, 0]])
            np.add.at(score, s[:, 0], same[t] * gold[s[:, 1]])
        left = gold - _softmax(score)
        grad = np.zeros_like(theta)
        grad[:cut[0]] = (x.T @ left).ravel()
        both = np.zeros((k, k))
        np.add.at(both, y[c[:, 0]], left[c[:, 1]])
        np.add.at(both.T, y[c[:, 1]], left[c[:, 0]])
        grad[cut[0]:cut[1]] = both.ravel()
        for t, s in zip((EQUAL, SIMILAR), skip, strict=True):
            grad[cut[1] + t] = (left[s[:, 1]] * gold[s[:, 0]]).sum() + (left[s[:, 0]] * gold[s[:, 1]]).sum()
        grad = grad / n - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Weights(theta[:cut[0]].reshape(-1, k), theta[cut[0]:cut[1]].reshape(k, k), theta[cut[1]:])


def disjoint(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of ``spans``."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def added_spans(text: str, base: list[tuple[int, int, int]], w: Weights, least: float = 0.5, alone: float = 0.99) -> list[tuple[int, int, int]]:
    """Spans the field adds to the base ones, never over one of them."""
    from bisect import bisect_right

    from shotlab.llm.components import forest

    g = graph(text, base) if MAYBE.search(text) else None
    if g is None:
        return []
    p = marginals(g, w)
    best, sure = p.argmax(axis=1), p.max(axis=1)
    skip = g.edges[g.edges[:, 2] != CHAIN]
    group = forest(len(best), (skip[:, 0], skip[:, 1]))
    backed = {(int(group[i]), int(k)) for i, k in enumerate(g.base) if k}
    starts, ends = disjoint(base)
    out: list[tuple[int, int, int]] = []
    for i in ((best > 0) & (sure >= least) & (g.base == 0)).nonzero()[0]:
        a, b = g.spans[i]
        at = bisect_right(ends, a)
        free = a < b and (at == len(starts) or starts[at] >= b)
        if free and sure[i] >= (least if (int(group[i]), int(best[i])) in backed else alone):
            out.append((int(best[i]) - 1, a, b))
    return out


def digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def training_texts(docs: DataFrame, text_col: str, train_docs: int) -> list[str]:
    """At most ``train_docs`` texts with a digit or ``@``, by the hash of the text."""
    total = docs.count()
    text = F.col(text_col)
    part = F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(min(1.0, 4 * train_docs / max(1, total)) * (1 << 30))
    rows = docs.where(text.rlike("[0-9@]") & part).select(text.alias("text")).orderBy(F.xxhash64("text")).limit(train_docs).collect()
    return sorted(r["text"] for r in rows)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_docs: int = 2000, least: float = 0.5, alone: float = 0.99) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row.

    Counts and hash are of the base spans, ``spans`` of all.  Null and empty texts have none;
    repeated rows are judged alike, null ids stay null, an empty table gives an empty result.
    Other columns are not read.  The driver receives the training texts only."""
    w = train(training_texts(docs, text_col, train_docs))
    sent = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, sent.value, least, alone)
                rows.append((*[sum(1 for s in base if s[0] == k) for k in range(4)], hashlib.sha256(digest(base).encode()).hexdigest(), digest(sorted(base + more)), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], kinds[i]) for i in range(7)]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")
