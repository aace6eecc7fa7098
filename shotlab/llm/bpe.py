"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

1. The words of all documents are counted in Spark; the most frequent ones (at most
   ``lexicon_words``, a documented bound) are merged once and compiled on the driver into a
   minimal acyclic automaton that shares suffixes.  Every arc carries the number of words that sort
   before it below its state, so the sum along a path is the word's number, which points at its
   ids: a transducer from words to ids.
2. The automaton's arrays lie in the shared folder; tasks map them into memory.
3. A task looks up the distinct words of some documents at once, all words a byte further in
   each step, by binary search in the sorted arcs.
4. Words outside the lexicon are merged exactly by the vocabulary's ranks.

Results do not depend on the lexicon: it only saves merging.
"""

from __future__ import annotations

import functools
import heapq
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlab.llm.common import commit_file, new_path, open_fs, written
from shotlab.llm.tokens import SPECIAL, WORD, byte_chars, plain, tokenizer, word_bpe

SUFFIX = "</w>"


#: Bytes from which a word is merged with a heap.
LONG = 64


class Vocabulary:
    """Pre-tokenizing, exact merging and decoding for a vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids = spec["model"]["vocab"]
        merges = spec["model"]["merges"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        every = {i: s for s, i in (self.ids | self.special).items()}
        self.strings = [every.get(i, "") for i in range(max(every) + 1)]
        self.chars = byte_chars()
        self.bytes = {c: b for b, c in enumerate(self.chars)}
        self.library = tokenizer(path)

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if plain(text):
            return WORD.findall(text.lower())
        clean = self.library.normalizer.normalize_str(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(clean)
        return [bytes(self.bytes[c] for c in w).decode() for w, _ in found]

    def segments(self, text: str | None) -> list:
        """Words and special tokens' ids (int) in order."""
        text = text or ""
        if "<|" not in text:
            return self.words(text)
        out: list = []
        at = 0
        for m in SPECIAL.finditer(text):
            out += [*self.words(text[at:m.start()]), self.special[m.group()]]
            at = m.end()
        return out + self.words(text[at:])

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word: the lowest-ranked pair is merged, leftmost first, until none is left."""
        parts = [self.chars[b] for b in word.encode()]
        parts[-1] += SUFFIX
        ranks = self.ranks
        if len(parts) > LONG:
            return tuple([self.ids[p] for p in self.merge_long(parts)])
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return tuple([self.ids[p] for p in parts])

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same merges in n log n: a heap of (rank, place) over a linked list of the parts. An
        entry whose parts have changed since is passed over."""
        ranks, n = self.ranks, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not parts[i] or ranks.get((parts[i], parts[j])) != r:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p]

    def decode(self, ids) -> str:
        """Token strings joined by a space: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(entries: dict[str, tuple[int, ...]]) -> dict:
    """Arrays of the minimal acyclic transducer over the entries' UTF-8 bytes.

    Words are added in byte order; the states of the last word's tail are replaced by equal
    registered ones as soon as the next word leaves them."""
    import numpy as np

    words = sorted((w.encode(), ids) for w, ids in entries.items() if w)
    arcs: list[dict[int, int]] = [{}]
    final, register, path, last = [False], {}, [0], b""

    def settle(depth):
        while len(path) - 1 > depth:
            state = path.pop()
            label = last[len(path) - 1]
            key = (final[state], tuple(arcs[state].items()))
            arcs[path[-1]][label] = register.setdefault(key, state)

    for word, _ in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(same)
        for b in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    settle(0)

    order, number, stack = [0], {0: 0}, [0]
    while stack:  # number the reachable states
        for t in arcs[stack.pop()].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)
                stack.append(t)
    below: dict[int, int] = {}
    todo = [0]
    while todo:  # words below each state, children first
        s = todo[-1]
        wait = [t for t in arcs[s].values() if t not in below]
        if wait:
            todo += wait
        else:
            below[todo.pop()] = final[s] + sum(below[t] for t in arcs[s].values())
    keys, target, skip = [], [], []
    for s in order:
        before = int(final[s])
        for b, t in sorted(arcs[s].items()):
            keys.append(number[s] * 256 + b)
            target.append(number[t])
            skip.append(before)
            before += below[t]
    by = np.argsort(np.array(keys, np.int64), kind="stable")
    return {"keys": np.array(keys, np.int64)[by], "target": np.array(target, np.int32)[by], "skip": np.array(skip, np.int32)[by],
            "final": np.array([final[s] for s in order], bool), "ids": np.array([i for _, ids in words for i in ids], np.uint32),
            "first": np.cumsum([0, *(len(ids) for _, ids in words)], dtype=np.int64)}


class Lexicon:
    """The compiled transducer; ``folder`` holds its arrays as .npy files."""

    NAMES = ("keys", "target", "skip", "final", "ids", "first")

    def __init__(self, arrays: dict):
        self.__dict__.update(arrays)

    @classmethod
    def mapped(cls, folder: str) -> Lexicon:
        """Memory-mapped where the folder is mounted; read from any other store."""
        import io

        import numpy as np
        from pyarrow import fs as arrow_fs

        out = {}
        for name in cls.NAMES:
            fs, at = open_fs(f"{folder}/{name}.npy")
            if isinstance(fs, arrow_fs.LocalFileSystem):
                out[name] = np.load(at, mmap_mode="r")
            else:
                with fs.open_input_file(at) as f:
                    out[name] = np.load(io.BytesIO(f.read()))
        return cls(out)

    def numbers(self, words: list[bytes]):
        """The number of each word, -1 outside the lexicon; all words a byte further each step."""
        import numpy as np

        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(size) - size
        state, number, live = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.flatnonzero(size > 0)
        number[size == 0] = -1
        step = 0
        while len(live) and len(self.keys):
            want = state[live] * 256 + text[at[live] + step]
            k = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            known = self.keys[k] == want
            number[live[~known]] = -1
            live, k = live[known], k[known]
            state[live], number[live] = self.target[k], number[live] + self.skip[k]
            step += 1
            ended = size[live] == step
            done = live[ended]
            number[done[~self.final[state[done]]]] = -1
            live = live[~ended]
        if not len(self.keys):
            number[:] = -1
        return number

    def lookup(self, words: list[str]) -> list:
        """Ids of each word, None outside the lexicon."""
        out: list = [None] * len(words)
        for i, n in enumerate(self.numbers([w.encode() for w in words]).tolist()):
            if n >= 0:
                out[i] = tuple(self.ids[self.first[n]:self.first[n + 1]].tolist())
        return out


@functools.lru_cache(maxsize=2)
def lexicon(folder: str) -> Lexicon:
    return Lexicon.mapped(folder)


def word_counts(docs: DataFrame, text_col: str, path: str, *, held: int = 200_000) -> DataFrame:
    """(word, n) over all documents; a task adds up to ``held`` words before it passes them on."""
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        voc, seen = vocabulary(path), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0):
                seen.update(w for w in voc.segments(t.as_py()) if isinstance(w, str))
                if len(seen) > held:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest count classes that hold ``most`` words or fewer in all.

    A class is a 32nd of a doubling of the count, so the driver reads at most 2000 numbers and
    then no more than ``most`` words, however many partitions and words there are."""
    rank = F.floor(F.log2("n") * 32).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(rank.alias("rank")).count().collect(), key=lambda r: -r["rank"]):
        total += r["count"]
        if total > most:
            break
        least = r["rank"]
    return counts.where(rank >= least if least is not None else F.lit(False)).select("word")


def build_lexicon(docs: DataFrame, *, text_col: str = "text", tokenizer_path: str | None = None, lexicon_words: int = 1 << 16) -> str:
    """Compiles the lexicon of the most frequent words, at most ``lexicon_words`` of them, and
    returns its folder."""
    path = tokenizer_path or word_bpe()
    voc = vocabulary(path)
    top = frequent(written(word_counts(docs, text_col, path), "words"), lexicon_words).collect()
    return save_lexicon(docs.sparkSession, {r["word"]: voc.merge(r["word"]) for r in top})


def save_lexicon(spark: SparkSession, entries: dict) -> str:
    import numpy as np

    folder = new_path(spark, f"lexicon-{uuid.uuid4().hex[:8]}")
    for name, a in compile_lexicon(entries).items():
        commit_file(f"{folder}/{name}.npy", lambda out, a=a: np.save(out, a))
    return folder


class Coder:
    """Encodes documents through the lexicon; words outside it are merged and remembered in a
    bounded memo."""

    def __init__(self, path: str, folder: str, memo: int = 300_000, texts: int = 1024):
        self.voc, self.lex, self.memo, self.bound, self.texts = vocabulary(path), lexicon(folder), {}, memo, texts

    def encode(self, texts):
        """Yields the list of ids of each text, ``texts`` of them looked up at once."""
        from itertools import chain

        for at in range(0, len(texts), self.texts):
            cut = [self.voc.segments(t) for t in texts[at:at + self.texts]]
            known = {i: (i,) for i in self.voc.special.values()}
            fresh = [w for w in set(chain.from_iterable(cut)) if isinstance(w, str)]
            memo, merge = self.memo, self.voc.merge
            for w, ids in zip(fresh, self.lex.lookup(fresh), strict=True):
                if ids is None:
                    ids = memo.get(w)
                    if ids is None:
                        ids = merge(w)
                        if len(memo) >= self.bound:
                            memo.clear()
                        memo[w] = ids
                known[w] = ids
            for words in cut:
                yield [*chain.from_iterable(map(known.__getitem__, words))]


@functools.lru_cache(maxsize=2)
def coder(path: str, folder: str) -> Coder:
    return Coder(path, folder)


def encode(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row.

    Null texts are empty: no ids, empty string.  Repeated rows are coded alike, null ids stay
    null, an empty table gives an empty result; other columns are not read."""
    path = tokenizer_path or word_bpe()

    def run(batches):
        import pyarrow as pa

        c = coder(path, folder)
        for b in batches:
            for at in range(0, b.num_rows, c.texts):
                texts = b.column(1).slice(at, c.texts).to_pylist()
                ids = [*c.encode(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, c.texts), pa.array(ids, pa.list_(pa.int32())), pa.array([c.voc.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row: the digests of what ``encode``
    returns, taken where the ids are made instead of sending ids and texts on."""
    path = tokenizer_path or word_bpe()
    folder = build_lexicon(docs, text_col=text_col, tokenizer_path=path, **options)

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        c = coder(path, folder)
        decimal = [*map(str, range(len(c.voc.strings)))]
        for b in batches:
            for at in range(0, b.num_rows, c.texts):
                rows = []
                for ids in c.encode(b.column(1).slice(at, c.texts).to_pylist()):
                    rows.append((len(ids), sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), sha256(c.voc.decode(ids).encode()).hexdigest()))
                n, ids_sha, text_sha = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, c.texts), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
