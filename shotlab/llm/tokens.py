"""Token ids of the word-level BPE file, each distinct word encoded once a chunk of texts.

The file's normalizer and pre-tokenizer never look across white space, nor across a change
between ASCII letters, digits and symbols, and words are encoded one by one: a text's ids are
those of its runs between such places, in order.  ``WordEncoder`` finds the runs of a chunk of
texts by their bytes, numbers the distinct ones with Arrow, finds the ids of each once and takes
them in the order of the texts.  A run of ordinary Latin text is a word or is cut into words by
the file's own pattern; a new word's ids come from the tokenizers library and stay in a bounded
memo.  Any other run (other scripts, marks, control characters) goes through the library as it
stands, and a text with a special token's string goes through it whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

END = 0
#: Bytes of text whose distinct runs are numbered at once; characters of the longest run in the memo.
CHUNK, LONG = 4 << 20, 64

#: The pattern of the file's pre-tokenizer over the letters, digits and spaces that ``ODD`` leaves.
_LETTER, _DIGIT = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\t\n\r {_LETTER}{_DIGIT}]+")
#: Characters that need the library's normalizer or pre-tokenizer; 23 capitals whose lower case lies beyond ``WORD``'s letters are among them.
_PLAIN = "".join(c for c in map(chr, [*range(0xA1, 0x130), *range(0x131, 0x250)]) if c.lower() <= "ɏ")
ODD = re.compile(f"[^\t\n\r -~{_PLAIN}]")
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")

#: Classes of bytes. An apostrophe may begin a word of letters, and bytes beyond ASCII may be any class: no run begins or ends beside them.
OTHER, LETTERS, DIGITS, SYMBOLS, SPACE = range(5)
CLASSES = bytes(SPACE if chr(b) in "\t\n\r " else OTHER if not 32 < b < 127 or chr(b) == "'" else LETTERS if chr(b).isalpha() else DIGITS if chr(b).isdigit() else SYMBOLS for b in range(256))
#: Whether a run begins at a byte, by 8 times the class before it and its own.
BEGINS = bytes(b % 8 != SPACE and (b // 8 == SPACE or (b // 8 > 0 < b % 8 and (b // 8 != b % 8 or b % 8 == DIGITS))) for b in range(256))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The library's tokenizer without truncation and padding; one thread in each task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def plain(text: str) -> bool:
    return not ODD.search(text) and not ("<|" in text and SPECIAL.search(text))


def byte_chars() -> list[str]:
    """The character that stands for each byte in the file's vocabulary: itself where it is
    printable, else the next free code point from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def runs(texts):
    """All runs of a column of texts without nulls, and the number of runs before each text and in all."""
    import numpy as np
    import pyarrow as pa

    _, places, data = texts.cast(pa.string()).buffers()
    places = np.frombuffer(places, np.int32, len(texts) + 1, 4 * texts.offset)
    data = data.to_pybytes()[places[0]:places[-1]] if data else b""
    places = places - places[0]
    kinds = np.frombuffer(data.translate(CLASSES), np.uint8)
    before = np.append(np.uint8(SPACE), kinds[:-1])[:len(kinds)]
    before[places[:-1][places[:-1] < len(kinds)]] = SPACE
    begins = np.frombuffer((before << 3 | kinds).tobytes().translate(BEGINS), bool)
    keep = kinds != SPACE
    solid = np.frombuffer(data, np.uint8)[keep]
    offsets = np.append(np.flatnonzero(begins[keep]), len(solid)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(solid))
    return found, np.searchsorted(np.flatnonzero(begins), places)


class Memo(dict):
    """Run -> its ids as bytes of uint32.  Holds at most ``bound`` runs in two generations:
    lower-case words, which the library's BPE model encodes if neither knows them, and runs for
    the whole library, up to ``LONG`` characters.  Other runs are put together from their words."""

    def __init__(self, tok, bound: int):
        self.tok, self.model, self.bound, self.old = tok, tok.model, bound, {}
        self.chars = byte_chars()

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            if ODD.search(run):
                ids = array("I", self.tok.encode(run, add_special_tokens=False).ids).tobytes()
            else:
                words = WORD.findall(run.lower())
                if words != [run]:
                    return b"".join(map(self.__getitem__, words))
                w = run if run.isascii() else "".join(map(self.chars.__getitem__, run.encode()))
                ids = array("I", [t.id for t in self.model.tokenize(w)]).tobytes()
        if len(run) > LONG:
            return ids
        if len(self) >= self.bound // 2:
            self.old = self.copy()
            self.clear()
        self[run] = ids
        return ids


class WordEncoder:
    def __init__(self, path: str, memo: int = 600_000):
        self.tok = tokenizer(path)
        self.known = Memo(self.tok, memo)

    def ids(self, text: str | None):
        """uint32 array of the ids of a whole text; a null text is empty."""
        import pyarrow as pa

        return next(self.each(pa.array([text], pa.string())))

    def each(self, texts):
        """``ids`` of every text of an Arrow column, in order."""
        import numpy as np
        import pyarrow.compute as pc

        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK, "right")))
            yield from self.chunk(pc.fill_null(texts.slice(low, high - low), ""))
            low = high

    def chunk(self, texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = pc.match_substring_regex(texts, SPECIAL.pattern)
        # the library normalizes before it lower-cases: J and a caron have no composed form, j and a caron do
        cased = pc.match_substring_regex(texts, ODD.pattern)
        found, at = runs(pc.if_else(whole, "", pc.if_else(cased, texts, pc.ascii_lower(texts))))
        numbered = found.dictionary_encode()
        ids = list(map(self.known.__getitem__, numbered.dictionary.to_numpy(zero_copy_only=False).tolist()))
        ends = np.cumsum([0, *map(len, ids)]) // 4
        taken = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.uint32))).take(numbered.indices)
        ids, at = taken.values.to_numpy(), taken.offsets.to_numpy()[at]
        for i, special in enumerate(whole.to_pylist()):
            yield np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) if special else ids[at[i]:at[i + 1]]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, kept between its tasks."""
    return WordEncoder(path)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
