"""Token-id files of patched frame-of-reference blocks.

Layout of a file: magic, blocks, document table, block index, trailer.

* A block holds ``BLOCK`` ids (the last may be shorter): base (its minimum, u32), number of
  ids (u16), width (u8), number of exceptions (u16), residuals packed at ``width`` bits, then
  the exceptions as positions (u16) and whole residuals (u32).  The width is that of the
  residuals' ``PERCENTILE``; larger residuals are exceptions.
* The document table has (doc_id i64, null flag u8, first id u64, number of ids u64) each.
* The index has the byte offset of every block (u64), so ``read_range`` opens only the blocks
  of a range of ids.

Documents are dealt to files by ranges of doc_id, sorted, encoded and streamed into the file by
one task; a file is written under an attempt's name and moved into place.
"""

from __future__ import annotations

import itertools
import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotlab.llm.common import commit_file, new_path, open_fs, tasks_for, written
from shotlab.llm.tokens import encoder, word_bpe

MAGIC = b"PFORIDS1"
BLOCK, GROUP, PERCENTILE = 1024, 64, 90
#: Bytes of text that a file is meant to hold.
FILE_BYTES = 16 << 20
HEAD = struct.Struct("<IHBH")
TAIL = struct.Struct("<QQQQ8s")
DOC = [("doc_id", "<i8"), ("null", "u1"), ("first", "<u8"), ("n", "<u8")]


def pack_bits(values, width: int):
    """(rows, n) values below 2**width to (rows, bytes) of little-endian bits."""
    import numpy as np

    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").view(np.uint8).reshape(len(values), -1)
    size = 2 if width < 16 else 4
    raw = np.unpackbits(values.astype(f"<u{size}").view(np.uint8).reshape(*values.shape, size), axis=2, count=width, bitorder="little")
    return np.packbits(raw.reshape(len(values), -1), axis=1, bitorder="little")


def unpack_bits(data, n: int, width: int):
    """Inverse of ``pack_bits``."""
    import numpy as np

    if width in (8, 16, 32):
        return np.ascontiguousarray(data).view(f"<u{width // 8}").reshape(len(data), n).astype(np.uint32)
    bits = np.unpackbits(data, axis=1, count=n * width, bitorder="little").reshape(len(data), n, width)
    size = 2 if width < 16 else 4
    full = np.zeros((len(data), n, 8 * size), np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full, axis=2, bitorder="little").view(f"<u{size}").reshape(len(data), n).astype(np.uint32)


def encode_blocks(ids) -> list[bytes]:
    """Blocks of a run of ids; all but the last have ``BLOCK`` of them."""
    import numpy as np

    whole = len(ids) // BLOCK * BLOCK
    out: list[bytes] = []
    for part in (ids[:whole].reshape(-1, BLOCK), ids[whole:].reshape(1, -1)):
        if not part.size:
            continue
        base = part.min(axis=1)
        rest = (part - base[:, None]).astype(np.uint32)
        cut = np.percentile(rest, PERCENTILE, axis=1, method="lower").astype(np.int64)
        width = np.array([int(c).bit_length() for c in cut])
        odd = (rest.astype(np.int64) >> width[:, None]) > 0
        packed: list = [b""] * len(part)
        for w in np.unique(width[width > 0]):
            at = np.flatnonzero(width == w)
            for i, row in zip(at, pack_bits(np.where(odd[at], 0, rest[at]), int(w)), strict=True):
                packed[i] = row.tobytes()
        for i in range(len(part)):
            where = np.flatnonzero(odd[i])
            out.append(HEAD.pack(int(base[i]), part.shape[1], int(width[i]), len(where)) + packed[i] + where.astype("<u2").tobytes() + rest[i, where].astype("<u4").tobytes())
    return out


def decode_blocks(data: bytes, n_blocks: int):
    """uint32 ids of ``n_blocks`` consecutive blocks at the start of ``data``."""
    import numpy as np

    raw, at, heads = np.frombuffer(data, np.uint8), 0, []
    for _ in range(n_blocks):
        base, n, width, odd = HEAD.unpack_from(data, at)
        body = at + HEAD.size
        end = body + (n * width + 7) // 8
        heads.append((base, n, width, odd, body, end))
        at = end + 6 * odd
    first = np.cumsum([0, *(h[1] for h in heads)])
    ids = np.zeros(first[-1], np.uint32)
    by: dict = {}
    for i, h in enumerate(heads):
        by.setdefault((h[1], h[2]), []).append(i)
    for (n, width), rows in by.items():
        base = np.array([heads[i][0] for i in rows], np.uint32)[:, None]
        rest = unpack_bits(np.stack([raw[heads[i][4]:heads[i][5]] for i in rows]), n, width) if width else np.zeros((len(rows), n), np.uint32)
        ids[(first[rows][:, None] + np.arange(n)).ravel()] = (rest + base).ravel()
    for i, (base, n, width, odd, body, end) in enumerate(heads):
        if odd:
            where = np.frombuffer(data, "<u2", odd, end)
            ids[first[i] + where.astype(np.int64)] = np.frombuffer(data, "<u4", odd, end + 2 * odd) + np.uint32(base)
    return ids


class Writer:
    """Streams documents into one file."""

    def __init__(self, out):
        self.out, self.at, self.n, self.held, self.parts = out, len(MAGIC), 0, 0, []
        self.starts, self.docs = [], []
        out.write(MAGIC)

    def add(self, doc_id, ids) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, self.n, len(ids)))
        self.n += len(ids)
        self.held += len(ids)
        self.parts.append(ids)
        if self.held >= BLOCK * GROUP:
            self.flush()

    def flush(self, last: bool = False) -> None:
        import numpy as np

        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        upto = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in encode_blocks(ids[:upto].astype(np.uint32)):
            self.starts.append(self.at)
            self.at += len(block)
            self.out.write(block)
        self.parts, self.held = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        import numpy as np

        self.flush(last=True)
        docs = np.array(self.docs, DOC).tobytes()
        self.out.write(docs + np.array(self.starts, "<u8").tobytes() + TAIL.pack(self.at, len(self.docs), len(self.starts), self.n, MAGIC))


class Reader:
    """Random and streaming access to one file."""

    def __init__(self, path: str):
        import numpy as np

        fs, at = open_fs(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        table, n_docs, n_blocks, self.n, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a whole file of token ids")
        width = np.dtype(DOC).itemsize
        rest = self.file.read_at(n_docs * width + 8 * n_blocks, table)
        self.docs = np.frombuffer(rest, DOC, n_docs)
        self.starts = np.append(np.frombuffer(rest, "<u8", n_blocks, n_docs * width), np.uint64(table)).astype(np.int64)

    def blocks(self, low: int, high: int):
        data = self.file.read_at(int(self.starts[high] - self.starts[low]), int(self.starts[low]))
        return decode_blocks(data, high - low)

    def read_range(self, first: int, n: int):
        """Ids ``first`` to ``first + n`` of the file, through the block index."""
        if n <= 0:
            return self.blocks(0, 0)
        low, high = first // BLOCK, (first + n - 1) // BLOCK + 1
        return self.blocks(low, high)[first - low * BLOCK:first - low * BLOCK + n]

    def checksums(self):
        """crc32 of each document's ids, reading the blocks once in order."""
        import numpy as np

        first, n = self.docs["first"].astype(np.int64), self.docs["n"].astype(np.int64)
        out, doc, at = np.zeros(len(n), np.int64), 0, 0
        for low in range(0, len(self.starts) - 1, GROUP):
            ids = self.blocks(low, min(low + GROUP, len(self.starts) - 1)).astype("<u4")
            end = at + len(ids)
            while doc < len(n):
                a, b = max(first[doc], at), min(first[doc] + n[doc], end)
                if b > a:
                    out[doc] = zlib.crc32(ids[a - at:b - at].tobytes(), int(out[doc]))
                if first[doc] + n[doc] > end:
                    break
                doc += 1
            at = end
        return out


def write(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, file_bytes: int = FILE_BYTES, tokenizer: str | None = None) -> DataFrame:
    """Writes all documents' ids in ascending doc_id order; returns the manifest (file, path,
    n_docs, n_tokens, start), ``start`` being the ids in all files before.

    Texts are dealt to files by ranges of (doc_id, hash of the text), about ``file_bytes`` of text
    each, and are encoded and written by the task that receives them: the ids themselves never
    leave it. Null texts are empty (only the end id); null ids come first; repeated ids are
    ordered by that hash and may lie in several files; an empty table writes no file.  Other
    columns are not read."""
    path = tokenizer or word_bpe()
    total = docs.agg(F.sum(F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long") + 1)).first()[0] or 0

    def save(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(path)
        end = np.array([end_id], np.uint32)
        rows = ((f, i, ids) for b in batches for f, i, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), enc.each(b.column(2)), strict=True))
        row = next(rows, None)
        if row is None:
            return
        now, done = row[0], {}

        def fill(out):
            w = Writer(out)
            for _, i, ids in itertools.chain([row], rows):
                w.add(i, np.append(ids, end))
            w.close()
            done.update(n_docs=len(w.docs), n_tokens=w.n)

        name = f"{folder}/part-{now:08d}.pfor"
        commit_file(name, fill)
        yield pa.RecordBatch.from_pylist([{"file": now, "path": name, **done}], schema=pa.schema([("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange(max(1, -(-int(total) // file_bytes)), "id", "_h").sortWithinPartitions("id", "_h")
    files = written(rows.select(F.spark_partition_id().alias("file"), "id", "text").mapInArrow(save, "file int, path string, n_docs long, n_tokens long"), "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    return files.withColumn("start", F.coalesce(before, F.lit(0).cast("long")))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = Reader(path)
                yield pa.RecordBatch.from_arrays([pa.array(r.docs["doc_id"], mask=r.docs["null"].astype(bool)), pa.array(r.docs["first"].astype(np.int64) + start),
                                                  pa.array(r.docs["n"].astype(np.int64)), pa.array(r.checksums())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "start")
    return files.repartition(tasks_for(manifest.sparkSession)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    return read(write(docs, new_path(docs.sparkSession, "token-ids"), **options))
