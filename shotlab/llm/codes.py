"""Vector code compression with per-dimension value dictionaries.

Every component becomes the integer floor(256 * x).  Vectors are held in blocks; in a block each
dimension has a dictionary of its distinct integers and every component is the place of its
value in it (two bytes).  To compare a block with a codebook, the squared differences of every
dictionary value to all entries are tabulated once per dimension; the distances of a part are
then gathers from these tables by code, added up over the part's dimensions.

The blocks are written once to the shared folder and read by each round, so no round parses or
rounds a vector again.  Codebooks are ``entries`` x dimensions integers: they are the only data
that reach the driver and, inside the task's function, every executor.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlab.llm.common import written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors of a block: bounds a dictionary, its tables and the width of the codes.
BLOCK = 4096
#: Labels holding at least this share of the vectors get their totals by broadcast: at most 1000 rows.
HOT_SHARE = 1000


@dataclass(frozen=True)
class Codebooks:
    """``values``: int64 array (entries, dimensions); entry ``e`` of part ``p`` is the slice of row
    ``e`` over the part's dimensions."""

    values: object
    parts: int = PARTS

    @property
    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry, place in the part."""
        by_part = self.values.reshape(len(self.values), self.parts, -1).transpose(1, 0, 2)
        return hashlib.sha256(",".join(map(str, by_part.ravel().tolist())).encode()).hexdigest()


def usable(vec: Column) -> Column:
    """The vector and all its components are there and finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & finite


def whole(vectors):
    """floor(256 * x) of an array of doubles as int64; squared distances must fit 63 bits."""
    import numpy as np

    out = np.floor(SCALE * vectors)
    if out.size and np.abs(out).max() > 2 ** 31 / np.sqrt(2 * out.shape[1]):
        raise ValueError("components are too large for exact 64-bit distances")
    return out.astype(np.int64)


def dictionaries(ints):
    """Per dimension the sorted distinct integers, and the codes (uint16) of all components."""
    import numpy as np

    words, codes = [], np.empty(ints.shape, "<u2")
    for d in range(ints.shape[1]):
        distinct, codes[:, d] = np.unique(ints[:, d], return_inverse=True)
        words.append(distinct)
    return words, codes


def part_distances(words, codes, books: Codebooks):
    """(parts, vectors, entries) squared distances: a table per dimension, gathered by code and added."""
    import numpy as np

    entries, dims = books.values.shape
    out = np.zeros((books.parts, len(codes), entries), np.int64)
    for d in range(dims):
        table = (words[d][:, None] - books.values[None, :, d]) ** 2
        out[d * books.parts // dims] += table[codes[:, d]]
    return out


def blocks(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Usable vectors as written blocks: ``ids``, ``labels``, the dictionaries ``words`` and ``codes``."""
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vec_col].cast("array<double>").alias("vec")).where(usable(F.col("vec")))
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                vec = part.column(2)
                size = {*vec.value_lengths().to_pylist()}
                if len(size) > 1 or min(size) % PARTS or not min(size):
                    raise ValueError(f"vectors need one length that {PARTS} divides, found {sorted(size)[:5]}")
                ints = whole(vec.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                words, codes = dictionaries(ints)
                listed = lambda c: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c)
                yield pa.RecordBatch.from_arrays([listed(part.column(0)), listed(part.column(1)), pa.array([[w.tolist() for w in words]], pa.list_(pa.list_(pa.int64()))), pa.array([codes.tobytes()], pa.binary())],
                                                 names=["ids", "labels", "words", "codes"])

    return written(rows.mapInArrow(pack, f"ids array<{id_type}>, labels array<{label_type}>, words array<array<bigint>>, codes binary"), "vector-blocks")


def unpack(batch):
    """(words, codes) of each block of an Arrow batch."""
    import numpy as np

    for words, raw in zip(batch.column("words"), batch.column("codes"), strict=True):
        w = [np.array(x, np.int64) for x in words.as_py()]
        yield w, np.frombuffer(raw.as_py(), "<u2").reshape(-1, len(w))


def first_books(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", entries: int = ENTRIES) -> Codebooks | None:
    """Codebooks of the ``entries`` usable vectors with the smallest ids (null ids last, equal ids by
    their components); none if no vector is usable."""
    import numpy as np

    rows = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].cast("array<double>").alias("vec")).where(usable(F.col("vec")))
    found = rows.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).collect()
    if len({len(r["vec"]) for r in found}) > 1 or found and (not found[0]["vec"] or len(found[0]["vec"]) % PARTS):
        raise ValueError(f"vectors need one length that {PARTS} divides")
    return Codebooks(whole(np.array([r["vec"] for r in found]))) if found else None


def refine(packed: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part joins its nearest entry (ties: lower index), an entry becomes the floor
    of the mean of its parts, an unused one stays.

    Each task adds up its blocks, so entries x dimensions rows a task are shuffled."""
    def sums(batches):
        import numpy as np
        import pyarrow as pa

        entries, dims = books.values.shape
        total, n = np.zeros((dims, entries), np.int64), np.zeros((books.parts, entries), np.int64)
        for b in batches:
            for words, codes in unpack(b):
                near = part_distances(words, codes, books).argmin(axis=2)
                for p in range(books.parts):
                    n[p] += np.bincount(near[p], minlength=entries)
                for d in range(dims):
                    seen = np.bincount(near[d * books.parts // dims] * len(words[d]) + codes[:, d], minlength=entries * len(words[d]))
                    total[d] += seen.reshape(entries, -1) @ words[d]
        dim, entry = np.meshgrid(np.arange(dims), np.arange(entries), indexing="ij")
        yield pa.RecordBatch.from_arrays([pa.array(dim.ravel(), pa.int32()), pa.array(entry.ravel(), pa.int32()), pa.array(total.ravel()), pa.array(np.repeat(n, dims // books.parts, axis=0).ravel())], names=["dim", "entry", "total", "n"])

    found = packed.select("words", "codes").mapInArrow(sums, "dim int, entry int, total long, n long").groupBy("dim", "entry").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    values = books.values.copy()
    for r in found:
        if r["n"]:
            values[r["entry"], r["dim"]] = r["total"] // r["n"]
    return Codebooks(values, books.parts)


def compress(packed: DataFrame, books: Codebooks, id_type: str, label_type: str) -> DataFrame:
    """(vec_id, label, code, error): two hex digits of the nearest entry per part, and the squared
    distances to them summed over the parts."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i, (words, codes) in enumerate(unpack(b)):
                far = part_distances(words, codes, books)
                near = far.argmin(axis=2)
                error = np.take_along_axis(far, near[:, :, None], axis=2)[:, :, 0].sum(axis=0)
                code = [row.tobytes().hex() for row in near.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), b.column("labels").slice(i, 1).flatten(), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return packed.mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error long")


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over equal labels (nulls together).

    Totals of labels with a thousandth of the vectors or more (at most 1000) are broadcast; the
    others join by label, where no label holds more than that."""
    rows = written(codes, "vector-codes")
    per = written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    n = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = per.where(F.col("n") * HOT_SHARE >= n).select(F.col("label").alias("_hot"), F.col("label_error").alias("_hot_error"))
    marked = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_hot")), "left").drop("_hot")
    rest = per.select(F.col("label").alias("_label"), "label_error")
    few = marked.where(F.col("_hot_error").isNull()).drop("_hot_error").join(rest, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return marked.where(F.col("_hot_error").isNotNull()).withColumnRenamed("_hot_error", "label_error").unionByName(few)


def report(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable vector.

    A vector that is null or holds null, NaN or infinite components is left out; null ids and
    repeated rows are coded like any other; an empty table gives an empty result.  Vectors of
    different lengths, or of a length that 16 does not divide, are an error.  Other columns are
    not read."""
    cols = {"id_col": id_col, "vec_col": vec_col}
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    books = first_books(vectors, **cols)
    if books is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {id_type}, label {label_type}, code string, error long, label_error long, codebooks_sha256 string")
    packed = blocks(vectors, **cols, label_col=label_col)
    for _ in range(rounds):
        books = refine(packed, books)
    return with_label_error(compress(packed, books, id_type, label_type)).withColumn("codebooks_sha256", F.lit(books.digest))
