"""Best-fit packing of documents into fixed-length sequences, by best-two-fit.

1. Every document is encoded, gets the end id, and only longer ones are cut into pieces of
   ``size`` tokens.  A piece's rank among the pieces of its length comes from a running count
   inside its partition and the counts of the partitions before it.
2. The number of pieces of each length (at most ``size`` numbers, however long the corpus) is
   all the packing needs: equal lengths are interchangeable.  A bin is filled greedily with the
   longest pieces that fit; then its smallest piece is replaced by the two unpacked pieces
   whose sum fits the expanded gap most tightly, if they fit it better.  The same bin is used
   as often as the counts allow, so the plan has a few thousand patterns for any corpus.
3. The plan gives, for a length and a rank, the sequence and the offset: every piece finds its
   place by a binary search in the plan, which is bounded by ``size`` and sent to each task.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotlab.llm.common import written
from shotlab.llm.tokens import END, encoder, word_bpe

PIECES = "doc_id {id}, piece int, start long, length int, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): the cut documents; ``nth`` counts
    the pieces of equal length inside partition ``part``."""
    path = tokenizer or word_bpe()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen, enc = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), encoder(path)
        for b in batches:
            rows, owner = [], []
            for i, ids in enumerate(enc.each(b.column(1))):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), size)):
                    cut = ids[at:at + size]
                    rows.append((k, at, len(cut), zlib.crc32(cut.tobytes()), int(seen[len(cut)])))
                    seen[len(cut)] += 1
                    owner.append(i)
            if not rows:
                continue
            k, at, n, crc, nth = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int32()),
                                              pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(nth, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, PIECES.format(id=kind))


def two_fit(left, gap: int):
    """The two lengths (may be equal) of ``left`` counts whose sum is the largest up to ``gap``."""
    import numpy as np

    have = np.flatnonzero(left[:gap]) if gap > 1 else np.zeros(0, np.int64)
    have = have[have > 0]
    if not len(have):
        return None
    at = np.searchsorted(have, gap - have, "right") - 1
    other = np.where(at >= 0, have[np.maximum(at, 0)], 0)
    alone = (other == have) & (left[have] < 2)  # the same piece twice: take the next shorter one
    lower = np.searchsorted(have, have, "left") - 1
    other = np.where(alone, np.where(lower >= 0, have[np.maximum(lower, 0)], 0), other)
    total = np.where(other > 0, have + other, 0)
    best = int(np.argmax(total))
    return (int(have[best]), int(other[best])) if total[best] else None


def plan(counts, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (repeats, [(length, pieces of that length in the bin), ...]) from the number of
    pieces of each length 0..size.  Uses every piece exactly once."""
    import numpy as np

    left, bins = np.array(counts, np.int64), []
    while left.any():
        used: list[int] = []
        space, now = size, left.copy()
        while space:
            fits = np.flatnonzero(now[1:space + 1])
            if not len(fits):
                break
            n = int(fits[-1]) + 1
            used.append(n)
            now[n] -= 1
            space -= n
        if space and len(used) > 1:  # the last piece taken is the smallest
            pair = two_fit(now, space + used[-1])
            if pair and sum(pair) > used[-1]:
                now[used[-1]] += 1
                now[pair[0]] -= 1
                now[pair[1]] -= 1
                used = used[:-1] + [*pair]
        lengths, times = np.unique(used, return_counts=True)
        repeats = max(1, int((left[lengths] // times).min()))
        left[lengths] -= repeats * times
        bins.append((repeats, [*zip(lengths[::-1].tolist(), times[::-1].tolist(), strict=True)]))
    return bins


def places(bins, size: int):
    """Per length, sorted arrays: first rank of a run, its pieces a bin, first sequence, offset."""
    import numpy as np

    runs, first, ranks = [[] for _ in range(size + 1)], 0, [0] * (size + 1)
    for repeats, content in bins:
        at = 0
        for n, times in content:
            runs[n].append((ranks[n], times, first, at))
            ranks[n] += repeats * times
            at += n * times
        first += repeats
    return [np.array(r, np.int64).reshape(-1, 4) for r in runs]


def pack(docs: DataFrame, *, size: int = 2048, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    Every document has at least its end id, so null and empty texts are pieces of length 1.
    Repeated rows are packed each; null ids stay null; an empty table gives an empty result.
    Ties between equal lengths go by partition and order of the written pieces.  Other columns
    are not read."""
    cut = written(pieces(docs, size=size, **options), "pieces")
    spark = cut.sparkSession
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = written(per_part.withColumn("before", F.coalesce(before, F.lit(0))), "firsts")
    counts = [0] * (size + 1)
    for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r["n"]
    where = spark.sparkContext.broadcast(places(plan(counts, size), size))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n):
                runs, mine = where.value[length], n == length
                k = np.searchsorted(runs[:, 0], rank[mine], "right") - 1
                rest = rank[mine] - runs[k, 0]
                seq[mine] = runs[k, 2] + rest // runs[k, 1]
                off[mine] = runs[k, 3] + rest % runs[k, 1] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n.astype(np.int64)), b.column(4), pa.array(seq), pa.array(off)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    at = firsts.select(F.col("part").alias("_part"), F.col("length").alias("_length"), "before")
    ranked = cut.join(at, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
