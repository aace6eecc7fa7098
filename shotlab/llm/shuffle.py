"""Sharding by a two-pass external shuffle.

Pass one scatters the records by a seeded hash of their content into buckets of about
``bucket_bytes``: uniform, so a bucket fits in memory whatever the table's keys look like.  Pass
two takes one bucket in each task, brings its records into the order of their hashes (so the
order of arrival does not matter), shuffles them with Fisher-Yates from the bucket's own
seed, and writes them.  Buckets one after the other are a uniform shuffle of the table; shards
are its ``shards`` runs of equal length (at most one record apart).

A first look at the records keeps two hashes and the size of each.  From it come the number of
buckets, the place of each bucket in the whole order, and the records of which there are so many
identical copies that one bucket could not hold them; such copies are numbered and
hashed one by one.  Each task gets the place of its bucket as one more row of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from shotlab.llm.common import new_path, written

SHARDS, BUCKET_BYTES = 16, 64 << 20
#: Copies generated from one row by one explode.
RUN = 1 << 20


@dataclass(frozen=True)
class Plan:
    """What the first look found: rows, buckets, and whether some records are numbered by copy."""

    rows: int
    buckets: int
    shards: int
    seed: int


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and one more."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def hashes(docs: DataFrame, seed: int) -> list[Column]:
    """Two independent 64-bit hashes of a record; columns of maps, which have no order, are left out."""
    cols = [docs[f.name] for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    return [F.xxhash64(F.lit(seed), F.lit(salt), *cols) for salt in (0, 1)]


def copies(rows: DataFrame, n: str) -> DataFrame:
    """Each row once for each number 0 .. n - 1, as ``_copy``; in runs, so no array is long."""
    runs = rows.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / RUN))))
    last = F.least(F.col(n), (F.col("_run") + 1) * RUN) - 1
    return runs.withColumn("_copy", F.explode(F.sequence(F.col("_run") * RUN, last))).drop("_run")


def scattered(rows: DataFrame, many: DataFrame | None, content: list[str]) -> DataFrame:
    """``rows`` (_h, _g, _n and ``content``) with ``_key``: the hash by which they are dealt.

    ``many``: (_h, _g, _copies) of the records whose copies are dealt one by one.  Identical copies
    are made anew from one of them, so they never meet in one task."""
    key = F.xxhash64("_h", "_g")
    if many is None:
        return rows.withColumn("_key", key)
    mark = many.select(F.col("_h").alias("_mh"), F.col("_g").alias("_mg"), "_copies")
    both = rows.join(mark, (F.col("_h") == F.col("_mh")) & (F.col("_g") == F.col("_mg")), "left").drop("_mh", "_mg")
    few = both.where(F.col("_copies").isNull()).withColumn("_key", key)
    one = both.where(F.col("_copies").isNotNull()).groupBy("_h", "_g", "_copies").agg(*[F.first(c).alias(c) for c in content])
    each = copies(one, "_copies").withColumn("_key", F.xxhash64("_h", "_g", "_copy")).withColumn("_n", F.lit(1).cast("long"))
    return few.drop("_copies").unionByName(each.drop("_copies", "_copy"))


def look(docs: DataFrame, text_col: str, seed: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame | None, int, int]:
    """(records as hash, size and count; those with too many copies; rows; buckets)."""
    h, g = hashes(docs, seed)
    light = docs.select(h.alias("_h"), g.alias("_g"), size_of(docs[text_col]).alias("_size"))
    light = written(light.groupBy("_h", "_g", "_size").agg(F.count("*").alias("_n")), "records")
    n, total = light.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.col("_n") * F.col("_size")), F.lit(0))).first()
    buckets = max(1, -(-int(total) // bucket_bytes))
    # at most four such records for each bucket
    many = light.where((F.col("_n") > 1) & (F.col("_n") * F.col("_size") * 4 > bucket_bytes)).select("_h", "_g", F.col("_n").alias("_copies"))
    return light, (written(many, "copied") if many.limit(1).count() else None), int(n), buckets


def bucket(buckets: int) -> Column:
    return F.pmod(F.col("_key"), F.lit(buckets)).cast("int")


def shard_of(place, rows: int, shards: int):
    """(shard, slot) of places in the whole order: runs of equal length, the first ones longer by one."""
    import numpy as np

    base, more = divmod(rows, shards)
    head = more * (base + 1)
    first = place < head
    shard = np.where(first, place // (base + 1), more + (place - head) // max(base, 1))
    return shard.astype(np.int32), place - (shard * base + np.minimum(shard, more))


def shuffled(docs: DataFrame, *, text_col: str = "text", shards: int = SHARDS, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` (all columns, whatever their names) with ``shard`` and
    ``slot`` (gapless from 0), in written order inside each partition.

    The result depends on the rows, the seed and ``bucket_bytes`` only, not on their order or
    partitioning.  Null ids and texts are hashed like any value, a row longer than a bucket has
    its bucket to itself or with few others, identical rows are all kept, an empty table gives an
    empty result, shards beyond the number of rows stay empty."""
    light, many, n, buckets = look(docs, text_col, seed, bucket_bytes)
    plan = Plan(n, buckets, shards, seed)
    counts = scattered(light, many, ["_size"]).groupBy(bucket(buckets).alias("_bucket")).agg(F.sum("_n").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))     # a row per bucket
    starts = written(counts.select("_bucket", F.coalesce(before, F.lit(0)).cast("long").alias("_start")), "starts")
    h, g = hashes(docs, seed)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), h.alias("_h"), g.alias("_g"), F.lit(1).cast("long").alias("_n"))
    dealt = scattered(rows, many, ["doc"]).select(bucket(buckets).alias("_bucket"), F.col("_key"), F.lit(None).cast("long").alias("_start"), "doc")
    doc = F.lit(None).cast(docs.select(F.struct("*").alias("doc")).schema["doc"].dataType)
    marks = starts.select("_bucket", F.lit(None).cast("long").alias("_key"), "_start", doc.alias("doc"))
    schema = dealt.select("doc").withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).schema
    return dealt.unionByName(marks).repartitionById(buckets, "_bucket").select("_bucket", "_key", "_start", "doc").mapInArrow(fisher_yates(plan), schema)


def fisher_yates(plan: Plan):
    """Shuffles the bucket of a task; its own place in the whole order comes as the row with a start."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        at = pa.Table.from_batches(held)
        del held
        marks = at.column("_start").is_valid().to_numpy()
        ids, whole = at.column("_bucket").to_numpy(), at.column("doc").combine_chunks()
        for k in np.unique(ids):        # one bucket, unless the caller's session merged some
            mine = np.flatnonzero((ids == k) & ~marks)
            start = at.column("_start").take(pa.array(np.flatnonzero((ids == k) & marks)))[0].as_py()
            order = mine[np.argsort(at.column("_key").take(pa.array(mine)).to_numpy(), kind="stable")]
            np.random.default_rng([plan.seed, int(k)]).shuffle(order)       # Fisher-Yates
            shard, slot = shard_of(start + np.arange(len(order)), plan.rows, plan.shards)
            for low in range(0, len(order), 1024):
                cut = slice(low, low + 1024)
                yield pa.RecordBatch.from_arrays([whole.take(pa.array(order[cut])), pa.array(shard[cut]), pa.array(slot[cut])], names=["doc", "shard", "slot"])

    return run


def write(docs: DataFrame, folder: str, **options) -> None:
    """Writes the shards as Parquet folders ``shard=0`` .. of (doc, slot) rows in slot order, through
    Spark's own committer: a lost task leaves nothing behind."""
    shuffled(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(folder)


def read(docs: DataFrame, folder: str) -> DataFrame:
    """(doc, slot, shard) of written shards of the table ``docs``."""
    doc = docs.select(F.struct("*").alias("doc")).withColumn("slot", F.lit(0).cast("long")).withColumn("shard", F.lit(0))
    return docs.sparkSession.read.schema(doc.schema).parquet(folder)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes the shards into the shared folder and returns per row of them: doc_id, size, text_crc32,
    law (``rows``), shard, slot, grown_shard (null: that law does not have it)."""
    cols = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    folder = new_path(docs.sparkSession, "shards")
    write(cols, folder, **options)
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    return read(cols, folder).select(F.col("doc.doc_id").alias("doc_id"), size_of(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
                                     "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
