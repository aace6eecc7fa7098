"""SimHash near-dedup with BK-trees.

A text's fingerprint has a bit for every bit that is set in over half of the XXH64 values of
its word shingles.  Distinct fingerprints are the nodes; each is dealt to ``radius`` + 1
shards, one per block of its 64 bits and that block's value: two fingerprints within the
radius agree on at least one whole block, so every link is inside a shard.  A shard's tree is
a BK-tree: the children of a node are keyed by their Hamming distance to it, and a search
follows only the edges within the radius of its own distance to the node.  Trees are built
and searched level by level for all shards of a bucket at once.

A tree reaches just the searches of its own shard (rows of the same bucket), instead of
being broadcast to all: the trees of all shards grow with the corpus, so a broadcast has no
bound.  A shard over ``tree_size`` members is cut into blocks, and each pair of blocks is a tree
and its searches in a bucket of their own.  A task returns a spanning forest of the links it
found, never the pairs of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotlab.llm.common import written
from shotlab.llm.components import components, forest

BITS = 64
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint; 0 for null texts and texts without a word."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), len(words) - k + 1
    for at in range(0, n, CHUNK):
        upto = min(n, at + CHUNK)
        spans = zip(starts[at:upto].tolist(), ends[at + k - 1:upto + k - 1].tolist(), strict=True)
        h = np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, upto - at)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, fp long")


class BkForest:
    """BK-trees over distinct (tree key, fingerprint) pairs, one tree per key."""

    def __init__(self, keys, fps):
        import numpy as np

        self.order = np.lexsort((fps, keys))
        self.keys, self.fps = keys[self.order], fps[self.order]
        n = len(keys)
        self.first = np.flatnonzero(np.r_[True, self.keys[1:] != self.keys[:-1]]) if n else np.zeros(0, np.int64)
        self.root_keys = self.keys[self.first]
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        here = np.repeat(self.first, np.diff(np.r_[self.first, n]))
        rest = np.flatnonzero(here != np.arange(n))
        here = here[rest]
        while len(rest):
            d = np.bitwise_count(self.fps[rest] ^ self.fps[here]).astype(np.int64)
            _, at, back = np.unique(here * (BITS + 1) + d, return_index=True, return_inverse=True)
            child = rest[at]
            parent[child], edge[child] = here[at], d[at]
            here = child[back]
            more = here != rest
            rest, here = rest[more], here[more]
        held = np.flatnonzero(parent >= 0)
        slots = parent[held] * (BITS + 1) + edge[held]
        by = np.argsort(slots, kind="stable")
        self.slots, self.children = slots[by], held[by]

    def search(self, keys, fps, radius: int):
        """Yields (position in ``fps``, position in the forest's input) of all pairs within the
        radius in the tree of the same key, level by level."""
        import numpy as np

        at = np.searchsorted(self.root_keys, keys)
        ok = (at < len(self.root_keys)) & (self.root_keys[np.minimum(at, len(self.root_keys) - 1)] == keys) if len(self.root_keys) else np.zeros(len(keys), bool)
        q = np.flatnonzero(ok)
        node = self.first[at[q]] if len(q) else q
        while len(q):
            d = np.bitwise_count(fps[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], self.order[node[near]]
            low = np.searchsorted(self.slots, node * (BITS + 1) + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(self.slots, node * (BITS + 1) + np.minimum(d + radius, BITS), "right") - low
            q = np.repeat(q, n)
            node = self.children[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(q))]


def _link_bucket(radius: int, searches: int = 512):
    def run(pdf):
        import numpy as np
        import pandas as pd

        fp = pdf["fp"].to_numpy().view(np.uint64)
        names, ids = np.unique(fp, return_inverse=True)
        tree, query = pdf["tree"].to_numpy(), pdf["query"].to_numpy()
        keys, t = pdf["key"].to_numpy(), np.flatnonzero(tree)
        bk, asks = BkForest(keys[t], fp[t]), np.flatnonzero(query)
        asks = asks[np.argsort(keys[asks], kind="stable")]
        labels = np.arange(len(names))
        for at in range(0, len(asks), searches):
            some = asks[at:at + searches]
            for q, x in bk.search(keys[some], fp[some], radius):
                labels = forest(len(names), (ids[some[q]], ids[t[x]]), labels)
        moved = np.flatnonzero(labels != np.arange(len(names)))
        signed = names.view(np.int64)
        return pd.DataFrame({"a": signed[moved], "b": signed[labels[moved]]})

    return run


def links(fps: DataFrame, radius: int, *, tree_size: int = 16384, bucket_rows: int = 60_000) -> DataFrame:
    """Spanning links (a, b) between distinct values ``fp`` at most ``radius`` bits apart."""
    blocks = radius + 1
    width, wide = divmod(BITS, blocks)
    cuts, at = [], 0
    for j in range(blocks):
        n = width + (j < wide)
        cuts.append(F.struct(F.lit(j).alias("j"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1)).alias("v")))
        at += n
    total = fps.count() * blocks
    rows = fps.select("fp", F.explode(F.array(*cuts)).alias("s")).select("fp", (F.col("s.v") * blocks + F.col("s.j")).alias("shard"))
    large = rows.groupBy("shard").count().where(F.col("count") > tree_size).select(F.col("shard").alias("_shard"), F.ceil(F.col("count") / tree_size).cast("int").alias("parts"))
    rows = rows.join(written(large, "large"), F.col("shard") == F.col("_shard"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    key = F.when(F.col("parts") == 1, F.col("shard")).otherwise(F.xxhash64("shard", low, high))
    n_buckets = max(1, -(-total // bucket_rows))
    rows = rows.select("fp", key.alias("key"), (F.col("own") == low).alias("tree"), (F.col("own") == high).alias("query"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n_buckets)))
    return rows.groupBy("bucket").applyInPandas(_link_bucket(radius), "a long, b long")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42, **sizes) -> DataFrame:
    """(id, fp, component) for every row of ``docs``; component is the smallest id reachable.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows share
    their fingerprint; a null id stays null and only names a component in which all ids are
    null; an empty table gives an empty result.  Other columns are not read."""
    fps = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    root = components(links(classes.select("fp"), radius, **sizes)).select(F.col("node").alias("_fp"), "root")
    rooted = written(classes.join(root, F.col("fp") == F.col("_fp"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component")).select(F.col("root").alias("_root"), "component")
    named = written(rooted.join(written(smallest, "smallest"), F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component"), "named")
    return fps.join(named, F.col("fp") == F.col("_fp")).select("id", "fp", "component")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of their near-duplicate group, all columns kept
    whatever their names.  Of repeated rows of one id one stays; rows without an id cannot be
    told apart and all stay."""
    kept = near_groups(docs, id_col=id_col, **options).where("id = component").select(F.col("id").alias("kept")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].alias("id"))
    same = Window.partitionBy("id").orderBy("id")  # the order the join leaves them in
    one = rows.join(kept, F.col("id") == F.col("kept")).withColumn("row", F.row_number().over(same)).where("row = 1")
    return one.select("doc.*").unionByName(docs.where(docs[id_col].isNull()))


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) per row."""
    rows = near_groups(docs, **options)
    return rows.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
