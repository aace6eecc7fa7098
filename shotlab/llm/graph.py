"""Embedding near-dedup by range search in a robust-pruned flat graph.

1. Equal vectors of a label are one node with a weight.
2. Labels with many nodes are cut into cluster shards: centroids are fitted by k-means on a
   bounded sample (``sample_rows``; at most ``max_centroids`` in all, so the model can be
   broadcast), and every node joins the shards of its ``overlap`` nearest centroids.
3. Each shard builds a robust-pruned graph: a node keeps its nearest candidate and drops those
   ``alpha`` times closer to it than to the node, and so on; candidates inside the link radius
   are all tried, of those beyond it the list stops at ``degree`` neighbours.
4. The adjacency lists a node got in its shards are united.
5. Each node is searched in each of its shards: a greedy walk from the shard's medoid, then an
   expansion from there and from the node itself over all nodes within (1 + 1/alpha) times the
   link radius.  Inside a shard this reaches every link: if c is in range of p but not its
   neighbour, a neighbour s of p is at least alpha times closer to c, and so on down to c.
6. Links are verified by their cosine in double precision.  A pair that shares several shards
   counts in the first, so counts need no pair to leave its task; components get a
   spanning forest of each shard's links.
7. Recall is audited: a bounded sample of nodes is compared with all nodes by brute force, and
   a recall below ``least_recall`` is an error.

A shard of more than ``block`` nodes is cut into blocks, and each pair of blocks is a group of
its own (two blocks bound the memory of a task); no links are lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlab.llm.common import written
from shotlab.llm.components import components, forest

KEYS = ["label", "dim", "shard", "low", "high"]


def units(column):
    """(rows, dim) unit vectors in double precision of a list column of equal lengths."""
    import numpy as np

    x = np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(vec):
    """Neither null nor empty nor zero, without null or non-finite components."""
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def fit_centroids(nodes: DataFrame, *, shard_rows: int, max_centroids: int, sample_rows: int, rounds: int = 6) -> dict:
    """{(label, dim): centroids} for the labels of over ``shard_rows`` nodes; the others are one
    shard each.  At most ``max_centroids`` labels and ``sample_rows`` vectors reach the driver."""
    import numpy as np

    sizes = nodes.groupBy("label", "dim").count().where(F.col("count") > shard_rows).orderBy(F.desc("count"), "label", "dim").limit(max_centroids).collect()
    total = sum(r["count"] for r in sizes)
    if not total:
        return {}
    part = min(1.0, sample_rows / total)
    keep = F.pmod(F.xxhash64("cid", F.lit("sample")), F.lit(1 << 30)) < int(part * (1 << 30))
    rows = nodes.where(keep).select("label", "dim", "cid", "vec").orderBy(F.xxhash64("cid")).limit(2 * sample_rows).toPandas()
    per = max(shard_rows, total / max_centroids)
    wanted, model = {(r["label"], r["dim"]): int(-(-r["count"] // per)) for r in sizes}, {}
    for key, some in rows.groupby(["label", "dim"], sort=True):
        k = wanted.get(key, 1)
        x = units(some.sort_values("cid")["vec"].tolist())
        k = min(k, len(x))
        if k < 2:
            continue
        c = x[np.random.default_rng(0).choice(len(x), k, replace=False)]
        for _ in range(rounds):
            near = np.argmax(x @ c.T, axis=1)
            mean = np.zeros_like(c)
            np.add.at(mean, near, x)
            size = np.sqrt((mean * mean).sum(axis=1))[:, None]
            c = np.where(size > 1e-9, mean / np.maximum(size, 1e-9), c)
        model[key] = c
    return model


def members(nodes: DataFrame, model: dict, overlap: int, block: int) -> DataFrame:
    """One row per node and shard, with all shards of the node and the blocks of the group."""
    sent = nodes.sparkSession.sparkContext.broadcast(model)
    kind = nodes.schema["label"].dataType.simpleString()

    def assign(batches):
        import pandas as pd

        for pdf in batches:
            out = [[0]] * len(pdf)
            for key, at in pdf.groupby(["label", "dim"]).indices.items():
                c = sent.value.get(key)
                if c is not None:
                    import numpy as np

                    near = np.argsort(-(units(pdf["vec"].iloc[at].tolist()) @ c.T), axis=1, kind="stable")[:, :overlap]
                    for i, s in zip(at, np.sort(near, axis=1).tolist(), strict=True):
                        out[i] = s
            yield pdf.assign(shards=pd.Series(out, index=pdf.index, dtype=object))

    rows = nodes.mapInPandas(assign, f"label {kind}, dim int, vec array<float>, cid long, n long, shards array<int>")
    rows = written(rows.withColumn("shard", F.explode("shards")), "members")
    size = rows.groupBy("label", "dim", "shard").count().where(F.col("count") > block)
    size = written(size.select(F.col("label").alias("_l"), F.col("dim").alias("_d"), F.col("shard").alias("_s"), F.ceil(F.col("count") / block).cast("int").alias("parts")), "large")
    rows = rows.join(size, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")) & (F.col("shard") == F.col("_s")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cid", F.lit("block")), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("label", "dim", "shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cid", "n", "vec", "shards")


def prune(x, radius: float, alpha: float, degree: int, pool: int = 128):
    """Robust-pruned neighbour lists of every row of unit vectors ``x``."""
    import numpy as np

    n, out = len(x), []
    for at in range(0, n, 512):
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (x[at:at + 512] @ x.T)))
        for i, row in enumerate(d):
            p = at + i
            row[p] = np.inf
            some = np.argpartition(row, pool)[:pool] if n > pool + 1 else np.arange(n)
            some = np.union1d(some, np.flatnonzero(row <= radius))
            some = some[some != p]
            some = some[np.argsort(row[some], kind="stable")]
            dp, y, kept = row[some], x[some], []
            alive = np.ones(len(some), bool)
            k = 0
            while k < len(some) and (dp[k] <= radius or len(kept) < degree):
                kept.append(some[k])
                alive[k:] &= alpha * np.sqrt(np.maximum(0.0, 2 - 2 * (y[k:] @ y[k]))) > dp[k:]
                alive[k] = False
                rest = np.flatnonzero(alive[k:])
                if not len(rest):
                    break
                k += int(rest[0])
            out.append(np.array(kept, np.int64))
    return out


def range_search(x, lists, start: int, cosine: float, alpha: float, queries: int = 256):
    """Yields (query, found) index arrays of all pairs of ``cosine`` or more, each node of the
    graph ``lists`` being a query: greedy walk from ``start``, then range expansion."""
    import numpy as np

    n = len(x)
    first = np.cumsum([0, *map(len, lists)])
    flat = np.concatenate(lists) if first[-1] else np.zeros(0, np.int64)
    slack = 1 - ((1 + 1 / alpha) ** 2) * (1 - cosine)  # cosine at (1 + 1/alpha) times the link radius

    def around(q, node):
        size = first[node + 1] - first[node]
        at = np.repeat(first[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(q, size), flat[at]

    def cos(q, node):
        out = np.empty(len(q))
        for a in range(0, len(q), 1 << 16):
            out[a:a + (1 << 16)] = np.einsum("ij,ij->i", x[q[a:a + (1 << 16)]], x[node[a:a + (1 << 16)]])
        return out

    for at in range(0, n, queries):
        asks = np.arange(at, min(n, at + queries))
        here = np.full(len(asks), start)
        best, live = cos(asks, here), np.arange(len(asks))
        while len(live):
            i, node = around(live, here[live])
            if not len(i):
                break
            c = cos(asks[i], node)
            order = np.lexsort((-node, c, i))
            last = order[np.r_[i[order][1:] != i[order][:-1], True]]
            better = c[last] > best[i[last]]
            live = i[last][better]
            here[live], best[live] = node[last][better], c[last][better]
        seen = np.zeros((len(asks), n), bool)
        seen[np.arange(len(asks)), here] = True
        seen[np.arange(len(asks)), asks] = True
        i, node = np.nonzero(seen)
        while len(i):
            c = cos(asks[i], node)
            hit = (c >= cosine) & (node != asks[i])
            if hit.any():
                yield asks[i[hit]], node[hit]
            go = c >= slack
            i, near = around(i[go], node[go])
            fresh = np.zeros_like(seen)
            fresh[i, near] = True
            fresh &= ~seen
            seen |= fresh
            i, node = np.nonzero(fresh)


def _build(cosine: float, alpha: float, degree: int):
    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("cid")
        cid = pdf["cid"].to_numpy()
        lists = prune(units(pdf["vec"].tolist()), np.sqrt(2 - 2 * cosine), alpha, degree)
        return pd.DataFrame({"cid": cid, "near": [cid[a].tolist() for a in lists]})

    return run


def _search(cosine: float, alpha: float):
    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("cid")
        cid, n, own = pdf["cid"].to_numpy(), pdf["n"].to_numpy(), pdf["own"].to_numpy()
        low, high, shard = (int(pdf[c].iloc[0]) for c in ("low", "high", "shard"))
        x = units(pdf["vec"].tolist())
        lists = []
        for near in pdf["near"]:
            at = np.searchsorted(cid, np.sort(np.asarray(near, np.int64)))
            at = np.minimum(at, len(cid) - 1)
            lists.append(at[cid[at] == np.sort(np.asarray(near, np.int64))])
        most = max(map(len, pdf["shards"]))
        mine = np.full((len(pdf), most), -1)
        for i, s in enumerate(pdf["shards"]):
            mine[i, :len(s)] = s
        medoid = int(np.argmax(x @ x.mean(axis=0)))
        count, labels = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        for q, f in range_search(x, lists, medoid, cosine, alpha):
            labels = forest(len(pdf), (q, f), labels)
            both = (mine[q][:, :, None] == mine[f][:, None, :]).any(axis=2) & (mine[q] >= 0)
            first = mine[q, np.argmax(both, axis=1)]
            here = (first == shard) & (np.minimum(own[q], own[f]) == low) & (np.maximum(own[q], own[f]) == high)
            np.add.at(count, q[here], n[f[here]])
        return pd.DataFrame({"cid": cid, "links": count, "root": cid[labels]})

    return run


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(label, dim, vec, cid, n): distinct usable vectors of each label; cid is the smallest vec_id."""
    ok = vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("vec")))
    return ok.groupBy("label", F.size("vec").alias("dim"), "vec").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"))


def audit(nodes: DataFrame, found: DataFrame, cosine: float, rows: int) -> float:
    """Share of the true links of a sample of about ``rows`` nodes that ``found`` (cid, links) has."""
    import numpy as np

    total = nodes.count()
    pick = F.pmod(F.xxhash64("cid", F.lit("audit")), F.lit(1 << 30)) < int(min(1.0, rows / max(1, total)) * (1 << 30))
    some = nodes.where(pick).select("label", "dim", "cid", "vec").limit(4 * rows).toPandas()
    if some.empty:
        return 1.0
    asked = {k: (g["cid"].to_numpy(), units(g["vec"].tolist())) for k, g in some.groupby(["label", "dim"])}
    sent = nodes.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for key, g in pdf.groupby(["label", "dim"]):
                if key in sent.value:
                    cid, q = sent.value[key]
                    c = np.einsum("ik,jk->ij", q, units(g["vec"].tolist()))
                    hit = (c >= cosine) & (cid[:, None] != g["cid"].to_numpy()[None, :])
                    yield pd.DataFrame({"cid": cid, "true": (hit * g["n"].to_numpy()[None, :]).sum(axis=1)})

    true = nodes.mapInPandas(run, "cid long, true long").groupBy("cid").agg(F.sum("true").alias("true"))
    both = true.join(found, "cid").agg(F.sum(F.least("true", "links")).alias("got"), F.sum("true").alias("all")).collect()[0]
    return 1.0 if not both["all"] else both["got"] / both["all"]


def near_vectors(table: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, alpha: float = 1.2, degree: int = 24,
                 overlap: int = 2, shard_rows: int = 512, block: int = 2048, max_centroids: int = 8192, sample_rows: int = 20_000, audit_rows: int = 200, least_recall: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table``.

    Rows with a null label or vec_id, and vectors that are null, empty, zero or hold null or
    non-finite components link with nothing and are kept.  Vectors of different lengths do not
    link.  Repeated rows are vectors of their own that link with each other; an empty table
    gives an empty result; other columns are not read."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<float>").alias("vec"))
    nodes = written(nodes_of(rows), "nodes")
    model = fit_centroids(nodes, shard_rows=shard_rows, max_centroids=max_centroids, sample_rows=sample_rows)
    group = written(members(nodes, model, overlap, block), "groups")
    near = group.groupBy(*KEYS).applyInPandas(_build(cosine, alpha, degree), "cid long, near array<long>")
    near = written(near.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    found = group.join(near.withColumnRenamed("cid", "_cid"), F.col("cid") == F.col("_cid")).drop("_cid")
    found = written(found.groupBy(*KEYS).applyInPandas(_search(cosine, alpha), "cid long, links long, root long"), "found")
    links = written(found.groupBy("cid").agg(F.sum("links").alias("links")), "counts")
    recall = audit(nodes, links, cosine, audit_rows)
    if recall < least_recall:
        raise RuntimeError(f"the graph search found {recall:.3f} of the audited links; raise overlap or degree")
    comp = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    done = nodes.join(links.withColumnRenamed("cid", "_c"), F.col("cid") == F.col("_c")).join(comp.select(F.col("node").alias("_n"), "root"), F.col("cid") == F.col("_n"), "left")
    done = written(done.select(F.col("label").alias("_label"), F.col("vec").alias("_vec"), (F.col("links") + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component")), "done")
    in_node = F.col("vec_id").isNotNull() & usable(F.col("vec"))
    out = rows.withColumn("_ok", in_node).join(done, (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec")) & F.col("_ok"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
