"""Connected components of a link table, by min-neighbour contraction.

Each round every node takes its smallest neighbour as parent, parents are followed to their
root by repeated self-joins, and the links between different roots are the next round's
graph.  At least half of the nodes with a link disappear in a round.  Minima are
pre-aggregated; each join reads two written tables, so Spark may split a root that holds
much of the graph.  Nothing is collected but one count per step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlab.llm.common import written


def _roots(parent: DataFrame) -> DataFrame:
    """(node, root) with every chain of parents followed to its end."""
    while True:
        up = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        nxt = written(parent.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), (F.coalesce("_r", "root") != F.col("root")).alias("moved")), "roots")
        parent = nxt.select("node", "root")
        if not nxt.where("moved").limit(1).count():
            return parent


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Null ends and self-links are ignored, repeated links change nothing, an empty table gives
    an empty result."""
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    label = None
    while links.limit(1).count():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parent = ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root"))
        root = _roots(written(parent, "parent"))
        at = lambda c: root.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"r{c}"))
        first = written(links.join(at("a"), F.col("a") == F.col("_a")).select("b", "ra"), "half")
        links = written(first.join(at("b"), F.col("b") == F.col("_b")).where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if label is None:
            label = root
        else:
            up = root.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            label = written(label.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "label")
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return label


def forest(n: int, pairs, labels=None):
    """Labels of 0..n-1 (smallest index of the component) after joining ``pairs`` of index arrays
    to earlier ``labels``; numpy, for the links found inside one task."""
    import numpy as np

    labels = np.arange(n) if labels is None else labels
    a, b = pairs
    while len(a):
        ra, rb = labels[a], labels[b]
        differ = ra != rb
        if not differ.any():
            return labels
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels
