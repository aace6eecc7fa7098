"""Source divergence audit: how far each source's word use lies from the others of its language.

The counts of a language's kept terms by source form a matrix, sources x terms, mostly zero.  A
group's share of a term is an integer in parts per thousand million, at least 1, also where
the term does not occur.  The divergence of two groups sums over all kept terms:

* Terms are dealt to slabs by hash, sources to blocks, and a task takes one slab for one ordered
  pair of blocks.  It builds a K-squared tree (K = 2) over each block: a quadrant without
  a count is absent, the leaves are tiles of 8 x 8 shares.
* Both trees are walked together, quadrants of the same columns side by side.  Where both are
  absent, all pairs of their rows and all their columns have one price each, which is
  multiplied instead of visited; only tiles where either has a count are computed.

Words are counted per (language, source, term) with partial sums before the shuffle, so a source
with a third of all rows is spread over all tasks; no row of a task holds more than a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlab.llm.common import written

UNIT, MIN_DOCS, TOP = 1_000_000_000, 3, 200
#: Characters between terms; terms are lower-cased in A-Z only.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counts of a slab (or the square of the sources, if that is more), sources of a block.
SLAB, ROWS = 1 << 18, 1024
#: Log2 of the side of a leaf tile; tiles computed at once; quadrants of the walk's front.
LEAF, AT_ONCE, FRONT = 3, 2048, 1 << 17


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * count / total) for 0 <= count <= total, three digits at a time: no step
    leaves 63 bits while total is below 9e15."""
    out, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        out, rest = out * 1000 + div(rest * 1000, total), (rest * 1000) % total
    return out + 1


def gap(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group; a group
    without terms has one row with a null term."""
    known = lambda c: F.coalesce(docs[c], F.lit(""))
    rows = docs.select(known(lang_col).alias("lang"), known(source_col).alias("source"), F.array_remove(F.split(F.translate(known(text_col), UPPER, LOWER), GAP), "").alias("_w"))
    rows = rows.select("lang", "source", F.size("_w").alias("_n"), F.posexplode_outer(F.concat("_w", F.array_distinct("_w"))).alias("_i", "term"))
    once = (F.col("_i") >= F.col("_n")).cast("long")
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - once).alias("n"), F.sum(once).alias("docs"))


class Tree:
    """K-squared tree over one block of the matrix.

    ``levels[k]``: for every occupied quadrant of side 2**(LEAF + k) the places of its four quarters
    one level down, -1 for one without counts; ``tiles``: the shares of the occupied leaf tiles."""

    def __init__(self, row, col, share, zero, height: int):
        import numpy as np

        pad = -len(zero) % (1 << LEAF)
        self.zero = np.concatenate([zero, np.ones(pad, np.int64)])
        key = (row >> LEAF << 40) | (col >> LEAF)
        codes, at = np.unique(key, return_inverse=True)
        side = 1 << LEAF
        self.tiles = np.broadcast_to(self.zero.reshape(-1, side, 1)[codes >> 40], (len(codes), side, side)).copy()
        self.tiles[at, row & (side - 1), col & (side - 1)] = share
        self.levels = []
        for _ in range(height):
            r, c = codes >> 40, codes & ((1 << 40) - 1)
            up, at = np.unique((r >> 1 << 40) | (c >> 1), return_inverse=True)
            quarters = np.full((len(up), 4), -1)
            quarters[at, (r & 1) * 2 + (c & 1)] = np.arange(len(codes))
            self.levels.append(quarters)
            codes = up
        self.empty = not len(codes)

    def tile(self, at, row):
        """(n, 8, 8) shares of leaf tiles; absent ones hold their rows' share of no occurrence."""
        import numpy as np

        side = 1 << LEAF
        out = np.broadcast_to(self.zero.reshape(-1, side, 1)[row], (len(at), side, side)).copy()
        there = at >= 0
        out[there] = self.tiles[at[there]]
        return out


def joint_sums(a, b, n_cols: int, height: int):
    """For every row i of tree ``a`` and j of ``b`` the sum over ``n_cols`` terms of (p-q)*(p-q)//q,
    p the share of i and q that of j, by walking both trees together."""
    import numpy as np

    rows_a, rows_b = len(a.zero), len(b.zero)
    value = np.zeros((rows_a, rows_b), np.int64)
    plain = np.zeros((rows_a + 1, rows_b + 1), np.int64)        # corner differences of the columns priced at once
    side = 1 << LEAF

    def priced(level, ra, rb, c):
        size = side << level
        wide = np.minimum((c + 1) * size, n_cols) - c * size
        a0, a1 = np.minimum(ra * size, rows_a), np.minimum((ra + 1) * size, rows_a)
        b0, b1 = np.minimum(rb * size, rows_b), np.minimum((rb + 1) * size, rows_b)
        for x, y, sign in ((a0, b0, 1), (a1, b0, -1), (a0, b1, -1), (a1, b1, 1)):
            np.add.at(plain, (x, y), sign * wide)

    def leaves(na, nb, ra, rb, c):
        real = (c[:, None] * side + np.arange(side)) < n_cols
        p, q = a.tile(na, ra)[:, :, None, :], b.tile(nb, rb)[:, None, :, :]
        got = (((p - q) ** 2 // q) * real[:, None, None, :]).sum(axis=3)
        at = np.arange(side)
        np.add.at(value, ((ra[:, None] * side + at)[:, :, None], (rb[:, None] * side + at)[:, None, :]), got)

    zero = np.zeros(1, np.int64)
    root = lambda t: np.full(1, -1 if t.empty else 0)
    front = [(height, root(a), root(b), zero, zero, zero)] if n_cols else []
    while front:
        level, na, nb, ra, rb, c = front.pop()
        none = (na < 0) & (nb < 0)
        if none.any():
            priced(level, ra[none], rb[none], c[none])
            na, nb, ra, rb, c = (x[~none] for x in (na, nb, ra, rb, c))
        step = AT_ONCE if not level else FRONT
        for low in range(0, len(na), step):
            part = [x[low:low + step] for x in (na, nb, ra, rb, c)]
            if not level:
                leaves(*part)
                continue
            xa, xb, ya, yb, z = part
            down = []
            for i in (0, 1):
                for j in (0, 1):
                    for k in (0, 1):
                        ca = np.where(xa >= 0, a.levels[level - 1][xa, 2 * i + k], -1) if not a.empty else xa
                        cb = np.where(xb >= 0, b.levels[level - 1][xb, 2 * j + k], -1) if not b.empty else xb
                        size = side << (level - 1)
                        real = ((2 * ya + i) * size < rows_a) & ((2 * yb + j) * size < rows_b) & ((2 * z + k) * size < n_cols)
                        down.append([x[real] for x in (ca, cb, 2 * ya + i, 2 * yb + j, 2 * z + k)])
            front.append((level - 1, *(np.concatenate(x) for x in zip(*down, strict=True))))
    many = plain.cumsum(axis=0).cumsum(axis=1)[:rows_a, :rows_b]
    p, q = a.zero[:, None], b.zero[None, :]
    return value + many * ((p - q) ** 2 // q)


def block_pair(rows: int):
    """The task of one slab and one ordered pair of blocks of ``rows`` sources: (lang, i, j, value) of
    all pairs of their rows."""
    def run(key, pdf):
        import numpy as np
        import pandas as pd

        lang, _, first, second = key
        mark = pdf["col"].isna().to_numpy()
        n_cols = int(pdf["width"][mark].iloc[0])
        height = max(0, (max(n_cols, min(len(pdf), rows)) - 1).bit_length() - LEAF)
        row, p = pdf["r"].to_numpy(np.int64), pdf["p"].to_numpy(np.int64)
        col = pdf["col"].fillna(0).to_numpy(np.int64)
        trees, sizes = [], []
        for block in (first, second):
            mine = row // rows == block
            zero = p[mine & mark][np.argsort(row[mine & mark])]
            cell = mine & ~mark
            trees.append(Tree(row[cell] - block * rows, col[cell], p[cell], zero, height))
            sizes.append(len(zero))
        value = joint_sums(*trees, n_cols, height)[:sizes[0], :sizes[1]]
        i, j = np.meshgrid(np.arange(sizes[0]) + first * rows, np.arange(sizes[1]) + second * rows, indexing="ij")
        other = i != j
        return pd.DataFrame({"lang": lang, "i": i[other], "j": j[other], "value": value[other]})

    return run


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, slab_cells: int = SLAB, block_rows: int = ROWS, **cols) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language,
    part ``term`` the ``top`` terms a source uses most above its language.

    Null text, language and source count as empty; repeated rows count each time; ties go to the
    smaller item in UTF-8 order; a language without kept terms has value 0 for all pairs; an
    empty table gives an empty result.  Other columns are not read.  Pairs are what the audit
    returns: their number is the square of the sources of a language, not of its documents."""
    counts = written(term_counts(docs, **cols), "term-counts")
    kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"), F.count("*").alias("cells"))
    kept = written(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    sources = counts.select("lang", "source").distinct()
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"), F.sum("cells").alias("cells"))
    langs = sources.groupBy("lang").agg(F.count("*").alias("s")).join(per_lang, "lang", "left").fillna(0, ["v", "total_lang", "cells"])
    slabs = F.greatest(F.lit(1), F.ceil(F.col("cells") / F.greatest(F.lit(slab_cells), F.col("s") * F.col("s"))))
    langs = written(langs.withColumn("slabs", slabs.cast("long")), "languages")

    slab = F.pmod(F.xxhash64("term"), F.col("slabs")).alias("slab")
    dealt = kept.join(langs, "lang").select("lang", "term", "n_lang", "v", "total_lang", slab)
    order = Window.partitionBy("lang", "slab").orderBy(F.desc("n_lang"), "term")
    dealt = written(dealt.withColumn("col", F.row_number().over(order) - 1), "slabs")
    cells = written(counts.drop("docs").join(dealt, ["lang", "term"]), "cells")

    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = sources.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs.select("lang", "v", "slabs", "s"), "lang")
    zero = F.when(F.col("v") > 0, share(F.lit(1).cast("long"), F.col("total") + F.greatest("v", F.lit(1)))).otherwise(F.lit(1))
    by_size = Window.partitionBy("lang").orderBy(F.desc("total"), "source")     # a row per source
    groups = written(groups.withColumn("zero", zero).withColumn("r", F.row_number().over(by_size).cast("long") - 1), "groups")
    found = cells.join(groups.select("lang", "source", "total", "r", "s"), ["lang", "source"]).withColumn("p", share(F.col("n") + 1, F.col("total") + F.col("v")))

    blocks = lambda: F.explode(tasks(F.col("r"), F.col("s"), block_rows))
    cell_rows = found.select("lang", "slab", "r", "col", "p", F.lit(None).cast("long").alias("width"), blocks().alias("t"))
    widths = dealt.groupBy("lang", "slab").agg(F.count("*").alias("width"))
    marks = groups.withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slabs") - 1))).join(widths, ["lang", "slab"], "left")
    marks = marks.select("lang", "slab", "r", F.lit(None).cast("int").alias("col"), F.col("zero").alias("p"), F.coalesce("width", F.lit(0)).alias("width"), blocks().alias("t"))
    work = cell_rows.unionByName(marks).select("lang", "slab", F.col("t.i").alias("first"), F.col("t.j").alias("second"), "r", "col", "p", "width")
    sums = work.groupBy("lang", "slab", "first", "second").applyInPandas(block_pair(block_rows), "lang string, i long, j long, value long")
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    name = lambda c, as_: groups.select("lang", F.col("r").alias(c), F.col("source").alias(as_))
    pairs = sums.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    q = share(F.col("n_lang") + 1, F.col("total_lang") + F.col("v"))
    terms = found.withColumn("q", q).where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))


def tasks(row: Column, rows: Column, block: int) -> Column:
    """The ordered pairs of blocks (i, j) that need a row: its block first or second, once each."""
    mine = F.floor(row / block)
    every = F.sequence(F.lit(0).cast("long"), F.floor((rows - 1) / block))
    first = F.transform(every, lambda o: F.struct(mine.alias("i"), o.alias("j")))
    return F.concat(first, F.transform(F.filter(every, lambda o: o != mine), lambda o: F.struct(o.alias("i"), mine.alias("j"))))
