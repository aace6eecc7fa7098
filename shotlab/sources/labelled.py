"""Labelled text scans.

A labelled table is ``(doc_id BIGINT, text STRING, label_idx INT, split STRING)``.
``read_labelled`` accepts any table the user has; ``task_rows`` builds the
reference's task shapes out of the driver's ``documents`` / ``labels`` tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlab.functions.text import coarsen
from shotlab.sources.registry import task as get_task

# Train share of the hash split: first hex digit of md5('split|id') below 'b' (11/16).
SPLIT_DIGIT = "b"


def resolve_text(df: DataFrame) -> DataFrame:
    """Use ``text`` if the column exists, else ``content`` (decided by schema, not nulls)."""
    if "text" in df.columns:
        return df
    if "content" in df.columns:
        return df.withColumnRenamed("content", "text")
    raise ValueError("labelled table needs a 'text' or 'content' column")


def hash_split(id_col: str = "doc_id"):
    return F.when(F.substring(F.md5(F.concat(F.lit("split|"), F.col(id_col).cast("string"))), 1, 1)
                  < F.lit(SPLIT_DIGIT), F.lit("train")).otherwise(F.lit("test"))


def read_labelled(spark: SparkSession, source, label_col: str = "label", id_col: str = "doc_id",
                  split_col: str | None = "split", fmt: str = "parquet") -> DataFrame:
    """Scan a labelled dataset (path or DataFrame) into the canonical schema.

    A predefined split column is kept; without one rows are split by hash.
    """
    df = source if isinstance(source, DataFrame) else spark.read.format(fmt).load(source)
    df = resolve_text(df)
    split = F.col(split_col) if split_col and split_col in df.columns else hash_split(id_col)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text"),
                     F.col(label_col).cast("int").alias("label_idx"), split.alias("split"))


# Fixed class rules for the driver-table fixtures.
LANGS = ["de", "en", "es", "fr"]
LENGTH_EDGES = [500, 1000, 2000, 4000]   # n_chars bucket edges -> 5 classes


def task_rows(spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    """Labelled rows for a reference-style task name, built from driver tables.

    sst2 -> ``labels.quality``; CR -> ``labels.toxic``; ag -> document
    language; sst5 -> length bucket; sst3 -> sst5 coarsened by 1.5;
    dbpedia -> source number modulo 14.
    """
    t = get_task(dataset)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if t.key in ("sst2", "CR"):
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
        col = "quality" if t.key == "sst2" else "toxic"
        base = docs.join(labels.select("doc_id", F.col(col).alias("label")), "doc_id")
    elif t.key == "ag":
        idx = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")) - 1
        base = docs.withColumn("label", idx.cast("int")).filter(F.col("label") >= 0)
    elif t.key in ("sst5", "sst3"):
        n = F.col("n_chars")
        lab = F.lit(0)
        for e in LENGTH_EDGES:
            lab = lab + (n >= F.lit(e)).cast("int")
        base = docs.withColumn("label", lab)
    elif t.key == "dbpedia":
        num = F.regexp_extract("source", r"^src(\d+)$", 1)
        base = docs.withColumn("label", F.when(num != "", num.cast("int") % len(t.labels))).filter(F.col("label").isNotNull())
    else:  # pragma: no cover - task_key already raised
        raise ValueError(dataset)
    out = read_labelled(spark, base.select("doc_id", "text", "label"))
    if t.coarsen_by:
        out = out.withColumn("label_idx", coarsen("label_idx", t.coarsen_by))
    return out
