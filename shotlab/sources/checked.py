"""Labelled scans that tell what they leave out.

A file of labelled rows may hold broken records, missing values and labels outside the task.
``checked_scan`` gives every record a reason for leaving it out (null: none) and counts the
reasons with an ``Observation`` on the scan itself, so the counts cost no pass of their own.
``Checked.split`` writes kept rows and rejects in the same pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shotlab.sources.labelled import hash_split, resolve_text

#: In the order in which they are looked for; a record gets the first that fits.
REASONS = ("corrupt record", "no id", "no text", "no label", "label unknown", "split unknown")
RECORD = "_record"


@dataclass
class Checked:
    """``judged``: (doc_id, text, label_idx, split, raw_id, raw_label, record, reason)."""

    judged: DataFrame
    observed: Observation

    @property
    def rows(self) -> DataFrame:
        """The kept rows in the canonical schema of ``read_labelled``."""
        return self.judged.filter(F.col("reason").isNull()).select("doc_id", "text", "label_idx", "split")

    @property
    def rejects(self) -> DataFrame:
        return self.judged.filter(F.col("reason").isNotNull()).select("raw_id", "raw_label", "text", "split", "record", "reason")

    @property
    def counts(self) -> dict[str, int]:
        """Records by reason, and ``rows`` of all; waits for the first action on the scan."""
        return {k: int(v) for k, v in self.observed.get.items()}

    def split(self, path: str) -> tuple[DataFrame, DataFrame]:
        """Kept rows and rejects, both written below ``path`` by one pass over the source."""
        spark, schema = self.judged.sparkSession, self.judged.schema
        self.judged.withColumn("kept", F.col("reason").isNull()).write.partitionBy("kept").parquet(path)
        back = Checked(spark.read.schema(schema).parquet(path), self.observed)
        return back.rows, back.rejects


def read_records(spark: SparkSession, path, fmt: str, columns: list[str], options: dict) -> DataFrame:
    """A text format read with every value as a string; a broken record is kept in ``RECORD``."""
    schema = ", ".join(f"`{c}` string" for c in (*columns, RECORD))
    return (spark.read.format(fmt).options(**{"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD, **options})
            .schema(schema).load(path))


def checked_scan(spark: SparkSession, source, classes: int, *, label_col: str = "label", id_col: str = "doc_id", text_col: str = "text",
                 split_col: str | None = None, fmt: str = "parquet", **options) -> Checked:
    """Scan a labelled table (DataFrame or path; parquet, json, csv, ...) and judge every record.

    Left out, with the reason: records the format cannot parse, ids that are no integer, null
    texts, null or empty labels, labels outside 0 to ``classes`` - 1, and a ``split`` other than
    train and test.  Without ``split_col`` rows are split by hash.  Empty texts are kept, repeated
    rows are judged alike, an empty table gives an empty result; other columns are not read."""
    if isinstance(source, DataFrame):
        df = source
    elif fmt in ("json", "csv"):
        df = read_records(spark, source, fmt, [id_col, text_col, label_col, *([split_col] if split_col else [])], options)
    else:
        df = spark.read.format(fmt).options(**options).load(source)
    record = F.col(RECORD) if RECORD in df.columns else F.lit(None).cast("string")
    text = text_col if text_col in df.columns else "content"
    if text not in df.columns:
        resolve_text(df)  # says which columns are wanted
    raw = df.select(F.col(id_col).cast("string").alias("raw_id"), F.col(text).cast("string").alias("text"), F.col(label_col).cast("string").alias("raw_label"),
                    (F.col(split_col) if split_col else F.lit(None)).cast("string").alias("split"), record.alias("record"))
    raw = raw.withColumn("doc_id", F.col("raw_id").try_cast("long")).withColumn("label_idx", F.col("raw_label").try_cast("int"))
    if not split_col:
        raw = raw.withColumn("split", hash_split("doc_id"))
    known = F.col("label_idx").between(0, classes - 1)
    tests = (F.col("record").isNotNull(), F.col("doc_id").isNull(), F.col("text").isNull(), F.coalesce(F.trim("raw_label"), F.lit("")) == "",
             ~F.coalesce(known, F.lit(False)), ~F.coalesce(F.col("split").isin("train", "test"), F.lit(False)))
    reason = F.coalesce(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)])
    judged = raw.select("doc_id", "text", "label_idx", "split", "raw_id", "raw_label", "record", reason.alias("reason"))
    seen = Observation()
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    return Checked(judged.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen)
