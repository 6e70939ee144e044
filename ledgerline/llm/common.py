"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.sequence import key_numbers
from ledgerline.session import run_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word for the operators that split on white space (fixed by their contracts).
WORD = r"[^\x20\x09-\x0D]+"
NULL_ID = -(1 << 63)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the run's folder in the shared checkpoint folder and reads it back.

    Used where a table is read more than once or where a long lineage would be
    recomputed after an executor is lost. ``session.clean_run`` deletes the tables of
    a run once its results have been written.
    """
    path = f"{run_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_corpus_code", None):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), "ledgerline_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "ledgerline")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._corpus_code = path


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    shipped(df.sparkSession)
    return df.mapInArrow(function, schema)


def group_arrow(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    shipped(df.sparkSession)
    return df.groupBy(key).applyInArrow(function, schema)


def local_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of driver values as a plain literal (no Python rows, no RDD)."""
    text = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(text).alias("r")).select("r.*")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that columns added beside it can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _d, _t): ``(_d, _t)`` names one row and sorts like ``doc_id``.

    ``_d`` is doc_id (null: before all others). ``_t`` is 0 unless a doc_id
    occurs in several rows, which are then numbered in the order of their text,
    by a range sort, so that many rows with one doc_id, or none, don't meet in one task.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn(
        "_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    repeated = rows.groupBy("_d").count().where("count > 1").limit(1).count()
    if not repeated:
        return rows.withColumn("_t", F.lit(0))
    numbered = key_numbers(rows, ["_d"], ["text"], out="_t")  # whole rows: equal ones get numbers of their own
    return numbered.select("doc_id", "text", "_d", (F.col("_t") - 1).cast("int").alias("_t"))
