"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

ARROW_BATCH_BYTES, ARROW_BATCH_ROWS = str(2 << 20), "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage, so later jobs neither repeat the work nor depend on the
    local disks of executors.  Every call takes a folder of its own.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_arrow_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts don't meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have (compared without case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def identified(df: DataFrame, file: str, place: str) -> DataFrame:
    """Name each row by its file and its place there, the same in every job over it.

    For a scan of Parquet files (with filters or fewer columns, but nothing that
    repeats rows); anything else is written once and then read as such a scan.
    """
    try:
        known = df.metadataColumn("_metadata")
        return df.select("*", known["file_path"].alias(file), known["row_index"].alias(place))
    except AnalysisException:
        return identified(written(df, "rows"), file, place)
