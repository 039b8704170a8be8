"""Incremental corpus walk on Structured Streaming.

New corpus files (Parquet parts of a corpus table, or text files) are picked
up by the file source; each micro-batch is processed with ``foreachBatch``
and merged into a table kept in buckets of its key.  A batch reads and rewrites only the buckets that
its keys fall in, under a folder of its own, and a manifest then names the folder of every
bucket's present rows: readers see a batch as a whole or not at all, and a batch that is
repeated after a failure gives the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table, unless told otherwise (fixed when its first batch is written).
BUCKETS = 64


def _manifest(spark: SparkSession, target: str, batch_id: int) -> DataFrame:
    return spark.read.schema("bucket int, folder long").parquet(f"{target}/manifest/batch={batch_id}")


def _rows(spark: SparkSession, target: str, folders: dict[int, int], schema) -> DataFrame:
    """Rows of the buckets in ``folders`` (bucket -> batch that wrote it); no other file is opened."""
    paths = [f"{target}/data/batch={batch}/__bucket={bucket}" for bucket, batch in sorted(folders.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write_manifest(spark: SparkSession, target: str, batch_id: int, folders: dict[int, int]) -> None:
    """One small file, put in place by a rename."""
    spark.createDataFrame(sorted(folders.items()), "bucket int, folder long").coalesce(1).write.mode("overwrite") \
        .parquet(f"{target}/manifest/batch={batch_id}")


def merge_batch(target: str, rows: DataFrame, batch_id: int, key: list[str], version: str, buckets: int = BUCKETS) -> None:
    """Merge ``rows`` into the table at ``target`` as batch ``batch_id``, on the state that batch ``batch_id - 1`` left.

    Of the rows with one key (nulls are equal) the one with the highest ``version`` stays, be it old or
    new, of equal ones the greatest by its other columns.  The driver sees
    bucket numbers only.
    """
    spark, names, rows = rows.sparkSession, rows.columns, rows.persist()  # read twice below
    before = {r.bucket: r.folder for r in _manifest(spark, target, batch_id - 1).collect()} if batch_id > 0 else {}
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # as many as there are buckets at most
    old = _rows(spark, target, {b: before[b] for b in touched if b in before}, rows.schema)
    others = [c for c in names if c not in key and c != version]
    best = F.max(F.struct(version, *others)).alias("__best")
    merged = old.select(*names).unionByName(rows).groupBy(*key).agg(best).select(*key, "__best.*").select(*names)
    merged.withColumn("__bucket", bucket).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{target}/data/batch={batch_id}")
    _write_manifest(spark, target, batch_id, before | dict.fromkeys(touched, batch_id))
    rows.unpersist()


def incremental_walk(spark: SparkSession, source_dir: str, schema, checkpoint_dir: str, target_dir: str,
                     process: Callable[[DataFrame], DataFrame], key: list[str], version: str,
                     max_files_per_trigger: int = 64, buckets: int = BUCKETS) -> None:
    """Process every file in ``source_dir`` that the checkpoint hasn't seen (Trigger.AvailableNow) and merge it into ``target_dir``.

    ``process`` maps a batch of corpus rows to result rows that carry ``key`` and ``version``, see :func:`merge_batch`.
    """
    target = target_dir.rstrip("/")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    q = (stream.writeStream.foreachBatch(lambda batch, i: merge_batch(target, process(batch), i, key, version, buckets))
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def final_state(spark: SparkSession, target_dir: str, schema) -> DataFrame:
    """The table as the last whole batch left it: one row for each key."""
    target = target_dir.rstrip("/")
    last = spark.read.schema("bucket int, folder long, batch long").parquet(f"{target}/manifest").agg(F.max("batch")).first()[0]
    return _rows(spark, target, {r.bucket: r.folder for r in _manifest(spark, target, last).collect()}, schema)
