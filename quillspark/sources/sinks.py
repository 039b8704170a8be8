"""Document sinks.

Rows of a document are ``(out_file, rank…, text)``.  Both sinks shuffle once
with range partitioning on ``(out_file, order…)`` and sort inside partitions:
a document is a folder whose part files, in part-number order, hold its rows
in order.  A package with a very large share of the rows is therefore split
over several tasks (several ordered parts) instead of one task writing it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_per_group(rows: DataFrame, out_dir: str, order: Sequence[str], group_col: str = "out_file",
                    text_col: str = "text") -> None:
    """One text document per ``group_col`` value (partition folder ``group_col=…``).

    The rows are persisted (memory and disk; rebuilt from lineage if an
    executor is lost) so the range partitioner's sampling pass does not
    recompute the whole rendering plan.
    """
    from pyspark import StorageLevel
    kept = rows.select(group_col, *order, text_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        (kept.repartitionByRange(group_col, *order).sortWithinPartitions(group_col, *order)
         .select(group_col, text_col).write.mode("overwrite").partitionBy(group_col).text(out_dir))
    finally:
        kept.unpersist()


def write_merged(rows: DataFrame, out_dir: str, order: Sequence[str], text_col: str = "text") -> None:
    """All rows as one ordered document split over part files (range partitioned)."""
    from pyspark import StorageLevel
    kept = rows.select(*order, text_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kept.orderBy(*order).select(text_col).write.mode("overwrite").text(out_dir)
    finally:
        kept.unpersist()


#: Documents of a folder: their files are listed, committed and read by the driver at a time.
FOLDER_DOCS = 25_000


def write_lines(lines: DataFrame, out_dir: str, order: Sequence[str], doc_col: str | None = None, text_col: str = "text") -> None:
    """Lines (no line ends in ``text_col``) as ordered text files, a folder ``doc_col=…`` for each document, or all as one document.

    The folders of documents are dealt to folders ``docs-…`` of about ``FOLDER_DOCS`` each, written one after the other: the driver never holds
    the paths of all documents.
    """
    from pyspark import StorageLevel
    docs = [doc_col] if doc_col else []
    kept = lines.select(*docs, *order, text_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        folders = -(-kept.select(doc_col).distinct().count() // FOLDER_DOCS) if doc_col else 1
        # a task for each core: the planner would give a folder's documents, which are small, to few tasks
        tasks = [lines.sparkSession.sparkContext.defaultParallelism] if doc_col else []
        for k in range(folders):
            own = kept.filter(F.pmod(F.xxhash64(doc_col), F.lit(folders)) == k) if folders > 1 else kept
            writer = own.repartitionByRange(*tasks, *docs, *order).sortWithinPartitions(*docs, *order).select(*docs, text_col).write.mode("overwrite")
            (writer.partitionBy(doc_col).text(f"{out_dir}/docs-{k:05d}") if doc_col else writer.text(out_dir))
    finally:
        kept.unpersist()


def _folders(spark, out_dir: str) -> list[str]:
    """The folders ``docs-…`` that ``write_lines`` made."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().toString() for s in found if s.isDirectory() and s.getPath().getName().startswith("docs-"))


def _texts(spark, out_dir: str, doc_col: str | None) -> DataFrame:
    """``doc_col``, ``part`` and ``value`` of each file of a folder."""
    docs = [doc_col] if doc_col else []
    text = spark.read.schema(", ".join(["value string", *[f"`{c}` string" for c in docs]])).text(out_dir, wholetext=True)
    # the planner takes each file for 4 MB at least: small documents would come a few to a task
    return (text.coalesce(4 * spark.sparkContext.defaultParallelism) if doc_col else text).select(*docs, F.col("_metadata.file_name").alias("part"), "value")


def _manifest(texts: DataFrame, doc_col: str | None) -> DataFrame:
    docs = [doc_col] if doc_col else []
    counts = texts.select(*docs, "part", (F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))).cast("long").alias("lines"))
    # files of one document, a few numbers each; a merged document has as many as the write had tasks
    before = Window.partitionBy(*docs or [F.lit(0)]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first_line", F.coalesce(F.sum("lines").over(before), F.lit(0)) + 1)


def _each_folder(spark, out_dir: str, doc_col: str, rows, schema: str) -> DataFrame:
    """``rows(texts)`` of one folder after the other, as one table: what the driver lists of a folder goes before the next one."""
    path = scratch_dir(spark, "documents-read")
    for folder in _folders(spark, out_dir):
        rows(_texts(spark, folder, doc_col)).write.mode("append").parquet(path)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def document_manifest(spark, out_dir: str, doc_col: str | None = None) -> DataFrame:
    """What is on disk: ``doc_col``, ``part`` (file), ``first_line`` (from 1) and ``lines`` of each file, in part order."""
    if not doc_col:
        return _manifest(_texts(spark, out_dir, None), None)
    return _each_folder(spark, out_dir, doc_col, lambda t: _manifest(t, doc_col), f"`{doc_col}` string, part string, lines long, first_line long")


def read_lines(spark, out_dir: str, doc_col: str | None = None) -> DataFrame:
    """The documents read back: ``doc_col``, ``line_no``, ``text`` for every line on disk."""
    docs = [doc_col] if doc_col else []

    def rows(texts: DataFrame) -> DataFrame:
        text = texts.select(*docs, "part", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n", -1)).alias("at", "text"))
        return text.join(_manifest(texts, doc_col).drop("lines"), [*docs, "part"]) \
            .select(*docs, (F.col("first_line") + F.col("at")).cast("long").alias("line_no"), "text")
    if not doc_col:
        return rows(_texts(spark, out_dir, None))
    return _each_folder(spark, out_dir, doc_col, rows, f"`{doc_col}` string, line_no long, text string")


def scratch_dir(spark, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    import uuid

    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: computed once however often it is read; lost executors cost nothing, and small tables come in few partitions."""
    path = scratch_dir(df.sparkSession, "document-part")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
