"""Ordering and numbering.

Global numbering never uses an unpartitioned window: the frame is range
sorted, each partition counts its rows, the (tiny, one row per partition)
count table gives every partition its offset, and the offsets are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_index(df: DataFrame, order_cols: Sequence[str | Column], name: str = "idx",
                 start: int = 1) -> DataFrame:
    """Add a dense 1-based position in ``order_cols`` order without one-task windows.

    The sorted frame is checkpointed (shared checkpoint folder) so both the
    count pass and the numbering pass read the very same partitioning, and a
    lost executor recomputes from the checkpoint, not from the sort.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    pid, mid = "__qs_pid", "__qs_mid"
    srt = df.orderBy(*order_cols).withColumn(pid, F.spark_partition_id()) \
        .withColumn(mid, F.monotonically_increasing_id())
    srt = srt.checkpoint(eager=True)
    counts = srt.groupBy(pid).agg(F.count(F.lit(1)).alias("__qs_n"))
    offs = counts.withColumn(
        "__qs_off",
        F.sum("__qs_n").over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)),
    ).select(pid, F.coalesce(F.col("__qs_off"), F.lit(0)).alias("__qs_off"))
    # one row per partition: bounded by the partition count, safe to broadcast
    out = srt.join(F.broadcast(offs), pid)
    local = F.col(mid) - F.shiftleft(F.col(pid).cast("long"), 33)
    return out.withColumn(name, (F.col("__qs_off") + local + F.lit(start)).cast("long")) \
        .drop(pid, mid, "__qs_off")


def run_blocks(df: DataFrame, part: Sequence[str], order: Sequence[str], key: str,
               block: str = "block_id", chunk: Column | None = None) -> DataFrame:
    """Adjacent rows with equal ``key`` (within ``part``, in ``order``) share a block id.

    Without ``chunk`` one window per ``part`` value computes the ids.  With
    ``chunk`` (a column that never decreases along ``order``, e.g. the day of
    a timestamp) a hot ``part`` value is split: runs are numbered inside each
    (part, chunk), a small per-chunk summary (block count, first and last
    key) gives every chunk its offset — a run that continues across a chunk
    boundary keeps one id — and the offsets are joined back.  No task holds
    more than one chunk of a hot group.
    """
    if chunk is None:
        w = Window.partitionBy(*part).orderBy(*order)
        changed = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
        return df.withColumn("__qs_chg", changed) \
            .withColumn(block, F.sum("__qs_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")) \
            .drop("__qs_chg")
    x = df.withColumn("__qs_chunk", chunk)
    wl = Window.partitionBy(*part, "__qs_chunk").orderBy(*order)
    x = x.withColumn("__qs_chg", F.when(F.lag(key).over(wl).eqNullSafe(F.col(key)), 0).otherwise(1)) \
        .withColumn("__qs_lb", F.sum("__qs_chg").over(wl.rowsBetween(Window.unboundedPreceding, 0)))
    pos = F.struct(*[F.col(c) for c in order])
    summ = x.groupBy(*part, "__qs_chunk").agg(
        F.max("__qs_lb").alias("__qs_n"),
        F.min_by(F.struct(F.col(key).alias("v")), pos).alias("__qs_f"),
        F.max_by(F.struct(F.col(key).alias("v")), pos).alias("__qs_l"))
    wc = Window.partitionBy(*part).orderBy("__qs_chunk")
    cont = F.when(F.lag("__qs_n").over(wc).isNotNull() &
                  F.lag("__qs_l").over(wc)["v"].eqNullSafe(F.col("__qs_f")["v"]), 1).otherwise(0)
    summ = summ.withColumn("__qs_cont", cont).withColumn(
        "__qs_off",
        F.coalesce(F.sum("__qs_n").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        - F.sum("__qs_cont").over(wc.rowsBetween(Window.unboundedPreceding, 0)))
    out = x.join(summ.select(*part, "__qs_chunk", "__qs_off"), [*part, "__qs_chunk"])
    return out.withColumn(block, (F.col("__qs_lb") + F.col("__qs_off")).cast("long")) \
        .drop("__qs_chunk", "__qs_chg", "__qs_lb", "__qs_off")


# Section order of a package document (O2).
SECTION_ORDER_DEFAULT = ["package", "imports", "interfaces", "structs", "types", "consts",
                         "functypes", "vars", "functions"]
SECTION_ORDER_PACKAGE_MODE = ["imports", "interfaces", "structs", "functions", "vars", "consts"]


def section_rank(kind: Column | str, package_mode: bool = False) -> Column:
    """Rank of a section kind (null: section not rendered in that mode)."""
    k = F.col(kind) if isinstance(kind, str) else kind
    order = SECTION_ORDER_PACKAGE_MODE if package_mode else SECTION_ORDER_DEFAULT
    expr = None
    for i, name in enumerate(order):
        expr = F.when(k == name, F.lit(i)) if expr is None else expr.when(k == name, F.lit(i))
    return expr
