"""Mixing sources to target weights by Pfair windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh, table

#: Target shares of the production mix; sources not named here form the pool ``OTHER``.
OTHER = "*"
WEIGHTS = {"src0": 4, "src1": 2, "src2": 2, "src3": 2, "src4": 2, OTHER: 8}
#: Documents of a block; parts that a source is dealt to, so that a hot source is numbered by many tasks.
BLOCK, PARTS = 32, 1024

#: One cycle of ``w`` slots: at each, of the pools whose next block is released, the one with the earliest deadline
#: takes it.  Block j of a pool with m blocks a cycle is released at floor((j - 1) w / m) and due by ceil(j w / m).
_CYCLE = """
aggregate(sequence(1, w),
  struct(cast(array() as array<int>) AS picks, array_repeat(0, size(offers)) AS taken),
  (s, t) -> struct(
    concat(s.picks, array(array_min(transform(
      filter(sequence(0, size(offers) - 1), i -> s.taken[i] < offers[i] AND s.taken[i] * w DIV offers[i] < t),
      i -> struct(((s.taken[i] + 1) * w + offers[i] - 1) DIV offers[i] AS due, i AS pool))).pool)) AS picks,
    transform(s.taken, (n, k) -> n + int(k = array_min(transform(
      filter(sequence(0, size(offers) - 1), i -> s.taken[i] < offers[i] AND s.taken[i] * w DIV offers[i] < t),
      i -> struct(((s.taken[i] + 1) * w + offers[i] - 1) DIV offers[i] AS due, i AS pool))).pool)) AS taken),
  s -> s.picks)"""


def _schedule(totals: DataFrame) -> DataFrame:
    """``totals(pool, share, blocks)`` -> ``(pool, share, phases)``.

    A cycle takes ``share`` blocks of each pool, fewer in the pool's last one.
    Cycles with the same offers are a phase and have the same plan, so there are
    at most two phases a pool: before and at its end.  All of this is bounded by
    the given weights, not by the data.
    """
    one = totals.agg(F.sort_array(F.collect_list(F.struct("pool", "share", "blocks"))).alias("all"))
    ends = F.expr("array_sort(array_distinct(flatten(transform(all, p -> array(0L, p.blocks DIV p.share, (p.blocks + p.share - 1) DIV p.share)))))")
    offers = (one.withColumn("ends", ends).filter("size(ends) > 1")
              .select("all", F.explode(F.expr("transform(sequence(0, size(ends) - 2), k -> struct(ends[k] AS c, ends[k + 1] AS until))")).alias("e"))
              .select("e.c", "e.until", F.col("all.pool").alias("pools"),
                      F.expr("transform(all, p -> int(least(p.share, greatest(0, p.blocks - e.c * p.share))))").alias("offers"))
              .withColumn("w", F.expr("aggregate(offers, 0, (a, x) -> a + x)")))
    span = Window.partitionBy(F.lit(0)).orderBy("c")
    timed = (offers.withColumn("begin", F.coalesce(F.sum(F.col("w") * (F.col("until") - F.col("c"))).over(span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("picks", F.expr(_CYCLE)))
    slots = F.expr("filter(transform(picks, (p, t) -> if(p = i, t, -1)), t -> t >= 0)")
    each = (timed.select("*", F.posexplode("pools").alias("i", "pool"))
            .select("pool", F.struct("c", "until", "begin", "w", slots.alias("slots")).alias("phase")))
    return totals.join(each.groupBy("pool").agg(F.sort_array(F.collect_list("phase")).alias("phases")), "pool")


#: Of a pool's steps, the last that begins at or before a rank, by halving.
_STEP = """
get({steps}, aggregate(transform(sequence(1, int(ceil(log2(size({steps}) + 1)))), t -> shiftleft(1, int(ceil(log2(size({steps}) + 1))) - t)), 0,
  (at, w) -> if(at + w < size({steps}) AND get({steps}, at + w).low <= {rank}, at + w, at)))"""


def _turns(sources: DataFrame, own: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """``sources(pool, own, n)`` -> ``(pool, own, turn)`` and ``(pool, steps)``: the order in which a pool's sources take turns, one document each.

    Larger sources come first, so those that are left after any number of turns
    are the first ones; a source's document of rank r then stands at
    ``base + (r - low) * active + turn`` of the last step with ``low <= r``.
    There is a step for each size that sources have, so at most as many as the root of
    twice the documents.
    """
    dealt = sources.withColumn("deal", F.pmod(F.xxhash64(own), F.lit(parts)).cast("int"))
    larger = Window.partitionBy("pool").orderBy(F.desc("n"), "deal").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("pool", "n", "deal").agg(F.count(F.lit(1)).alias("m")).withColumn("ahead", F.coalesce(F.sum("m").over(larger), F.lit(0))).drop("m")
    equal = Window.partitionBy("pool", "n", "deal").orderBy(own)
    turns = dealt.withColumn("turn", F.row_number().over(equal) - 1).join(ahead, ["pool", "n", "deal"]).select("pool", own, (F.col("ahead") + F.col("turn")).alias("turn"))
    by = Window.partitionBy("pool").orderBy("n")
    steps = (sources.groupBy("pool", "n").agg(F.count(F.lit(1)).alias("m"))
             .select("pool", "n", F.lag("n", 1, 0).over(by).alias("low"), F.sum("m").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("active"))
             .withColumn("base", F.coalesce(F.sum(F.expr("(n - low) * active")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    return turns, steps.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("low", "base", "active"))).alias("steps"))


def mix_sources(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, parts: int = PARTS) -> DataFrame:
    """Add ``pool``, ``block``, ``slot`` (the block's place in the mix) and ``in_block`` to every row.

    Each pool's documents, in an order by hash, form blocks of ``block``
    documents (the last may be short).  While all pools have blocks, a pool with
    weight w of total W has taken more than t w / W - 1 and less than
    t w / W + 1 blocks after any t slots; once one has ended, the same holds for
    the others with the weights that are left.  No row is dropped or repeated.

    The sources of ``OTHER`` have equal weights in it and take turns, a document
    each, until they end: any first documents of the pool hold as many of one
    as of another that has not ended, or one more or less.

    Rows are numbered in ``parts`` parts of each source and a table of part
    sizes gives the parts' offsets, so one source may hold most rows, and there may be
    as many sources as rows.  Null and unnamed sources belong to ``OTHER`` (share 1 if
    it has no weight), null as a source of its own; repeated
    rows are rows of their own.  Columns with the names of the added ones are
    replaced; an empty table stays empty.
    """
    weights = {OTHER: 1} | (weights or WEIGHTS)
    if any(int(w) != w or w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1")
    docs = docs.drop("pool", "block", "slot", "in_block")
    own, part, spread, rank, before, turn, share, phases, steps, place = fresh(
        docs, "own_", "part_", "spread_", "rank_", "before_", "turn_", "share_", "phases_", "steps_", "place_")
    names = [F.lit(k) for k in weights if k != OTHER]
    rows = (docs.withColumn("pool", F.when(F.col("source").isin(*names), F.col("source")).otherwise(OTHER) if names else F.lit(OTHER))
            .withColumn(own, F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
            .withColumn(spread, F.xxhash64("doc_id", "source"))
            .withColumn(part, F.pmod(F.col(spread), F.lit(parts)).cast("int")))
    sizes = rows.groupBy("pool", own, part).agg(F.count(F.lit(1)).alias("n"))
    turns, held_steps = _turns(sizes.groupBy("pool", own).agg(F.sum("n").alias("n")), own, parts)
    order = Window.partitionBy("pool", own).orderBy(part)
    offsets = sizes.select("pool", own, part, F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before)) \
        .join(turns.withColumnRenamed("turn", turn), ["pool", own])
    share_of = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))])
    totals = sizes.groupBy("pool").agg(F.sum("n").alias("n")).select("pool", share_of[F.col("pool")].alias("share"), F.expr(f"(n + {block - 1}) DIV {block}").alias("blocks"))
    plan = _schedule(totals).select("pool", F.col("share").alias(share), F.col("phases").alias(phases)).join(held_steps.withColumnRenamed("steps", steps), "pool")
    rest = [c for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant"))]  # rows that differ have one order in every run
    in_part = Window.partitionBy("pool", own, part).orderBy(spread, "doc_id", *rest)
    cycle = F.expr(f"block DIV {share}")
    held = F.filter(F.col(phases), lambda p: (p["c"] <= cycle) & (cycle < p["until"]))[0]
    # the offsets, a row for each part of each source, meet the rows where the window has put them: no row moves again
    return (rows.withColumn(rank, F.row_number().over(in_part) - 1)
            .join(offsets.hint("merge"), ["pool", own, part]).join(F.broadcast(plan), "pool")
            .withColumn(rank, F.col(before) + F.col(rank))
            .withColumn(steps, F.expr(_STEP.format(steps=steps, rank=rank)))
            .withColumn(place, F.expr(f"{steps}.base + ({rank} - {steps}.low) * {steps}.active + {turn}"))
            .withColumn("block", F.expr(f"{place} DIV {block}"))
            .withColumn("in_block", F.expr(f"int({place} % {block})"))
            .withColumn(part, held)
            .withColumn("slot", F.expr(f"{part}.begin + (block DIV {share} - {part}.c) * {part}.w + element_at({part}.slots, int(block % {share}) + 1)"))
            .select(*docs.columns, "pool", "block", "slot", "in_block"))


def in_order(mixed: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``mix_sources`` in the order of the mix: sorted within files, files in order."""
    return mixed.repartitionByRange("slot", "in_block").sortWithinPartitions("slot", "in_block").select(*columns)


def with_places(mixed: DataFrame, *columns: str, block: int = BLOCK) -> DataFrame:
    """Rows of ``mix_sources`` in the order of the mix, whose ``slot`` is now the row's own place: ascending, with gaps after short blocks."""
    slot = [] if "slot" in map(str.lower, columns) else ["slot"]
    return in_order(mixed, *mixed.columns).withColumn("slot", F.expr(f"slot * {block} + in_block")).select(*columns, *slot)


def op3_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "pool", "block", "slot", "in_block")
