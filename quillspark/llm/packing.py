"""Best-fit packing by levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh, small_arrow_batches, table, written
from .tokens import coder, default_tokenizer

CAPACITY = 2048
#: Units that one task packs at a time; free tokens up to which a bin counts as full; least share of bins that a round must save before the root is packed.
GROUP, SLACK, SAVED = 8192, 8, 0.002
#: Places of the mix whose documents are packed together (one cycle of the default mix); pieces that a document may have.
SPAN, PIECES = 640, 1 << 21
_ROWS, _BYTES = 2000, 8 << 20


def _cut(path: str, capacity: int, end_id: int, carried: tuple = ()):
    def run(batches):
        import pyarrow as pa

        ids_of, end = coder(path).ids, np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids", *carried]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64() for _ in carried]]
        out, held = [[] for _ in names], 0
        for batch in batches:
            for doc, text, *place in zip(*(c.to_pylist() for c in batch.columns)):
                ids = ids_of(text or "") + end
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (doc, piece, a, b - a, ids[4 * a:4 * b], *place)):
                        column.append(value)
                    held += 4 * (b - a)
                    if len(out[0]) >= _ROWS or held >= _BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                        out, held = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
    return run


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, place: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit) and ``place``, if given.

    A document's ids are those of its whole text and then ``end_id``.  Only
    longer ones are cut: the first piece takes what is over a multiple of
    ``capacity``, the others are full.  Null text is empty: one piece with
    ``end_id`` alone.  Repeated rows each give their pieces.
    """
    small_arrow_batches(docs.sparkSession)
    carried = (place,) if place else ()
    return (docs.select(F.col("doc_id").cast("long"), "text", *[F.col(c).cast("long") for c in carried])
            .mapInArrow(_cut(path or default_tokenizer(), capacity, end_id, carried),
                        ", ".join(["doc_id long, piece int, start long, length long, ids binary", *[f"{c} long" for c in carried]])))


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each size, larger sizes first, each into the bin with the least room that holds it.

    The open bins of each amount of room form a stack; the bits of ``rooms``
    tell which amounts occur, so the least fitting one is its lowest bit.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed, rooms, bins = [(0, 0)] * len(sizes), 0, 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            own = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, own, bins = capacity, bins, bins + 1
        placed[i] = own, capacity - room
        stacks[room - size].append(own)
        rooms |= 1 << room - size
    return placed


def _pack_group(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("unit", ignore_index=True)
        placed = best_fit(group["size"].tolist(), capacity)
        group["own"] = [b for b, _ in placed]
        group["at"] = np.array([a for _, a in placed], np.int64)
        by = group.groupby("own")
        group["bin"], group["fill"] = by["unit"].transform("min"), by["size"].transform("sum")
        return group[["unit", "bin", "at", "fill"]]
    return run


def best_fit_counted(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``best_fit`` over how many units there are of each size: ``(size, rank, n, bin, offset)``.

    The units ``rank .. rank + n - 1`` of a size go into the bins ``bin .. bin + n - 1``,
    each at ``offset``.  Bins with equal room are held as runs of numbers, so
    the work depends on the sizes and rooms that occur (``capacity`` at most), not on how
    many units there are.
    """
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    steps, rooms, bins = [], 0, 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            fit = rooms >> size
            if fit:
                room = size + (fit & -fit).bit_length() - 1
                first, n = runs[room].pop()
                if n > left:
                    runs[room].append((first + left, n - left))
                    n = left
                if not runs[room]:
                    rooms ^= 1 << room
            else:  # what fits beside each other goes into as many new bins as it needs; a last, less filled one comes after them
                room, first, n = capacity, bins, max(1, left // (capacity // size))
                bins += n
            steps.append((size, rank, n, first, capacity - room))
            runs[room - size].append((first, n))
            rooms |= 1 << room - size
            rank, left = rank + n, left - n
    return steps


def _pack_root(units: DataFrame, left: int, capacity: int) -> DataFrame:
    """Best fit over all ``units(unit, size)`` at once: ``unit, bin, at``, bins counted down from -1.

    The driver sees how many units have each size (``capacity`` rows at most).  Units
    are ranked in parts, and part counts give the offsets, so one size may have them all.
    """
    dealt = units.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(-(-left // GROUP))))
    sizes = written(dealt.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")), "sizes")
    steps = best_fit_counted({r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.sum("n").alias("n")).collect()}, capacity)
    plan = (units.sparkSession.createDataFrame(steps, "size long, rank long, n long, bin long, at long")
            .groupBy("size").agg(F.sort_array(F.collect_list(F.struct("rank", "n", "bin", "at"))).alias("steps")))
    order = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("size", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    turn = Window.partitionBy("part", "size").orderBy("unit")
    ranked = dealt.withColumn("turn", F.row_number().over(turn) - 1).join(offsets, ["part", "size"]).withColumn("own", F.col("before") + F.col("turn"))
    step = F.filter("steps", lambda s: (s["rank"] <= F.col("own")) & (F.col("own") < s["rank"] + s["n"]))[0]
    return (ranked.join(F.broadcast(plan), "size").withColumn("step", step)
            .select("unit", (-1 - (F.col("step.bin") + F.col("own") - F.col("step.rank"))).alias("bin"), F.col("step.at").alias("at")))


def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Put items into bins of ``capacity``; adds ``sequence_id`` and ``offset`` (gapless from 0 in each bin).

    Each round deals the units to groups by hash and packs every group best fit,
    largest first.  Bins with at most ``SLACK`` room are done; the others are the
    units of the next round, whose groups are fewer, as a tree that merges.  Once
    one group would be left, or a round saves under ``SAVED`` of the bins, the root packs
    all units that are left best fit at once, by how many there are of each size; so
    the merge always ends at one root, whatever their number.  A group's bin is named
    by its smallest unit, so groups need no counter in common, and the root's by
    negative numbers; groups are sorted before packing, and every round is a table in the
    shared folder, so a repeated task gives the same bins.

    Lengths must be from 1 to ``capacity``; others raise.  Repeated items are
    items of their own.  Columns named ``sequence_id`` or ``offset`` are replaced.
    """
    number, = fresh(items, "item_number_")
    items = items.drop("sequence_id", "offset")
    rows = written(items.withColumn(number, F.monotonically_increasing_id()), "items")
    size = F.col(length).cast("long")
    low, high = rows.agg(F.min(size), F.max(size)).first()
    if low is not None and not 1 <= low <= high <= capacity:
        raise ValueError(f"lengths from {low} to {high} don't fit into bins of {capacity}")
    open_units = rows.filter(size < capacity).select(F.col(number).alias("unit"), size.alias("size"))
    left, before, rounds = open_units.count(), None, []
    while left > GROUP and (before is None or left <= (1 - SAVED) * before):
        dealt = open_units.withColumn("part", F.pmod(F.xxhash64("unit", F.lit(len(rounds))), F.lit(-(-left // GROUP))))
        done = written(dealt.groupBy("part").applyInPandas(_pack_group(capacity), "unit long, bin long, at long, fill long"), "bins")
        rounds.append(done)
        open_units = done.filter((F.col("unit") == F.col("bin")) & (F.col("fill") < capacity - SLACK)).select("unit", F.col("fill").alias("size"))
        before, left = left, open_units.count()
    if left:
        rounds.append(written(_pack_root(open_units, left, capacity), "bins"))
    out = rows.withColumn("sequence_id", F.col(number)).withColumn("offset", F.lit(0).cast("long"))
    for done in rounds:
        out = (out.join(done.select(F.col("unit").alias("sequence_id"), "bin", "at"), "sequence_id", "left")
               .withColumn("offset", F.col("offset") + F.coalesce("at", F.lit(0)))
               .withColumn("sequence_id", F.coalesce("bin", "sequence_id")).drop("bin", "at"))
    return out.select(*items.columns, "sequence_id", "offset")


def pack_in_order(items: DataFrame, place: str, capacity: int = CAPACITY, span: int = SPAN) -> DataFrame:
    """Put ``items(place, piece, length)`` into bins that follow the order of ``place``; adds ``sequence_id`` and ``offset``.

    Only items of the same ``span`` places share a bin, best fit, largest first.
    A bin's id is that of its smallest (place, piece), which must differ for all
    items, so ascending ids go through the spans in order and, inside one, by
    the smallest place: any prefix of them holds all documents of the spans
    before and, of one span only, a part.  Other lengths than 1 to ``capacity``
    raise.
    """
    rows = written(items.drop("sequence_id", "offset").withColumn("sequence_id", F.col(place) * PIECES + F.col("piece")), "items")
    low, high, most = rows.agg(F.min("length"), F.max("length"), F.max("piece")).first()
    if low is not None and not (1 <= low <= high <= capacity and most < PIECES):
        raise ValueError(f"lengths from {low} to {high}, up to {most + 1} pieces, don't fit into bins of {capacity}")
    units = (rows.filter(F.col("length") < capacity)
             .select(F.col("sequence_id").alias("unit"), F.col("length").alias("size"), F.expr(f"`{place}` DIV {span}").alias("part")))
    done = units.groupBy("part").applyInPandas(_pack_group(capacity), "unit long, bin long, at long, fill long")
    return (rows.join(done.select(F.col("unit").alias("sequence_id"), "bin", "at"), "sequence_id", "left")
            .select(*items.columns, F.coalesce("bin", "sequence_id").alias("sequence_id"), F.coalesce("at", F.lit(0)).cast("long").alias("offset")))


def packed_documents(docs: DataFrame, place: str | None = None) -> DataFrame:
    """Pieces of all documents with a checksum of their ids, and their places; in the order of the column ``place``, if given."""
    pieces = token_pieces(docs, place=place).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack_in_order(pieces, place) if place else pack(pieces)


def op8_best_fit_packing(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents"))
