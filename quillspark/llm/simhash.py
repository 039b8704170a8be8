"""SimHash near-duplicates by per-segment bit counts."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import fresh, identified, small_arrow_batches, table, written
from .components import connected_components

#: Seed of the shingle hash.
SEED = 42
#: Two bits a segment; segments dealt to so many groups for the grid.
GROUPS = 6
#: Fingerprints of one grid cell that are compared by a join; larger cells are compared in blocks.
CELL, BLOCK = 64, 1024
HASHES = 1 << 16
_LOW = 0x5555555555555555


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    hash64, total, ones = xxhash.xxh64_intdigest, len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, total, HASHES):
        part = words[at:min(at + HASHES, total) + width - 1]
        hashes = np.array([hash64(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(width)))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def _fingerprints(width: int):
    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")
    return udf


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _embedding(fp):
    """Bit counts of the 32 two-bit segments, each written as 0, 1 or 2 set bits.

    Written so, the Manhattan distance of two embeddings is the number of bits
    in which they differ, and never above the fingerprints' own bit distance.
    """
    moved, low = F.shiftrightunsigned(fp, 1), F.lit(_LOW)
    return fp.bitwiseOR(moved).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(moved).bitwiseAND(low), 1))


def _cells(max_bits: int) -> list[int]:
    """Masks of the segment groups that a cell of the grid fixes: all but ``max_bits`` of the groups.

    Each unit of Manhattan distance changes the counts of one group only, so
    two embeddings within ``max_bits`` share a cell for one choice at least.
    """
    groups = max(GROUPS, max_bits + 1)
    masks = [sum(3 << 2 * s for s in range(g, 32, groups)) for g in range(groups)]
    return [sum(c) for c in combinations(masks, groups - max_bits)]


def _forest(max_bits: int):
    """Links that join what a block holds as its close pairs do: a spanning forest in place of all pairs."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(block.fp.to_numpy(np.int64)).view(np.uint64)
        low = np.uint64(_LOW)
        one = np.uint64(1)
        emb = ((fp | fp >> one) & low) | ((fp & fp >> one & low) << one)
        left, a, b = np.arange(len(fp)), [], []
        while len(left):
            stack, left = [left[0]], left[1:]
            while stack and len(left):
                u = stack.pop()
                near = np.bitwise_count(emb[left] ^ emb[u]) <= max_bits
                near[near] = np.bitwise_count(fp[left[near]] ^ fp[u]) <= max_bits
                a += [fp[u]] * int(near.sum())
                b += list(fp[left[near]])
                stack += list(left[near])
                left = left[~near]
        return pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})
    return run


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Distinct ``prints(fp)`` -> ``(a, b)``: links whose components are those of all pairs within ``max_bits``."""
    masks = _cells(max_bits)
    emb = prints.select("fp", _embedding(F.col("fp")).alias("emb"))
    grid = (emb.select("fp", "emb", F.posexplode(F.array(*[F.col("emb").bitwiseAND(F.lit(_signed(m))) for m in masks]))
                       .alias("choice", "cell"))
            .repartition("choice", "cell"))
    sizes = grid.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(grid.join(sizes, ["choice", "cell"]), "cells")
    few = shared.filter(F.col("n") <= CELL)
    x, y = few.alias("x"), few.alias("y")
    close = (F.bit_count(F.col("x.emb").bitwiseXOR(F.col("y.emb"))) <= max_bits)
    exact = (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits)
    pairs = (x.join(y, (F.col("x.choice") == F.col("y.choice")) & (F.col("x.cell") == F.col("y.cell"))
                    & (F.col("x.fp") < F.col("y.fp")) & close & exact)
             .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    many = (shared.filter(F.col("n") > CELL).withColumn("own", own)
            .select("choice", "cell", "fp", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            .select("choice", "cell", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    return pairs.union(many.groupBy("choice", "cell", "i", "j").applyInPandas(_forest(max_bits), "a long, b long"))


def _classes(prints: DataFrame, max_bits: int) -> DataFrame:
    """``prints(fp, doc_id)`` -> ``(fp, component_id)`` with the smallest ``doc_id`` of the fingerprint's component."""
    first = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    root = connected_components(links(first.select("fp"), max_bits))
    held = first.join(root, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    low = held.groupBy("root").agg(F.min("low").alias("component_id"))
    return held.join(low, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, fingerprint, component_id``, a row for each input row.

    Equal fingerprints are one point, so copies cost nothing.  A point's
    embedding holds the bit counts of its segments; a grid join finds the points
    within ``max_bits`` of each other in Manhattan distance, a lower bound of the
    bit distance, which is checked last.  Crowded cells are cut into blocks, and
    each pair of blocks gives a spanning forest, not its pairs.

    Null text is empty; texts without words have fingerprint 0 and link with
    each other and with what is near 0.  Null ``doc_id`` is kept, and counts for
    a component only if it has no other.  Repeated rows each get their row.
    """
    small_arrow_batches(docs.sparkSession)
    prints = written(docs.select(F.col("doc_id").cast("long"), _fingerprints(width)("text").alias("fp")), "simhash")
    found = prints.join(_classes(prints, max_bits), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """Keep one row of each component, the one with the smallest ``doc_id``, with all its columns.

    Rows are known by their file and their place in it, which no split of the
    scan changes (see ``identified``).  Of repeated rows one stays.
    """
    small_arrow_batches(docs.sparkSession)
    file, place = fresh(docs, "file_", "place_")
    rows = identified(docs, file, place)
    prints = written(rows.select(F.col(file).alias("file"), F.col(place).alias("place"), F.col("doc_id").cast("long"),
                                 _fingerprints(width)("text").alias("fp")), "simhash")
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "file", "place")).alias("first"))
    root = connected_components(links(first.select("fp"), max_bits))
    kept = (first.join(root, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp"))
            .agg(F.min("first").alias("first")).select(F.col("first.file").alias(file), F.col("first.place").alias(place)))
    # the same plan at every size: neither side is bounded
    return rows.join(written(kept, "kept").hint("merge"), [file, place], "left_semi").select(*docs.columns)


def op2_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))
