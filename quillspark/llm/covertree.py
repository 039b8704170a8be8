"""Embedding near-duplicates by dual traversal of cover trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import small_arrow_batches, table, written
from .components import connected_components

#: Vectors of a block (each has a tree of its own); most pivots that deal vectors to blocks, sent to every task.
BLOCK, PIVOTS = 1024, 2048
#: Radii of the levels below a block's root, halved from level to level.
RADII = (1.0, 0.5, 0.25)
_SLOP = 1e-7


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def _clean(rows: DataFrame) -> DataFrame:
    x = F.col("embedding")
    ok = (x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
          & F.exists(x, lambda e: e != 0) & F.col("label").isNotNull())
    return rows.select("number", "vec_id", F.struct(F.col("label").cast("string").alias("label"), F.size(x).alias("dim")).alias("label"),
                       x.cast("array<double>").alias("x")).filter(F.coalesce(ok, F.lit(False)))


def _cell_of(pivots):
    """The nearest pivot of the vector's label; -1 without one."""
    @F.pandas_udf("int")
    def udf(label: pd.DataFrame, x: pd.Series) -> pd.Series:
        out = np.full(len(x), -1)
        for (name, dim), at in label.groupby(["label", "dim"]).indices.items():
            own = pivots.value.get((name, dim))
            if own is not None:
                out[at] = own[0][_distance(_unit(x.iloc[at]), own[1]).argmin(1)]
        return pd.Series(out, dtype="int32")
    return udf


def cover_levels(x: np.ndarray) -> list[np.ndarray]:
    """For each radius, the centre (row number) that covers each row: nets nested level in level, centres kept below."""
    near, parent, levels = _distance(x, x), np.zeros(len(x), int), []
    for r in RADII:
        centre = np.full(len(x), -1)
        for i in sorted(range(len(x)), key=lambda i: (parent[i] != i, i)):  # a centre stays one on the next level
            if centre[i] < 0:
                centre[(near[i] <= r) & (centre < 0) & (parent == parent[i])] = i
        levels.append(centre)
        parent = centre
    return levels


def _trees(block: pd.DataFrame) -> pd.DataFrame:
    """A block's cover tree: for each vector its centre on each level; and how far the block reaches from its first vector."""
    block = block.sort_values("number", ignore_index=True)
    x = _unit(block.x)
    for k, level in enumerate(cover_levels(x)):
        block[f"c{k}"] = level.astype(np.int32)
    block["at"] = np.arange(len(block), dtype=np.int32)
    block["x"] = list(x)
    block["reach"] = float(_distance(x, x[:1]).max())
    return block


def _pairs(x, a: list[np.ndarray], y, b: list[np.ndarray], reach: float):
    """Dual traversal: node pairs of one level go on to their children if their covering radii let them be near."""
    todo = [(np.arange(len(x)), np.arange(len(y)))]
    for la, lb in zip(a, b):
        found = []
        for i, j in todo:
            ci, ni = np.unique(la[i], return_inverse=True)
            cj, nj = np.unique(lb[j], return_inverse=True)
            ri, rj = np.zeros(len(ci)), np.zeros(len(cj))
            np.maximum.at(ri, ni, np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x[i], x[la[i]]))))
            np.maximum.at(rj, nj, np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", y[j], y[lb[j]]))))
            close = _distance(x[ci], y[cj]) <= ri[:, None] + rj[None, :] + reach + _SLOP
            for p, q in zip(*np.nonzero(close)):
                found.append((i[ni == p], j[nj == q]) if len(i) > len(ci) or len(j) > len(cj) else (i[p:p + 1], j[q:q + 1]))
        todo = found
    return todo


class _Sets:
    """Disjoint sets of vector numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, a: int) -> int:
        while (b := self.up.setdefault(a, a)) != a:
            self.up[a] = a = self.up[b]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def _links(threshold: float):
    """Links of two blocks (or within one): how many each vector has, and its set's smallest number."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        i, j = key[1], key[2]
        group = group.sort_values(["block", "at"], ignore_index=True)
        left, right = group[group.block == i], group[group.block == j]
        out = {"number": [], "links": [], "top": []}
        if len(left) and len(right):
            x, y = np.array(list(left.x)), np.array(list(right.x))
            levels = lambda f: [f[f"c{k}"].to_numpy() for k in range(len(RADII))]
            a, b, same = left.number.to_numpy(), right.number.to_numpy(), i == j
            na, nb, sets = np.zeros(len(a), int), np.zeros(len(b), int), _Sets()
            for p, q in _pairs(x, levels(left), y, levels(right), reach):
                near = x[p] @ y[q].T >= threshold
                if same:
                    near &= p[:, None] != q[None, :]
                na[p] += near.sum(1)
                nb[q] += near.sum(0)
                rest = np.arange(len(p))
                while len(rest):  # a spanning forest of the links, a row of the matrix for each set met
                    row = near[rest[0]]
                    grown = True
                    while grown:
                        more = near[rest][:, row].any(1)
                        more[0] = True
                        wider = row | near[rest[more]].any(0)
                        grown, row = bool((wider != row).any()), wider
                    for m in (a[p[rest[more]]], b[q[row]]):
                        if row.any():
                            for v in m:
                                sets.join(int(v), int(a[p[rest[0]]]))
                    rest = rest[~more]
            for numbers, counts in ((a, na),) if same else ((a, na), (b, nb)):
                hit = counts > 0
                out["number"] += numbers[hit].tolist()
                out["links"] += counts[hit].tolist()
            out["top"] = [sets.top(v) for v in out["number"]]
        return pd.DataFrame(out).astype("int64")
    return run


def _pivots(good: DataFrame, total: int):
    """A bounded sample, one vector in ``BLOCK`` and ``PIVOTS`` at most, by label."""
    most = min(PIVOTS, total // BLOCK)
    share = min(1.0, 20 * most / max(1, total))  # what is sorted is about 20 times the sample, however large the table
    some = good.withColumn("h", F.xxhash64("number")).filter(F.col("h") / float(1 << 64) + 0.5 <= share)
    rows = some.orderBy("h", "number").limit(most).select("label", "x").collect()
    by: dict = {}
    for n, r in enumerate(rows):
        by.setdefault((r.label.label, r.label.dim), []).append((n, r.x))
    return {k: (np.array([n for n, _ in v]), _unit([x for _, x in v])) for k, v in by.items()}


def near_embeddings(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``rows(vec_id, embedding, label)`` -> ``vec_id, n_links, component_id, kept``, a row for each input row.

    Vectors of one label are compared by cosine in double precision.  On unit
    vectors, cosine ``threshold`` is a distance; vectors near one pivot form
    blocks of bounded size, each with a cover tree (radii 1, 1/2, 1/4 below its
    root).  Two blocks whose reaches keep them apart never meet; others are
    traversed together, and a pair of nodes is pruned when the distance of its
    centres is above both covering radii and the threshold's distance.  What is
    left is compared exactly.  Tasks return each vector's number of links and its
    set, never the pairs.

    Null labels, and vectors that are null, empty, zero or hold null or
    non-finite components, have no links; vectors of different lengths never
    link.  Repeated rows are vectors of their own that link with each other.
    """
    spark = rows.sparkSession
    small_arrow_batches(spark)
    every = written(rows.select(F.monotonically_increasing_id().alias("number"), F.col("vec_id").cast("long"),
                                F.col("embedding"), F.col("label")), "embeddings")
    good = _clean(every)
    pivots = spark.sparkContext.broadcast(_pivots(good, good.count()))
    cells = good.select("number", "label", "x", _cell_of(pivots)("label", "x").alias("cell"))
    sizes = cells.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = (cells.join(sizes, ["label", "cell"])
             .withColumn("part", F.pmod(F.xxhash64("number"), F.col("parts")).cast("int")))
    columns = ["number long", "label struct<label:string,dim:int>", "x array<double>", "cell int", "part int"]
    kinds = ", ".join([*columns, *[f"c{k} int" for k in range(len(RADII))], "at int", "reach double"])
    trees = written(dealt.select("number", "label", "x", "cell", "part").groupBy("label", "cell", "part").applyInPandas(_trees, kinds)
                    .withColumn("block", F.struct("cell", "part")), "trees")
    roots = trees.filter("at = 0").select("label", "block", "reach", "x")
    one, two = roots.alias("one"), roots.alias("two")
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with("one.x", "two.x", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)))
    wide = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLOP
    meet = (one.join(two, (F.col("one.label") == F.col("two.label")) & (F.col("one.block") <= F.col("two.block"))
                     & (apart <= F.col("one.reach") + F.col("two.reach") + wide))
            .select(F.col("one.label").alias("label"), F.col("one.block").alias("i"), F.col("two.block").alias("j")))
    ends = meet.select("label", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")
    name = lambda c: F.concat_ws(":", f"{c}.cell", f"{c}.part")
    found = written(
        trees.join(ends, ["label", "block"])
        .select("label", name("i").alias("i"), name("j").alias("j"), name("block").alias("block"), "number", "x", "at", *[f"c{k}" for k in range(len(RADII))])
        .groupBy("label", "i", "j").applyInPandas(_links(threshold), "number long, links long, top long"), "links")
    root = connected_components(found.select(F.col("number").alias("a"), F.col("top").alias("b")))
    links = found.groupBy("number").agg(F.sum("links").alias("n"))
    held = (every.select("number", "vec_id").join(links, "number", "left").join(root.withColumnRenamed("node", "number"), "number", "left")
            .withColumn("root", F.coalesce("component", "number")))
    low = held.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return (held.join(low, "root")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id",
                    F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")))


def op6_embedding_dedup(spark, sf_dir):
    return near_embeddings(table(spark, sf_dir, "embeddings"))
