"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import table, written

#: Candidates and queries that meet in one task.
CANDIDATES, QUERIES, BATCH = 4096, 8192, 128
SCALE = 1024


def _quantised(rows: DataFrame) -> DataFrame:
    """Integer vectors; those that are null or hold null or non-finite components take no part."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
            .filter(F.coalesce(ok, F.lit(False)))
            .select("vec_id", F.transform("embedding", lambda x: F.floor(x * SCALE).cast("long")).alias("v")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _accumulate(k: int):
    """Each query's best candidates of a block.

    A term is a dimension; its postings are the candidates where it is not 0.
    For each term, the queries that have it scatter their weight times the
    postings into their dense score rows; a selection then takes the best.
    """
    def run(queries: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if queries.empty or cands.empty:
            return pd.DataFrame({n: np.empty(0, np.int64) for n in names})
        cands = cands.sort_values("vec_id", ignore_index=True)
        width = max(cands.v.map(len).max(), queries.v.map(len).max())
        postings = []
        for column in _matrix(cands.v, width).T:
            at = np.flatnonzero(column)
            postings.append((slice(None) if len(at) == len(column) else at, column[at]))
        ids, out = cands.vec_id.to_numpy(), []
        for a in range(0, len(queries), BATCH):
            part = queries.iloc[a:a + BATCH]
            weights = _matrix(part.v, width)
            scores = np.zeros((len(part), len(ids)), np.int64)
            for term, (at, values) in enumerate(postings):
                for q in np.flatnonzero(weights[:, term]):
                    scores[q, at] += weights[q, term] * values
            for q, (query, number) in enumerate(zip(part.vec_id, part.number)):
                own = np.flatnonzero(cands.number.to_numpy() != number)
                row = scores[q, own]
                if len(row) > k:
                    floor = np.partition(row, len(row) - k)[len(row) - k]
                    above, ties = np.flatnonzero(row > floor), np.flatnonzero(row == floor)
                    pick = np.concatenate([above, ties[:k - len(above)]])  # ties in order of vec_id
                else:
                    pick = np.arange(len(row))
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[own[pick]], "score": row[pick]}))
        return pd.concat(out)
    return run


def top_k(rows: DataFrame, is_query, k: int = 10) -> DataFrame:
    """``rows(vec_id, embedding)`` -> ``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query.

    Queries are the rows where ``is_query`` holds; candidates are all rows but
    the query's own.  Candidates are dealt to blocks by hash, queries to groups;
    each block meets each group once, so a task holds a bounded part of either,
    and gives ``k`` rows a query, merged by rank.  Both counts follow the input.

    Ties go to the smaller ``vec_id``.  Vectors that are null or hold null or
    non-finite components are neither; shorter vectors count as filled with 0.
    Repeated rows are rows of their own: a copy of the query's row is a
    candidate, and a repeated query is answered once.  Empty input gives no rows.
    """
    vectors = written(_quantised(rows).withColumn("number", F.monotonically_increasing_id()), "vectors")
    asked = vectors.filter(is_query)
    first = Window.partitionBy("vec_id").orderBy("number")
    asked = asked.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    blocks, groups = -(-max(1, vectors.count()) // CANDIDATES), -(-max(1, asked.count()) // QUERIES)
    q = (asked.withColumn("g", F.pmod(F.xxhash64("number"), F.lit(groups)))
         .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    c = (vectors.withColumn("b", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int"))
         .withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))))
    best = (q.groupBy("b", "g").cogroup(c.groupBy("b", "g"))
            .applyInPandas(_accumulate(k), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))


def op5_topk_search(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
