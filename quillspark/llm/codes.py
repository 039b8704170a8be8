"""Vector codes by product quantisation over per-dimension value dictionaries, in whole numbers."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_arrow_batches, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of a block of vectors, and its most rows (codes of two bytes).
BLOCK, ROWS = 1 << 20, 1 << 16
_LONG = (1 << 63) - 1


def _usable(rows: DataFrame, scale: int) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * scale) < float("inf")))
    return (rows.select(F.col("vec_id").cast("long"), "label", x.alias("x"))
            .filter(F.col("x").isNotNull() & F.coalesce(finite, F.lit(False))))


def _encoded(width: int, scale: int):
    """Blocks of rows: for each dimension the distinct whole numbers in it, and each vector's codes into them."""
    most = max(1, min(ROWS, BLOCK // width))

    def block(batch: pa.Table) -> pa.RecordBatch:
        x = batch.column("x").combine_chunks()
        sizes, flat = np.diff(x.offsets.to_numpy()), x.flatten().to_numpy(zero_copy_only=False)
        v = np.zeros((len(sizes), width))
        v[np.arange(width) < sizes[:, None]] = np.floor(flat * scale)
        values, codes = [], np.empty(v.shape, np.uint16)
        for d in range(width):
            distinct, code = np.unique(v[:, d], return_inverse=True)
            values.append(distinct)
            codes[:, d] = code

        def one(column):
            column = batch.column(column).combine_chunks()
            return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        return pa.RecordBatch.from_arrays([one("vec_id"), one("label"), pa.array([values], pa.list_(pa.list_(pa.float64()))),
                                           pa.array([codes.tobytes()], pa.binary())], ["vec_id", "label", "dictionary", "codes"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, most - rows), batch.slice(most - rows)
                held.append(part)
                rows += part.num_rows
                if rows == most:
                    yield block(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield block(pa.Table.from_batches(held))
    return run


def _whole(values, exact) -> np.ndarray:
    """Whole numbers held as doubles, as int64 or, where squares would pass 64 bits, as Python's."""
    return np.array([int(v) for v in values], object) if exact == object else np.asarray(values, np.float64).astype(np.int64)


def _nearest(values: list, codes: np.ndarray, book: np.ndarray):
    """Nearest entry of each part vector and its squared distance: a table of squared differences for each dimension, gathered and added."""
    total = np.zeros((len(codes), len(book)), book.dtype)
    for d, own in enumerate(values):
        total += ((own[:, None] - book[None, :, d]) ** 2)[codes[:, d]]
    best = np.argmin(total, 1) if book.dtype != object else np.array([min(range(len(book)), key=row.__getitem__) for row in total], np.int64)
    return best, total[np.arange(len(codes)), best]


def _blocks(batches, width: int, exact):
    for batch in batches:
        for i in range(batch.num_rows):
            codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint16).reshape(-1, width)
            dictionary = batch.column("dictionary")[i].values
            yield batch, i, [_whole(dictionary[d].as_py(), exact) for d in range(width)], codes


def _limbs(total: int):
    """A whole number of any size as digits to base 2**32, the last with its sign."""
    k = 0
    while not -(1 << 31) <= total < 1 << 31:
        yield k, total & 0xFFFFFFFF
        total >>= 32
        k += 1
    yield k, total


def _sums(books: np.ndarray, width: int):
    """Sums and counts of the vectors that go to each entry, over a task's blocks: ``(place, limb, total)``."""
    parts, entries, size = books.shape

    def run(batches):
        sums = np.zeros((parts, entries, size + 1), object)
        for _, _, values, codes in _blocks(batches, width, books.dtype):
            for p in range(parts):
                own, mine = values[p * size:(p + 1) * size], codes[:, p * size:(p + 1) * size]
                best, _ = _nearest(own, mine, books[p])
                sums[p, :, size] += np.bincount(best, minlength=entries)
                for d, distinct in enumerate(own):
                    often = np.bincount(best * len(distinct) + mine[:, d], minlength=entries * len(distinct))
                    sums[p, :, d] += often.reshape(entries, -1).astype(books.dtype) @ distinct
        rows = [(place, k, digit) for place, total in enumerate(sums.ravel()) for k, digit in _limbs(int(total)) if digit]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["place", "limb", "total"]).astype("int64"), preserve_index=False)
    return run


def _coded(books: np.ndarray, width: int):
    parts, _, size = books.shape

    def run(batches):
        for batch, i, values, codes in _blocks(batches, width, books.dtype):
            found = [_nearest(values[p * size:(p + 1) * size], codes[:, p * size:(p + 1) * size], books[p]) for p in range(parts)]
            error = sum(e.astype(object) for _, e in found)
            code = pa.array(list(np.stack([b for b, _ in found], 1).astype(np.int32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id")[i].values, batch.column("label")[i].values, code, pa.array([min(int(e), _LONG) for e in error], pa.int64())],
                ["vec_id", "label", "code", "error"])
    return run


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list]:
    """``rows(vec_id, embedding, label)`` -> ``(vec_id, label, code, error)`` and the codebooks, ``[part][entry][position]``.

    Components become ``floor(scale * x)``.  Each part's codebook starts as that part of
    the vectors of the smallest ``vec_id``; a round assigns every part vector to its nearest entry
    (ties to the lower) and replaces entries by the floors of their vectors' means.

    Vectors are written once, in blocks that hold each dimension's distinct
    numbers and the vectors' codes into them; a part's distances are then sums of
    gathered rows of a small table.  A round gives the driver one sum for each
    component of each entry (its size is the codebooks'), never rows.  Sums are
    whole numbers of any size, so results don't depend on the order of tasks.

    Vectors that are null or hold null or non-finite components (or ones whose
    product with ``scale`` is) have no row.  Shorter vectors, and a width that
    ``parts`` doesn't divide, are filled with 0.  Fewer vectors than ``entries`` make
    smaller codebooks; a null ``vec_id`` comes after all others; repeated rows each
    count and get their row; ties of ``vec_id`` go by the vector.  An error above a long's
    range is given as the largest long.  Empty input gives no rows.
    """
    spark = rows.sparkSession
    small_arrow_batches(spark)
    kept = _usable(rows, scale)
    size, bound = kept.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda e: F.abs(e))))).first()
    kind = dict(kept.dtypes)["label"]
    out = f"vec_id long, label {kind}, code array<int>, error long"
    if size is None:
        return spark.createDataFrame([], out), []
    step = max(1, -(-size // parts))
    width = step * parts
    exact = np.dtype(np.int64) if (2 * (bound or 0) * scale + 2) ** 2 * width < 2.0 ** 62 else np.dtype(object)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    books = np.array([[[math.floor(x * scale) for x in r.x] + [0] * (width - len(r.x))] for r in first], exact).reshape(len(first), parts, step)
    books = np.ascontiguousarray(books.transpose(1, 0, 2))
    blocks = written(kept.mapInArrow(_encoded(width, scale), f"vec_id array<long>, label array<{kind}>, dictionary array<array<double>>, codes binary"), "vectors")
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(books, width), "place long, limb long, total long").groupBy("place", "limb").agg(F.sum("total").alias("total"))
        total: dict = defaultdict(int)
        for r in sums.collect():
            total[r.place] += r.total << 32 * r.limb
        for p in range(parts):
            for e in range(len(first)):
                at = (p * len(first) + e) * (step + 1)
                if total[at + step]:
                    books[p, e] = [total[at + d] // total[at + step] for d in range(step)]
    return blocks.mapInArrow(_coded(books, width), out), books.tolist()


def op11_vector_codes(spark, sf_dir):
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = written(coded, "codes")
    sha = hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
    error = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy("label").agg(error.alias("label_error"))
    return (coded.join(by_label.withColumnRenamed("label", "own"), F.col("label").eqNullSafe(F.col("own")))
            .select("vec_id", F.concat_ws("", F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))).alias("code"),
                    "error", "label_error", F.lit(sha).alias("codebooks_sha256"), "label"))
