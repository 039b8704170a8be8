"""Token counts from distinct pre-tokens."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import small_arrow_batches, table, written
from .tokens import counter, default_tokenizer

#: The most frequent pre-tokens sent to every task: at most so many of at most so many bytes each (32 MiB in all).
FREQUENT, FREQUENT_BYTES = 131_072, 256
#: Steps of frequency between a number and its double, to find how frequent those are.
STEPS = 32
HELD = 100_000


def _frequencies(path: str):
    """Pre-token frequencies of a task's documents, summed in a bounded table before they leave it."""
    def run(batches):
        split = counter(path).split
        held: Counter = Counter()
        for (texts,) in ((b.column(0).to_pylist(),) for b in batches):
            for text in texts:
                if text:
                    held.update(split(text))
                    if len(held) >= HELD:
                        yield _pairs(held)
                        held = Counter()
        yield _pairs(held)
    return run


def _pairs(held: Counter):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                      names=["pre", "freq"])


def _pieces(path: str):
    def run(frames):
        counts = counter(path).counts
        for f in frames:
            yield pd.DataFrame({"pre": f.pre, "freq": f.freq, "pieces": pd.Series(counts(f.pre.tolist()), dtype="int64")})
    return run


def vocabulary(texts: DataFrame, path: str) -> DataFrame:
    """``texts(text)`` -> ``(pre, freq, pieces)``: each distinct pre-token, how often it stands, and its pieces, counted once."""
    found = (texts.mapInArrow(_frequencies(path), "pre string, freq long")
             .groupBy("pre").agg(F.sum("freq").alias("freq")))
    return written(found.mapInPandas(_pieces(path), "pre string, freq long, pieces long"), "vocabulary")


def most_frequent(vocab: DataFrame, most: int = FREQUENT) -> DataFrame:
    """Those of ``vocab`` above a frequency that at most ``most`` of them have; found from counts by step of frequency."""
    short = vocab.filter(F.octet_length("pre") <= FREQUENT_BYTES).withColumn("step", F.floor(F.log2("freq") * STEPS))
    least, total = None, 0
    for step, n in short.groupBy("step").agg(F.count(F.lit(1))).orderBy(F.desc("step")).collect():  # 64 * STEPS rows at most
        total += n
        if total > most:
            break
        least = step
    return short.filter(F.lit(False) if least is None else F.col("step") >= least).select("pre", "pieces")


def _documents(path: str, frequent):
    """A row ``d<n>`` for each document with the pieces of its frequent pre-tokens, and rows ``p<pre>`` with the frequencies of its others."""
    def run(frames):
        import pyarrow as pa

        split, known = counter(path).split, frequent.value
        for batch in frames:
            number, doc, key, n_bytes, amount = [], [], [], [], []
            for n, d, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total = 0
                for pre, freq in Counter(split(text) if text else ()).items():
                    pieces = known.get(pre)
                    if pieces is None:
                        number.append(n), doc.append(None), key.append("p" + pre), n_bytes.append(None), amount.append(freq)
                    else:
                        total += freq * pieces
                number.append(n), doc.append(d), key.append(f"d{n}"), amount.append(total)
                n_bytes.append(len(text.encode()) if text else 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int64()), pa.array(doc, pa.int64()), pa.array(key, pa.string()),
                 pa.array(n_bytes, pa.int64()), pa.array(amount, pa.int64())],
                names=["number", "doc_id", "key", "n_bytes", "amount"])
    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """Tokens of every whole text, without making a document's ids.

    ``docs(doc_id, text)`` -> ``doc_id, n_bytes, n_tokens, over_limit``, a row
    for each input row.  Pieces are counted once for each distinct pre-token of
    all texts; documents give pre-token frequencies, which meet those counts in
    a join and are summed.  The most frequent pre-tokens (``FREQUENT`` at most, a
    table of bounded bytes) meet the documents inside the tasks; all others by a
    shuffle join on the pre-token, so the vocabulary may grow without bound.
    Frequencies are summed within a document before the shuffle.

    Null and empty texts have 0 bytes and 0 tokens; a null ``doc_id`` stays;
    repeated rows give repeated results; other columns are ignored; an empty
    table gives an empty result.  A text with a special string of the vocabulary
    is one pre-token, and so handled as the library does.
    """
    path = path or default_tokenizer()
    spark = docs.sparkSession
    small_arrow_batches(spark)
    vocab = vocabulary(docs.select("text"), path)
    frequent = spark.sparkContext.broadcast({r.pre: r.pieces for r in most_frequent(vocab).collect()})
    parts = (docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("long"), "text")
             .mapInArrow(_documents(path, frequent), "number long, doc_id long, key string, n_bytes long, amount long"))
    joined = parts.join(vocab.select(F.concat(F.lit("p"), "pre").alias("key"), "pieces"), "key", "left")
    tokens = F.col("amount") * F.coalesce("pieces", F.lit(1))
    return (joined.groupBy("number")
            .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def op1_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
