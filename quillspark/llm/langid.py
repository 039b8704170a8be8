"""Language identification by string kernels with landmarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_arrow_batches, table

#: Landmarks, and the labelled rows that they are looked for in: at most so many of each language, and so many in all.
PER_LANGUAGE, SAMPLE, LANDMARKS = 300, 4800, 96
#: Steps of likeness, from 0 to 1, that held-out rows are counted by.
STEPS = 10_000
#: Parts of a language that are ranked before the language is.
PARTS = 64
#: Hash buckets of the character n-grams of each length (1, 2, 3).
BUCKETS = (1 << 10, 1 << 13, 1 << 15)
RIDGE, JITTER = 1e-2, 1e-6
UNKNOWN = "und"
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_CHARS, _DOCS = 1 << 22, 128
_EDGES = np.cumsum((0, *BUCKETS))


def _grams(text: str, lengths: tuple = tuple(range(len(BUCKETS)))):
    """Places of the buckets of a text's n-grams, one array a length (from 0) and piece; lower case, white space as one blank, pieces overlap."""
    text = f" {' '.join(text.lower().split())} "
    for at in range(0, len(text), _CHARS):
        c = np.frombuffer(text[at:at + _CHARS + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        for k in lengths:
            size = BUCKETS[k]
            if len(c) > k:
                code = c[:len(c) - k] * _MIX[0]
                for i in range(1, k + 1):
                    code = (code ^ (code >> np.uint32(15))) * _MIX[i] + c[i:len(c) - k + i]
                code = (code ^ (code >> np.uint32(13))) * _MIX[1]
                yield _EDGES[k] + (code >> np.uint32(33 - size.bit_length()))


def presence(text: str) -> np.ndarray:
    """Which n-gram buckets of each length the whole text holds."""
    out = np.zeros(_EDGES[-1], bool)
    for at in _grams(text):
        out[at] = True
    return out


def _scaled(found: np.ndarray) -> np.ndarray:
    """Presence rows scaled so that inner products are the mean of the lengths' normalised kernels."""
    out = found.astype(np.float32)
    for a, b in zip(_EDGES, _EDGES[1:]):
        out[:, a:b] /= np.sqrt(np.maximum(1, out[:, a:b].sum(1, keepdims=True)) * len(BUCKETS))
    return out


class Model:
    """Kernel ridge regression, one language against the rest, in the space of the landmarks' kernels."""

    def __init__(self, landmarks: np.ndarray):
        marks = _scaled(landmarks)
        self.used = np.flatnonzero(marks.any(0))
        self.marks = np.ascontiguousarray(marks[:, self.used].T)
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
        self.root = vectors / np.sqrt(np.maximum(values, JITTER))  # Nyström map of the landmarks' kernel

    def sums(self, found: np.ndarray) -> list[np.ndarray]:
        """What rows of a language add to the regression: their number, features, products of features, and the 3-grams they hold."""
        z = np.hstack([self._kernel(found) @ self.root, np.ones((len(found), 1))])
        return [np.array([len(z)], float), z.sum(0), (z.T @ z).ravel(), found[:, _EDGES[-2]:].sum(0, dtype=float)]

    def learn(self, sums: dict[str, list[np.ndarray]]) -> Model:
        """Set the weights from the sums of all rows of each language."""
        self.languages = sorted(sums)
        own = [sums[a] for a in self.languages]
        size = len(own[0][1])
        # every language has the same weight, however many rows it has; at most PER_LANGUAGE each, as RIDGE was set for such numbers
        share = [min(1.0, PER_LANGUAGE / v[0][0]) for v in own]
        of = np.array([w * v[1] for w, v in zip(share, own)])
        weights = np.linalg.solve(sum(w * v[2] for w, v in zip(share, own)).reshape(size, size) + RIDGE * np.eye(size), (2 * of - of.sum(0)).T)
        self.weights, self.base = self.root @ weights[:-1], weights[-1]
        self.shares = np.array([v[3] / v[0] for v in own], np.float32)
        self.clean: dict[str, float] = {}
        return self

    def _kernel(self, found: np.ndarray) -> np.ndarray:
        scaled = found[:, self.used].astype(np.float32)
        edges = np.searchsorted(self.used, _EDGES)
        for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])):
            scaled[:, edges[k]:edges[k + 1]] /= np.sqrt(np.maximum(1, found[:, a:b].sum(1, keepdims=True)) * len(BUCKETS))
        return (scaled @ self.marks).astype(float)

    def scores(self, found: np.ndarray) -> np.ndarray:
        return self._kernel(found) @ self.weights + self.base

    def likeness(self, text: str, language: int) -> float:
        """Share of the language's learned texts that hold a 3-gram, as the mean over all 3-grams of ``text``, repeated ones too."""
        total = n = 0
        for at in _grams(text, (len(BUCKETS) - 1,)):
            total, n = total + float(self.shares[language][at - _EDGES[-2]].sum(dtype=float)), n + len(at)
        return total / n


def _has_letter(text) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _learned_from(held: bool = False):
    """Condition on labelled rows: those that are learned from, or those held out."""
    mine = F.crc32(F.col("doc_id").cast("string")) % 4
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & (mine == 2 if held else mine != 2)


def _labelled(docs: DataFrame) -> DataFrame:
    """Rows that landmarks are looked for in: the first of each language in an order by hash, in turns."""
    part = Window.partitionBy("lang", "part").orderBy("h", "doc_id")  # so that no task ranks more than a part's rows of each task
    turn = Window.partitionBy("lang").orderBy("h", "doc_id")
    return (docs.filter(_learned_from())
            .groupBy("doc_id", "lang").agg(F.xxhash64("doc_id").alias("h"))
            .withColumn("part", F.pmod("h", F.lit(PARTS))).withColumn("turn", F.row_number().over(part)).filter(F.col("turn") <= PER_LANGUAGE)
            .withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= PER_LANGUAGE)
            .orderBy("turn", "h", "doc_id", "lang").limit(SAMPLE).select("doc_id", "lang", "turn", "h"))


def _texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows of ``sample``, one each, with the smallest of their texts (copies meet by a minimum where they are)."""
    return (docs.select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"])
            .groupBy("doc_id", "lang", "turn", "h").agg(F.min("text").alias("text")))


def _all_texts(docs: DataFrame, held: bool = False) -> DataFrame:
    """All rows that are learned from, or all held out; one for each ``doc_id`` and ``lang``, with the smallest of their texts."""
    return docs.filter(_learned_from(held)).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def landmarks(docs: DataFrame) -> np.ndarray | None:
    """Presence rows of the landmarks: a bounded set of texts that all others are compared with; only their bits come to the driver."""
    @F.pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(presence(t)).tobytes() if _has_letter(t) else None for t in texts])

    rows = (_texts(docs, _labelled(docs))
            .select("turn", "h", "doc_id", "lang", bits("text").alias("bits")).filter("bits IS NOT NULL")
            .orderBy("turn", "h", "doc_id", "lang").limit(LANDMARKS).collect())
    if not rows:
        return None
    return np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8), count=_EDGES[-1]) for r in rows]).astype(bool)


def fit(docs: DataFrame) -> Model | None:
    """Learn from text and non-null ``lang`` of all rows whose crc32 of ``doc_id`` is not 2 modulo 4; None without such rows.

    Texts are compared with a bounded set of landmarks, but the regression and the shares of 3-grams are of all rows: each task adds up
    what its rows come to for each language, the tasks' sums are added by language, and one sum a language comes to the driver.
    Rows of one ``doc_id`` and ``lang`` count once, with their smallest text.
    """
    found = landmarks(docs)
    if found is None:
        return None
    model = Model(found)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def frame(sums: dict) -> pd.DataFrame:
        return pd.DataFrame({"lang": list(sums), "sums": [np.concatenate(v).tobytes() for v in sums.values()]})

    def add(to: dict, lang: str, more: list) -> None:
        if lang in to:
            for a, b in zip(to[lang], more):
                a += b
        else:
            to[lang] = more

    def rows(batches):
        sums: dict = {}
        for batch in batches:
            batch = batch[[_has_letter(t) for t in batch["text"]]]
            for lang, part in batch.groupby("lang", sort=False):
                for a in range(0, len(part), _DOCS):
                    add(sums, lang, held.value.sums(np.array([presence(t) for t in part["text"].iloc[a:a + _DOCS]])))
        if sums:
            yield frame(sums)

    def parts(packed: bytes) -> list:
        size = len(held.value.marks.T) + 1
        return [v.copy() for v in np.split(np.frombuffer(packed), np.cumsum([1, size, size * size]))]

    def merged(batches):
        sums: dict = {}
        for batch in batches:
            for lang, packed in zip(batch["lang"], batch["sums"]):
                add(sums, lang, parts(packed))
        if sums:
            yield frame(sums)

    kind = "lang string, sums binary"
    partial = _all_texts(docs).select("lang", "text").mapInPandas(rows, kind)
    # a language's sums meet in two steps, so that no task adds those of all others
    near = partial.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).repartition("lang", "part").select("lang", "sums").mapInPandas(merged, kind)
    total = near.repartition("lang").mapInPandas(merged, kind).collect()
    return model.learn({r["lang"]: parts(r["sums"]) for r in total})


def predictor(spark, model: Model | None, likeness: bool = False):
    """Column function ``text -> struct(lang_pred, score)``, with ``likeness`` to the winner if asked for; the score is the winner's, from -1..1 to 0..1."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double" + ", likeness double" * likeness)
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = held.value
        langs, scores, like = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if own and _has_letter(t)]
        for a in range(0, len(at), _DOCS):
            part = at[a:a + _DOCS]
            got = own.scores(np.array([presence(texts.iloc[i]) for i in part]))
            best = got.argmax(1)
            scores[part] = np.clip((got[np.arange(len(part)), best] + 1) / 2, 0, 1)
            for i, b in zip(part, best):
                langs[i] = own.languages[b]
                if likeness:
                    like[i] = own.likeness(texts.iloc[i], b)
        return pd.DataFrame({"lang_pred": langs, "score": scores} | ({"likeness": like} if likeness else {}))
    return predict


def identify(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` -> ``doc_id, held_out, lang_pred, score``, a row for each input row.

    Presence kernels over the character 1- to 3-grams of the whole text against
    landmark documents, Nyström features, ridge regression of each language
    against the rest; texts are scored in batches by matrix products.  A text
    that is null or has no letter is ``und`` with score 0, and so is all if there
    is nothing to learn from.  A null ``doc_id`` is neither held out nor learned
    from.  Repeated rows each get a row.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    predict = predictor(spark, fit(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return (docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), predict("text").alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


#: Winner's score asked for: none, as what the scores of L languages can be depends on L (they sum to about 2 - L).
LEAST_SCORE = 0.0
#: Least likeness of a kept text, as a part of what ``CLEAN`` of the held-out texts of its language don't reach.
LEAST_LIKENESS, CLEAN = 0.4, 0.01


def calibrated(docs: DataFrame) -> Model | None:
    """``fit`` with ``clean``: for each language the likeness that all but ``CLEAN`` of its held-out, rightly named texts have.

    All held-out rows count, in ``STEPS`` steps of likeness: a count for each step of a language that has any
    comes to the driver.  A language without
    such rows has the least number of the others; without any, likeness rejects
    nothing.
    """
    model = fit(docs)
    if model is None:
        return None
    p = predictor(docs.sparkSession, model, likeness=True)("text")
    rows = (_all_texts(docs, held=True).select("lang", p.alias("p")).filter("p.lang_pred = lang")
            .groupBy("lang", F.floor(F.col("p.likeness") * STEPS).alias("step")).count().collect())
    found = {}
    for lang in {r["lang"] for r in rows}:
        steps, counts = zip(*sorted((r["step"], r["count"]) for r in rows if r["lang"] == lang))
        found[lang] = steps[int(np.searchsorted(np.cumsum(counts), CLEAN * (sum(counts) - 1), side="right"))] / STEPS
    model.clean = {a: found.get(a, min(found.values(), default=0.0)) for a in model.languages}
    return model


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Rows whose language is found, with all their columns.

    ``und`` rows go, and so do texts that are unlike the learned texts of the
    language that wins (junk, languages that were not learned): their likeness
    is under ``LEAST_LIKENESS`` of what is usual.  This compares a text with one
    language, so it doesn't depend on how many there are.  ``least`` is a floor
    of the score for callers that want one.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    model = calibrated(docs)
    p = predictor(spark, model, likeness=True)("text")
    floors = [x for a, v in (model.clean if model else {}).items() for x in (F.lit(a), F.lit(LEAST_LIKENESS * v))]
    floor = F.create_map(*floors)[p["lang_pred"]] if floors else F.lit(0.0)
    return docs.filter((p["lang_pred"] != UNKNOWN) & (p["score"] >= least) & (p["likeness"] >= floor))


def op7_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
