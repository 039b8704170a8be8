"""Runs of repeated word sequences by longest common extensions over a difference cover."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_arrow_batches, table

#: A difference cover: for any two places modulo MODULUS, one shift below MODULUS takes both into COVER.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Pairs of places looked at together.
PAIRS = 1 << 20
#: Shortest run, in words.
LEAST = 12
_SAMPLED = np.isin(np.arange(MODULUS), COVER)
_SHIFT = np.array([[next(h for h in range(MODULUS) if _SAMPLED[(a + h) % MODULUS] and _SAMPLED[(b + h) % MODULUS])
                    for b in range(MODULUS)] for a in range(MODULUS)])


def _same(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from ``a`` and ``b`` on are the same, word by word and ``most`` at most."""
    out, live, step = np.zeros(len(a), np.int64), np.flatnonzero(most > 0), 0
    while len(live):
        live = live[words[a[live] + step] == words[b[live] + step]]
        step += 1
        out[live] = step
        live = live[most[live] > step]
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


class Extensions:
    """Longest common extensions of places of ``words``, whose last element stands nowhere else in it.

    Only the suffixes at places in the cover are sorted: by their first MODULUS
    words, then by doubling (a sampled place stays sampled MODULUS words on).
    Neighbours' common lengths come from the ranks of the doubling steps and make
    a sparse table of range minima.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, np.full(MODULUS, -1, words.dtype)])
        place = np.flatnonzero(_SAMPLED[np.arange(n) % MODULUS])
        m, size = len(place), int(words.max()) + 2
        self.index = np.full(n, -1)
        self.index[place] = np.arange(m)
        rank, step = _dense(words[place]), 1
        while step < MODULUS and rank.max() + 1 < m:
            rank = _dense(rank * size + self.words[place + step] + 1)
            step += 1
        ranks, span = [rank], MODULUS
        while rank.max() + 1 < m:
            ahead, after = place + span, np.zeros(m, np.int64)
            inside = ahead < n
            after[inside] = rank[self.index[ahead[inside]]] + 1
            rank = _dense(rank * (m + 1) + after)
            ranks.append(rank)
            span *= 2
        self.rank = rank
        order = place[np.argsort(rank)]
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for r in reversed(ranks[:-1]):
            span //= 2
            more = np.where(r[self.index[a + common]] == r[self.index[b + common]], span, 0)
            common += more
        common += _same(self.words, a + common, b + common, np.full(len(a), MODULUS))
        self.least, width = [common], 1
        while 2 * width <= len(common):
            self.least.append(np.minimum(self.least[-1][:-width], self.least[-1][width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words from ``a`` and ``b`` on (different places): few by comparison, then one range minimum."""
        shift = _SHIFT[a % MODULUS, b % MODULUS]
        out = _same(self.words, a, b, shift)
        on = np.flatnonzero(out == shift)
        x, y = self.rank[self.index[a[on] + shift[on]]], self.rank[self.index[b[on] + shift[on]]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            least = self.least[k]
            out[on[at]] += np.minimum(least[low[at]], least[high[at] - (1 << int(k))])
        return out


def _grid(sizes: np.ndarray, least: int):
    """Chunks of ``(document, first place in it, period)``: for each period, neighbouring multiples of it."""
    long = np.flatnonzero(sizes >= least)
    if not len(long):
        return
    half = sizes[long] // 2
    doc = np.repeat(long, half)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(half) - half, half) + 1
    count = (sizes[doc] - 1) // period
    ends = np.cumsum(count)
    start = 0
    while start < len(doc):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        c = count[start:stop]
        step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        q = np.repeat(period[start:stop], c)
        yield np.repeat(doc[start:stop], c), step * q, q
        start = stop


def _scan(docs: list[np.ndarray], size: int, least: int, ranked: bool):
    """``(document, start, end, period)`` of stretches found, and the documents in which a comparison reached sampled places.

    ``size`` words are known; each document is followed by a mark of its own, and a
    mark stands before the first.  A run covers two neighbouring multiples of its period
    at least; the first pair in it gives it.  Without ``ranked``, comparisons end where both
    places are sampled, so that only the documents which reach that need sorted suffixes.
    """
    sizes = np.array([len(d) for d in docs])
    marks = np.arange(size, size + len(docs) + 1)
    words = np.concatenate([marks[:1], *(x for d, mark in zip(docs, marks[1:]) for x in (d, [mark]))]).astype(np.int64)
    first, n = np.cumsum(sizes + 1) - sizes, len(words)
    back = words[::-1].copy()
    if ranked:
        ahead, behind = Extensions(words), Extensions(back)
    out, unsure = [], np.zeros(len(docs), bool)
    for doc, i, q in _grid(sizes, least):
        a = first[doc] + i
        keep = np.flatnonzero(words[a] == words[a + q])
        doc, i, q, a = doc[keep], i[keep], q[keep], a[keep]
        b = a + q
        if ranked:
            before = behind(n - a, n - b)
            keep = np.flatnonzero(before < q)
            doc, i, q, a, b, before = doc[keep], i[keep], q[keep], a[keep], b[keep], before[keep]
            after = ahead(a, b)
        else:
            most = np.minimum(_SHIFT[(n - a) % MODULUS, (n - b) % MODULUS], q)
            before = _same(back, n - a, n - b, most)
            keep = np.flatnonzero(before < q)
            doc, i, q, a, b, before, most = doc[keep], i[keep], q[keep], a[keep], b[keep], before[keep], most[keep]
            shift = _SHIFT[a % MODULUS, b % MODULUS]
            after = _same(words, a, b, shift)
            unsure[doc[(after == shift) | (before == most)]] = True
        start, end = i - before, i + q + after
        keep = np.flatnonzero((before + after >= q) & (end - start >= least))
        out.append(np.stack([doc[keep], start[keep], end[keep], q[keep]], 1))
    found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    return found, unsure


def runs(docs: list[np.ndarray], size: int, least: int = LEAST) -> np.ndarray:
    """Rows ``(document, start, end, period)`` of the runs in arrays of word numbers below ``size``, in this order."""
    found, unsure = _scan(docs, size, least, ranked=False)
    at = np.flatnonzero(unsure)
    if len(at):
        more, _ = _scan([docs[i] for i in at], size, least, ranked=True)
        more[:, 0] = at[more[:, 0]]
        found = np.concatenate([found[~unsure[found[:, 0]]], more])
    # a stretch found for a multiple of its smallest period is the same stretch
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :3] != found[:-1, :3]).any(1)
    found = found[new]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _collapsed(words: list[bytes], own: np.ndarray) -> bytes:
    if not len(own):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, own[:, 1] + own[:, 3], 1)
    np.add.at(edge, own[:, 2], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def _find(least: int):
    def run(batches):
        for batch in batches:
            texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            known: dict = {}
            docs = [np.array([known.setdefault(w, len(known)) for w in t], np.int64) for t in texts]
            found = runs(docs, len(known), least)
            cut = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (found[:, 1], found[:, 2] - found[:, 1], found[:, 3])], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans),
                pa.array([_collapsed(t, found[x:y]).decode() for t, x, y in zip(texts, cut, cut[1:])], pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])
    return run


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_words, runs, collapsed``, a row for each input row.

    A run is a stretch of words (between ASCII blanks) whose words one period apart
    are the same, of ``least`` words and two periods at least, with its smallest
    period, that no neighbour extends.  ``runs`` holds ``(start, length, period)`` by start,
    then period; ``collapsed`` is the text without the words that follow some run's
    first period, with one blank between words.

    For each period the text's places at its multiples are a grid (a harmonic
    sum of places in all); two neighbours whose common extensions to both sides
    make a period give a run.  Nothing is shuffled; a task holds a batch of texts
    (at least one whole text) and a few numbers for each of its words.

    Null and blank texts have no words, no runs and an empty ``collapsed``.  A null
    ``doc_id`` stays; repeated rows each give their row; other columns are ignored.
    """
    small_arrow_batches(docs.sparkSession)
    kind = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_find(least), kind)


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in a tenth of the texts, chosen by ``crc32(doc_id)``, the words from one place on repeat.

    With the checksum h and g = h div 10, a text of n words with h mod 10 = 0 repeats
    p = 1 + (n - a) div (3 + g mod 8) words from place a = g mod n on.  Texts with a
    null ``doc_id`` have no checksum and stay.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    chosen = docs.select(F.col("doc_id").cast("long"), "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    placed = chosen.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    new = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1),
                      lambda i: F.get("w", F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i).cast("int")))
    return placed.select("doc_id", F.when(n > 0, F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


def op13_word_runs(spark, sf_dir):
    found = find_runs(with_repeats(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -F.col("best.less")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
                    F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
                    F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))).cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
