"""URL filter by rules and the ratio of two character language models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import table, written

#: Rules (verdict, host, path): a rule fits its host, all subdomains, and paths that start with its own.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Most characters of context; symbols of the alphabet: 256 bytes and the end of the URL (the start only stands in contexts).
ORDER, SYMBOLS = 5, 257
_START, _END = "\u0100", "\u0101"
#: Grams that make up this share of all places or more are sent to every task: 65,536 of them at most.
SHARE = 1 << 16
#: Logarithms are whole numbers of millionths, so that sums don't depend on their order; bins of differences for the calibration.
UNIT, BIN, BINS = 1e6, 1000, 20000
#: One labelled URL in so many sets the threshold and is not learned from.
HELD_OUT = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as ``struct(size, rule, verdict)``, or null; of equally long ones the last in order of text, block before allow."""
    own = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"))
                    for v, h, p in rules])
    fits = F.filter(own, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _grams(url: Column, order: int) -> Column:
    """For each byte of the URL and for its end: that symbol after its ``order`` predecessors."""
    text = F.concat(F.lit(_START * order), F.decode(F.encode(F.coalesce(url, F.lit("")), "UTF-8"), "ISO-8859-1"), F.lit(_END))
    return F.explode(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1)))


def gram_counts(grams: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """``grams(gram, accepted, rejected)`` -> counts of all shorter pieces, and of each context how often and before how many symbols it stands."""
    size = F.explode(F.sequence(F.lit(1), F.lit(order + 1))).alias("size")
    pieces = written(grams.select("accepted", "rejected", "gram", size)
                     .groupBy(F.expr(f"substring(gram, {order + 2} - size, size)").alias("piece"))
                     .agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "pieces")
    contexts = (pieces.groupBy(F.expr("substring(piece, 1, length(piece) - 1)").alias("context"))
                .agg(F.sum("accepted").alias("all_accepted"), F.count_if(F.col("accepted") > 0).alias("kinds_accepted"),
                     F.sum("rejected").alias("all_rejected"), F.count_if(F.col("rejected") > 0).alias("kinds_rejected")))
    return pieces, written(contexts, "contexts")


def _chance(found: Column, name: str) -> Column:
    """Witten-Bell: from the shortest context on, counts mixed with the shorter context's chance by how many symbols it has seen."""
    def step(low: Column, x: Column) -> Column:
        seen, every, kinds = (F.coalesce(x[c], F.lit(0)).cast("double") for c in (name, f"all_{name}", f"kinds_{name}"))
        return F.when(every > 0, (seen + kinds * low) / (every + kinds)).otherwise(low)
    return F.aggregate(found, F.lit(1.0 / SYMBOLS), step)


def gram_values(need: DataFrame, pieces: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """``need(gram, uses)`` -> ``gram, uses, value``: the log of the two models' ratio, in whole millionths.

    A piece of one or two symbols stands in a large share of the grams, but there are
    SYMBOLS + 1 squared at most, so these are sent to every task; a longer
    one ends ``(SYMBOLS + 1) ** (order - 2)`` distinct grams at most, and meets them by a shuffle.
    """
    tried = (need.select("gram", "uses", F.explode(F.sequence(F.lit(1), F.lit(order + 1))).alias("size"))
             .withColumn("piece", F.expr(f"substring(gram, {order + 2} - size, size)"))
             .withColumn("context", F.expr("substring(piece, 1, size - 1)")))
    short = (tried.filter("size <= 2").join(F.broadcast(pieces.filter("length(piece) <= 2")), "piece", "left")
             .join(F.broadcast(contexts.filter("length(context) <= 1")), "context", "left"))
    long = (tried.filter("size > 2").join(pieces.filter("length(piece) > 2"), "piece", "left")
            .join(contexts.filter("length(context) > 1"), "context", "left"))
    own = F.struct("size", "accepted", "rejected", "all_accepted", "kinds_accepted", "all_rejected", "kinds_rejected")
    met = short.unionByName(long).groupBy("gram").agg(F.max("uses").alias("uses"), F.array_sort(F.collect_list(own)).alias("found"))
    ratio = F.log(_chance(F.col("found"), "accepted")) - F.log(_chance(F.col("found"), "rejected"))
    return met.select("gram", "uses", F.round(ratio * UNIT).cast("long").alias("value"))


def _sums(grams: DataFrame, values: DataFrame) -> DataFrame:
    """``grams(number, gram)`` -> ``number, total``: frequent grams from a bounded table held by every task, the others by a shuffle."""
    every = values.agg(F.sum("uses")).first()[0] or 0
    often = F.broadcast(values.filter(F.col("uses") * SHARE >= every).select("gram", "value"))
    met = grams.join(often, "gram", "left")
    near = met.filter(F.col("value").isNotNull()).groupBy("number").agg(F.sum("value").alias("total"))
    rest = (met.filter(F.col("value").isNull()).drop("value").join(values.filter(F.col("uses") * SHARE < every).select("gram", "value"), "gram")
            .groupBy("number").agg(F.sum("value").alias("total")))
    return near.unionByName(rest).groupBy("number").agg(F.sum("total").alias("total"))


def threshold(scores: DataFrame) -> float:
    """``scores(score, verdict)`` of held-out labelled URLs -> the least balanced error's threshold, the one nearest 0 of equal ones; 0 without both verdicts."""
    bins = (scores.groupBy(F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") * UNIT / BIN))).cast("int").alias("bin"))
            .agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")))
    good, bad = np.zeros(2 * BINS + 1, np.int64), np.zeros(2 * BINS + 1, np.int64)
    for r in bins.collect():  # 2 * BINS + 1 rows at most
        good[r.bin + BINS], bad[r.bin + BINS] = r.good, r.bad
    if not good.sum() or not bad.sum():
        return 0.0
    # error of allowing from bin i on: good ones below it, bad ones at or above it
    lost = (np.cumsum(good) - good) / good.sum() + np.cumsum(bad[::-1])[::-1] / bad.sum()
    best = np.flatnonzero(lost == lost.min()) - BINS
    return float(min(best, key=lambda b: (abs(b), b)) * BIN / UNIT)


def judge_urls(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """``pages(page_id, url)`` -> ``page_id, host, path, rule, verdict, score, labelled``, a row for each input row.

    URLs that a rule fits have its verdict, and are the labelled ones: of three in four
    (by hash of the URL) the accepted and the rejected each make a model of bytes after up to ``order``
    predecessors, with all counts of all of them.  The others' ``score`` is the mean log ratio a symbol,
    and the rest of the labelled ones set the threshold from which a URL without a rule is allowed.
    ``score`` is null where a URL was learned from.

    Counting works on distinct grams, summed before they are shuffled.  A null URL is scored as an
    empty one and has empty host and path; null ids stay; repeated rows
    each count and get their row; other columns are ignored.  Without labelled
    URLs of both kinds the threshold is 0.
    """
    host, path = host_and_path(F.col("url"))
    rows = (pages.select(F.monotonically_increasing_id().alias("number"), F.col("page_id"), F.col("url"), host.alias("host"), path.alias("path"))
            .withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
            .withColumn("labelled", F.when(F.col("fit").isNull(), "no")
                        .otherwise(F.when(F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0, "held out").otherwise("learned"))))
    rows = written(rows.select("number", "page_id", "url", "host", "path", "fit.rule", F.col("fit.verdict").alias("own"), "labelled"), "urls")
    learned = rows.filter("labelled = 'learned'").select((F.col("own") == "allow").cast("long").alias("accepted"), (F.col("own") == "block").cast("long").alias("rejected"),
                                                         _grams(F.col("url"), order).alias("gram"))
    top = learned.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    pieces, contexts = gram_counts(top, order)
    asked = rows.filter("labelled != 'learned'").select("number", _grams(F.col("url"), order).alias("gram"))
    need = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    values = written(gram_values(need, pieces, contexts, order), "grams")
    places = F.octet_length(F.encode(F.coalesce("url", F.lit("")), "UTF-8")) + 1
    scored = written(rows.join(_sums(asked, values), "number", "left").withColumn("score", F.col("total") / UNIT / places)
                     .select("page_id", "host", "path", "rule", "own", "score", "labelled"), "scores")
    least = threshold(scored.filter("labelled = 'held out'").select("score", F.col("own").alias("verdict")))
    by_model = F.when(F.coalesce("score", F.lit(0.0)) >= least, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("own", by_model).alias("verdict"), "score", "labelled")


def op12_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))
