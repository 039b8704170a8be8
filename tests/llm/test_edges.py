"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""
import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import chat, covertree, langid, licenses, mixing, packing, secrets, simhash, token_counts, topk

LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 6000
DOCS = [
    (1, "the cat sat on the mat and the dog lay on the rug", "en", "a"),
    (2, "the cat sat on the mat and the dog lay on the rug", "en", "a"),
    (2, "the cat sat on the mat and the dog lay on the rug", "en", "a"),  # repeated row
    (3, None, "en", "a"), (4, "", "en", None), (5, " \t\n ", None, "b"), (6, "1234 !!", "fr", "b"),
    (None, "le chat est sur la table et le chien dort", "fr", "b"), (8, LONG, None, None),
    (9, "one\x00two  three\n\nfour <|endoftext|> five 你好 \U0001f600", None, "c"),
    (10, 'x token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" y', "en", "a"),
    (11, "Released under the MIT License. Licensed under CC BY-NC 4.0. CC BY-NC", "en", "a"),
    (12, "le chien dort sur la table et le chat est la", "fr", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("number", "key", "pos", "cell", "fp", "h", "turn", "n", "pool", "slot", "part_", "unit", "length", "path", "score", "gap", "row_number_")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """A scan with columns whose names clash with those inside the operators."""
    path = str(tmp_path_factory.mktemp("docs") / "t")
    df = spark.createDataFrame(DOCS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    df.withColumns({c: F.lit(f"extra {c}") for c in CLASH}).write.parquet(path)
    return spark.read.parquet(path)


def rows(df, *cols):
    out = df.select(*cols).collect() if cols else df.collect()
    return sorted((tuple(r) for r in out), key=str)


def ids(text):
    from tokenizers import Tokenizer
    from quillspark.llm.tokens import default_tokenizer
    return Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs):
    want = sorted(((d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for d, t, *_ in DOCS), key=str)
    assert rows(token_counts.count_tokens(docs)) == want
    assert rows(token_counts.count_tokens(docs.limit(0))) == []


def test_frequent_cut(spark):
    vocab = spark.createDataFrame([("a", 100, 1), ("b", 50, 1), ("c", 2, 1), ("d", 2, 1), ("e" * 300, 900, 1)], "pre string, freq long, pieces long")
    assert {r.pre for r in token_counts.most_frequent(vocab, 3).collect()} == {"a", "b"}
    assert token_counts.most_frequent(vocab, 0).count() == 0


def test_rare_pre_tokens_meet_by_join(docs, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT", 0)
    monkeypatch.setattr(token_counts, "most_frequent", lambda v: v.filter("false").select("pre", "pieces"))
    assert {r.n_tokens for r in token_counts.count_tokens(docs).collect()} == {len(ids(t)) for _, t, *_ in DOCS}


def test_simhash(docs):
    got = rows(simhash.simhash_components(docs, 3, 3))
    want = [simhash.fingerprint(t) & (1 << 64) - 1 for _, t, *_ in DOCS]
    assert sorted(g[1] for g in got) == sorted(f"{w:016x}" for w in want)
    comp = {g[0]: g[2] for g in got}
    assert comp[1] == comp[2] == 1 and comp[3] == comp[4] == comp[5] == 3
    assert len(got) == len(DOCS) and simhash.simhash_components(docs.limit(0)).count() == 0


def test_simhash_dedup(docs):
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert got.count(1) == 1 and 2 not in got and got.count(3) == 1 and 4 not in got and 8 in got and None in got
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


def test_simhash_dedup_knows_rows_by_their_place(spark, tmp_path):
    """Splits of the scan may change between its two readings; what is no scan is written first."""
    path, size = str(tmp_path / "t"), "spark.sql.files.maxPartitionBytes"
    data = [(None if i % 7 == 0 else i % 500, f"own text number {i % 500} of words w{i % 500} v{i % 500} u{i % 500} and z{i % 500}", f"row {i}") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, _metadata string")
    df.repartition(3).write.option("parquet.block.size", 4096).parquet(path)
    was = spark.conf.get(size)
    kept = simhash.simhash_dedup(spark.read.parquet(path))
    try:
        spark.conf.set(size, "8k")
        got = rows(kept)
    finally:
        spark.conf.set(size, was)
    again = rows(simhash.simhash_dedup(spark.read.parquet(path)))
    assert got == again and len({r[1] for r in got}) == len(got) and all(r in set(data) for r in got)
    assert [r[:2] for r in rows(simhash.simhash_dedup(df))] == [r[:2] for r in got]


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    r = got[11]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (15, 3, 1, 12, "cc-by-nc,mit", "cc-by-nc,mit")
    assert 0 < r.score <= 1 and got[3].n_words == 0 and got[3].labels == "" and got[3].first_word is None
    assert licenses.license_scan(docs).count() == len(DOCS) and licenses.license_scan(docs.limit(0)).count() == 0


def test_license_rules_and_containment(spark):
    own = licenses.rules()
    assert len(own) > 200 and len({(r["label"], r["pattern"]) for r in own}) > 200
    texts = [(1, "SPDX-License-Identifier: GPL-2.0-only"), (2, "under the GNU General Public License, version 3."),
             (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this"), (4, "license to drive")]
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "gpl-2", 2: "gpl-3", 3: "mit", 4: ""}


def _pfair(pools, weights):
    left = {p: pools.count(p) for p in set(pools)}
    total, seen = sum(weights.values()), dict.fromkeys(weights, 0)
    for t, p in enumerate(pools, 1):
        seen[p] += 1
        left[p] -= 1
        assert all(abs(seen[q] - t * weights[q] / total) < 1 for q in weights)
        if not left[p]:
            return


def test_mixing(docs, spark):
    mixed = mixing.mix_sources(docs, {"a": 2, "b": 1, "*": 1}, block=2)
    got = mixed.collect()
    assert set(docs.columns) <= set(mixed.columns) and sorted((r.doc_id, str(r.text)) for r in got if r.doc_id) == sorted((d, str(t)) for d, t, *_ in DOCS if d)
    assert sorted({r.slot for r in got}) == list(range(len({(r.pool, r.block) for r in got})))
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"a": 0})
    # a source with most of the rows, and a weight that doesn't divide: every prefix is within one block of its share
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 > 0, 'hot', concat('s', id % 5))").alias("source"))
    weights = {"hot": 7, "s0": 3, "s1": 2, "*": 5}
    blocks = sorted({(r.slot, r.pool) for r in mixing.mix_sources(many, weights, block=10, parts=16).collect()})
    assert [s for s, _ in blocks] == list(range(len(blocks)))
    _pfair([p for _, p in blocks], weights)


def test_unnamed_sources_are_mixed(spark):
    """Sources without a weight, one of them hot, take turns in their pool; named ones keep the order by hash."""
    sizes = {"src0": 90, "hot": 700, "a": 41, "b": 40, "c": 40, None: 7, "": 3, "src9": 1}
    data = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(data, "doc_id long, source string")
    got = mixing.mix_sources(df, block=16, parts=8).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(data)))
    order = [r.source for r in sorted(got, key=lambda r: (r.block, r.in_block)) if r.pool == mixing.OTHER]
    free = sorted(((n, s) for s, n in sizes.items() if s != "src0"), key=lambda x: -x[0])
    assert [(r.block, r.in_block) for r in sorted(got, key=lambda r: r.slot * 16 + r.in_block) if r.pool == mixing.OTHER] == [divmod(k, 16) for k in range(len(order))]
    turns = [[s for n, s in free if n > k] for k in range(700)]
    at = 0
    for left in turns:  # each turn has every source that is left once
        assert sorted(map(str, order[at:at + len(left)])) == sorted(map(str, left))
        at += len(left)
    assert at == len(order)
    # as many sources as rows
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("u"), "id").alias("source"))
    assert sorted((r.block, r.in_block) for r in mixing.mix_sources(many, parts=8).collect()) == [divmod(k, mixing.BLOCK) for k in range(3000)]
    # the pipeline's stage: the hot source has no more of the first places than the others
    mixed = corpus_pipeline.mixture(spark, df.filter("source in ('hot', 'a', 'b', 'c')").withColumn("text", F.lit("x")), None).orderBy("slot").limit(160).collect()
    assert {s: sum(r.source == s for r in mixed) for s in ("hot", "a", "b", "c")} == dict.fromkeys(("hot", "a", "b", "c"), 40)


def test_mixing_order(docs):
    df = mixing.in_order(mixing.mix_sources(docs), *docs.columns)
    assert df.columns == docs.columns and df.count() == len(DOCS)


def test_topk(spark):
    data = [(0, [1.0, 0.5], 1), (100, [0.5, -1.0], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, None, 1), (4, [float("nan"), 1.0], 1),
            (200, [None, 1.0], 1), (300, [float("inf"), 0.0], 1), (5, [0.0, 0.0], None), (100, [0.5, -1.0], 1), (6, [2.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("number", F.lit("x"))
    got = rows(topk.top_k(df, F.col("vec_id") % 100 == 0, 3))
    q = 1024 * 1024
    assert got == sorted([(0, 1, 6, 2 * q), (0, 2, 1, q * 5 // 4), (0, 3, 2, q * 5 // 4),
                          (100, 1, 100, q * 5 // 4), (100, 2, 6, q), (100, 3, 0, 0)], key=str)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 2)
    x = np.random.default_rng(1).normal(size=(500, 8))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    v = np.floor(x * 1024).astype(int)
    want = [(i, r + 1, k, s) for i in range(0, 500, 100)
            for r, (s, k) in enumerate(sorted(((int(v[i] @ v[k]), k) for k in range(500) if k != i), key=lambda p: (-p[0], p[1]))[:10])]
    assert rows(topk.top_k(df, F.col("vec_id") % 100 == 0)) == sorted(want, key=str)


def test_cover_tree_edges(spark):
    data = [(9, [1.0, 0.0], 1), (5, [2.0, 0.0], 1), (7, [1.0, 0.0], 2), (1, [0.0, 0.0], 1), (2, None, 1), (3, [float("nan"), 1.0], 1),
            (4, [1.0, 0.0], None), (6, [1.0, 0.0, 0.0], 1), (8, [], 1), (5, [2.0, 0.0], 1), (None, [0.0, 1.0], 1), (10, [None, 1.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("block", F.lit("x"))
    got = rows(covertree.near_embeddings(df))
    assert got == sorted([(9, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True),
                          (4, 0, 4, True), (6, 0, 6, True), (8, 0, 8, True), (None, 0, None, False), (10, 0, 10, True)], key=str)
    assert covertree.near_embeddings(df.limit(0)).count() == 0


def test_cover_tree_blocks(spark, monkeypatch):
    """Many blocks, chains of links across them, against all pairs."""
    monkeypatch.setattr(covertree, "BLOCK", 40)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base[rng.integers(0, 30, 400)] + rng.normal(size=(400, 16)) * 0.12, rng.normal(size=(100, 16))])
    label = rng.integers(0, 2, 500)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(500, dtype=bool)
    low = np.arange(500)
    while True:
        new = np.minimum(low, np.where(near, low[None, :], 500).min(1))
        if (new == low).all():
            break
        low = new
    assert near.sum() > 500
    assert sorted(map(tuple, covertree.near_embeddings(df).collect())) == [(i, int(near[i].sum()), int(low[i]), bool(low[i] == i)) for i in range(500)]


def test_simhash_crowded_cells(spark, monkeypatch):
    """A crowded neighbourhood compared in blocks, against all pairs."""
    monkeypatch.setattr(simhash, "CELL", 4)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(3)
    fps = {int(rng.integers(0, 1 << 63)) for _ in range(200)}
    for seed in list(fps)[:3]:
        fps |= {seed ^ int(sum(1 << int(b) for b in rng.choice(40, rng.integers(1, 5), replace=False))) for _ in range(150)}
    fps = sorted(fps)
    got = simhash._classes(spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, doc_id long"), 3).collect()
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    low = np.arange(len(a))
    while ((new := np.where(near, low[None, :], len(a)).min(1)) != low).any():
        low = new
    assert {r.fp: r.component_id for r in got} == {f: int(c) for f, c in zip(fps, low)}


def test_language(docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (3, 4, 5, 6))
    assert got[1].lang_pred == "en" and got[12].lang_pred == "fr" and 0 <= got[8].score <= 1 and got[None].held_out is False
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got if d is not None)
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_learns_repeated_rows_once(spark):
    texts = {1: ("the cat sat on the mat", "en"), 3: ("le chat est sur la table", "fr"), 4: ("the dog lay on the rug", "en"), 8: ("le chien dort ici", "fr")}
    held = [d for d in texts if zlib.crc32(str(d).encode()) % 4 == 2]
    once = [(d, t, a) for d, (t, a) in texts.items()]
    many = once + [(1, "the cat sat on the mat", "en")] * 400 + [(1, "the cat sat up", "en")] * 300
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string").repartition(3)
    sample = langid._texts(docs, langid._labelled(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in sample) == sorted((d, t) for d, t, _ in once if d not in held)
    got = langid.identify(docs).groupBy("doc_id", "lang_pred").count().collect()
    assert sum(r["count"] for r in got) == len(many)


def test_language_learns_from_all_rows(spark, monkeypatch):
    """The landmarks are few, but every learned row counts in the shares of 3-grams and every held-out one in the likeness asked for."""
    monkeypatch.setattr(langid, "PER_LANGUAGE", 5)
    monkeypatch.setattr(langid, "SAMPLE", 10)
    monkeypatch.setattr(langid, "LANDMARKS", 8)
    texts = [(d, f"the cat number {d} sat on the mat" + " zqx" * (d % 3 == 0), "en") if d % 2 else (d, f"le chat {d} est sur la table", "fr") for d in range(300)]
    model = langid.calibrated(spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(5))
    learned = [(t, a) for d, t, a in texts if zlib.crc32(str(d).encode()) % 4 != 2]
    assert model.languages == ["en", "fr"] and len(model.marks.T) == 8
    for i, lang in enumerate(model.languages):
        found = np.array([langid.presence(t) for t, a in learned if a == lang])
        assert np.allclose(model.shares[i], found[:, langid._EDGES[-2]:].mean(0))
        held = sorted(model.likeness(t, i) for d, t, a in texts if zlib.crc32(str(d).encode()) % 4 == 2 and a == lang)
        assert len(held) > 5 and abs(model.clean[lang] - held[int(langid.CLEAN * (len(held) - 1))]) <= 1 / langid.STEPS


def test_packing(docs):
    pieces = packing.token_pieces(docs, capacity=64)
    got = packing.pack(pieces, 64).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    texts = {}
    for r in sorted(got, key=lambda r: (r.piece, r.start)):
        if r.doc_id in (8, 9, 3):
            texts.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
            assert r.length == 64 or r.piece == 0
    assert texts == {d: ids(t) + [0] for d, t, *_ in DOCS if d in (8, 9, 3)}
    assert sum(r.length for r in got) == sum(len(ids(t)) + 1 for _, t, *_ in DOCS)
    assert packing.packed_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs.select(F.lit(65).alias("length")), 64)


def test_packing_rounds(spark, monkeypatch):
    """Several groups and rounds come close to best fit over all items at once."""
    monkeypatch.setattr(packing, "GROUP", 400)
    sizes = np.random.default_rng(4).integers(1, 2049, 1500)
    items = spark.createDataFrame([(i, int(s), "x") for i, s in enumerate(sizes)], "id long, length long, offset string")
    got = packing.pack(items).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 2048).all() and sorted(got.id) == list(range(1500))
    whole = 1 + max(b for b, _ in packing.best_fit(sizes.tolist(), 2048))
    assert got.sequence_id.nunique() <= 1.03 * whole


@pytest.mark.parametrize("low, high, n", [(1, 2048, 3000), (1, 40, 3000), (1025, 1300, 500), (300, 700, 5000), (683, 684, 1000), (5, 6, 1)])
def test_best_fit_by_counts(low, high, n):
    """The root's plan uses as many bins as best fit over the units and puts them side by side."""
    sizes = np.random.default_rng(n).integers(low, high, n).tolist()
    steps = packing.best_fit_counted({s: sizes.count(s) for s in set(sizes)}, 2048)
    fill, at = {}, {}
    for size, rank, many, first, offset in steps:
        assert at.setdefault(size, 0) == rank
        at[size] += many
        for b in range(first, first + many):
            assert fill.get(b, 0) == offset
            fill[b] = offset + size
    assert at == {s: sizes.count(s) for s in set(sizes)} and max(fill.values()) <= 2048
    assert len(fill) == 1 + max(b for b, _ in packing.best_fit(sizes, 2048))


@pytest.mark.parametrize("kind", ["spread", "nothing fits", "one size", "two halves"])
def test_packing_reaches_one_root(spark, monkeypatch, kind):
    """Many groups whose rounds save little: all that is left meets at the root, so no two bins with room would fit into one."""
    monkeypatch.setattr(packing, "GROUP", 50)
    sizes = {"spread": np.random.default_rng(9).integers(1, 2049, 1200), "nothing fits": np.random.default_rng(9).integers(1100, 2000, 700), "one size": np.full(700, 500),
             "two halves": np.concatenate([np.full(600, 1500), np.full(30, 548)])}[kind]
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "id long, length long")
    got = packing.pack(items).toPandas()
    assert sorted(got.id) == list(range(len(sizes)))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    fills = sorted(f for f in got.groupby("sequence_id").length.sum() if f < 2048 - packing.SLACK)
    assert sum(fills[:2]) > 2048 or len(fills) < 2
    whole = 1 + max(b for b, _ in packing.best_fit(sizes.tolist(), 2048))
    assert kind != "nothing fits" or got.sequence_id.nunique() == whole


TURNS = [(1, 0, "system", "be </s> kind"), (1, 1, "user", "[INST] hi \\[INST]"), (1, 2, "assistant", "<\\/s></s>"), (1, 2, "assistant", "<\\/s></s>"),
         (2, None, None, None), (2, 1, "assistant", None), (None, 0, "user", "x"), (3, 0, "assistant", LONG), (3, 1, "ro\nle", "tail<"),
         *[(4, t, ("system", "user", "assistant")[0 if not t else 1 + t % 2], f"turn {t} " * 90) for t in range(30)]]


def test_chat(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("x"))
    windows = chat.format_chats(df)
    many = [w for w in windows.collect() if w.conv_id == 4]
    assert len(many) > 3 and all(w.n_tokens <= chat.BUDGET for w in many)
    assert all(w.text.startswith("<s>[INST]system[/INST]turn 0 ") for w in many) and any(w.n_repeated > 1 for w in many)
    want = []
    for conv in (None, 1, 2, 3, 4):
        own = sorted([t for t in TURNS if t[0] == conv], key=lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or ""))
        all_text = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        want.append((conv, len(own), hashlib.sha256(all_text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    assert rows(chat.read_back(windows).drop("formatted_chars")) == sorted(want, key=str)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["</s>", "<\\s>", "<\\\\/s>", "[INST][/INST]", "[\\/INST]", "<</s>>", "a[", "<", "\\", ""])
def test_escape(text):
    marked, a, b = chat.format_turn(text, text)
    assert chat.unescape(marked[a:b]) == text and chat.parse_turns(marked) == [(text, text)]


def test_secrets(docs, spark):
    got = secrets.secret_scan(docs).collect()
    assert [(r.doc_id, r.start, r.length) for r in got] == [(10, 11, 40)]
    assert secrets.secret_scan(docs.limit(0)).count() == 0
    clean = [(1, "commit 1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae fixes it"), (2, "see /images/2021/photo-12/thumb.png"), (3, "id 123e4567-e89b-12d3-a456-426614174000")]
    assert secrets.secret_scan(spark.createDataFrame(clean, "doc_id long, text string")).count() == 0


def test_redaction(docs):
    out = secrets.redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == len(DOCS)
    got = {r.doc_id: r for r in out.collect()}
    assert got[10].text == f'x token = "{secrets.MASK}" y' and got[10].n_chars == len(got[10].text)
    assert all(got[d].text == t for d, t, *_ in DOCS if d not in (10,)) and got[10].gap == "extra gap"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, docs, name, stage):
    out = stage(spark, docs, None)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert out.count() > 0 and stage(spark, docs.limit(0), None).count() == 0


def test_pipeline(spark):
    """All stages against their brute-force versions on the small table."""
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    pred = {r.doc_id: r for r in langid.identify(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    docs = docs[[pred[d].lang_pred != "und" and pred[d].score >= langid.LEAST_SCORE for d in docs.doc_id]].sort_values("doc_id")
    fp = np.array([simhash.fingerprint(t) for t in docs.text], np.int64).view(np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    low = np.arange(len(fp))
    while ((new := np.where(near, low[None, :], len(fp)).min(1)) != low).any():
        low = new
    docs = docs[low == np.arange(len(fp))]
    found = {}
    for r in secrets.secret_scan(spark.createDataFrame(docs[["doc_id", "text", "source"]])).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.length))
    want = {}
    for d, t in zip(docs.doc_id, docs.text):
        for start, length in sorted(found.get(d, []), reverse=True):
            t = t[:start] + secrets.MASK + t[start + length:]
        want[d] = np.array(ids(t) + [0], "<u4")
    assert sorted(set(got.doc_id)) == sorted(want)
    for r in got.itertuples():
        assert zlib.crc32(want[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert got.length.sum() == sum(map(len, want.values()))


@pytest.mark.parametrize("text", ["", " ", " " * 2_000_000 + "x", "\n" * 50_000 + " y", "a" * 100_000, "\x1c \x85\xa0  x\u3000 y", "\u4f60\u597d \U0001f600 \u00e9t\u00e9", "it's <|endoftext|> I'LL"])
def test_coder(text):
    from quillspark.llm.tokens import coder, default_tokenizer
    assert np.frombuffer(coder(default_tokenizer()).ids(text), "<u4").tolist() == ids(text)


def test_crc_of_large_ids():
    assert zlib.crc32(np.array([50256], "<u4").tobytes()) == zlib.crc32(b"\x50\xc4\x00\x00")


def test_sequences_follow_the_mix(spark):
    """With a hot source, every prefix of the sequences keeps the target weights within a quarter of a span and three blocks."""
    counts = {"src0": 1600, "src1": 200, "src2": 200, "src3": 200, "src4": 200, "x": 800}
    names = [s for s, n in counts.items() for _ in range(n)]
    rng = np.random.default_rng(5)
    data = [(i, "the cat sat " * int(rng.integers(5, 300)), "en", s) for i, s in enumerate(names)]
    mixed = corpus_pipeline.mixture(spark, spark.createDataFrame(data, SCHEMA), None)
    got = corpus_pipeline.packing(spark, mixed, None).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= packing.CAPACITY).all() and sorted(got[got.piece == 0].doc_id) == list(range(len(names)))
    by = got.groupby("sequence_id").slot
    assert by.min().is_monotonic_increasing and (by.min() // packing.SPAN == by.max() // packing.SPAN).all()
    total, last = sum(mixing.WEIGHTS.values()), 60 * mixing.BLOCK  # up to where every pool still has blocks
    bound = mixing.BLOCK * 3 + packing.SPAN / 4
    seen, n, largest = dict.fromkeys(mixing.WEIGHTS, 0), 0, 0
    for _, own in got[got.piece == 0].sort_values("sequence_id").groupby("sequence_id"):
        for d in own.doc_id:
            seen[names[d] if names[d] in mixing.WEIGHTS else mixing.OTHER] += 1
        n += len(own)
        if n > last:
            break
        largest = max(largest, *(abs(seen[p] - n * w / total) for p, w in mixing.WEIGHTS.items()))
    assert n > last and largest <= bound
    ends = got[(got.piece == 0) & (got.slot < 2 * packing.SPAN)].doc_id
    assert all(abs(sum(names[d] == p for d in ends) - len(ends) * w / total) <= mixing.BLOCK for p, w in mixing.WEIGHTS.items() if p != mixing.OTHER)


@pytest.mark.parametrize("langs", [("en", "fr", "de", "es"), ("en", "fr")])
def test_junk_and_unlearned_languages_go(spark, langs):
    """The same junk goes for four learned languages and for two; the documents stay."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").filter(F.col("lang").isin(*langs))
    junk = ["1234 5678 || 99 ## a -- 12:30 b 77 $$ 0x1f", "@@@@ ### z9 k8 !!! ???", "x1", "xkcd qwrtz zxcvb jkqx wvxz qqzj",
            "\u4f60\u597d\u4e16\u754c\uff0c\u8fd9\u662f\u4e00\u4e2a\u4e2d\u6587\u6587\u672c\u3002" * 30, "\u0421\u044a\u0435\u0448\u044c \u0436\u0435 \u0435\u0449\u0451 \u044d\u0442\u0438\u0445 \u0431\u0443\u043b\u043e\u043a"]
    docs = real.unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string"))
    assert rows(langid.keep_identified(docs), "doc_id") == rows(real, "doc_id")


def _example(tree, rng):
    """A random match of a parsed pattern (without what it looks ahead to)."""
    from re import _constants as c
    out = ""
    for op, arg in tree:
        if op is c.LITERAL:
            out += chr(arg)
        elif op is c.IN:
            kind, what = arg[int(rng.integers(len(arg)))]
            out += chr(what if kind is c.LITERAL else int(rng.integers(what[0], what[1] + 1))) if kind is not c.CATEGORY else "w"
        elif op is c.BRANCH:
            out += _example(arg[1][int(rng.integers(len(arg[1])))], rng)
        elif op is c.SUBPATTERN:
            out += _example(arg[-1], rng)
        elif op in (c.MAX_REPEAT, c.POSSESSIVE_REPEAT):
            out += "".join(_example(arg[2], rng) for _ in range(int(rng.integers(arg[0], min(int(arg[1]), arg[0] + 2) + 1))))
        elif op not in (c.ASSERT, c.ASSERT_NOT):
            raise ValueError(op)
    return out


def test_license_gates_and_examples(spark):
    """Every rule's own matches hold its gate and one of its keys, and are detected without any other word."""
    from re import _parser
    rng, texts = np.random.default_rng(6), []
    for r in licenses.rules():
        tree = _parser.parse(r["pattern"])
        for k in range(20):
            text = f" {_example(tree, rng).strip()} "
            assert r["gate"] in text and any(w in text for w in r["keys"]) and all(r["keys"]), (r["label"], text)
            if k < 1:
                texts.append((len(texts), text))
    got = licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).filter("labels = ''").collect()
    assert [texts[r.doc_id] for r in got] == []


@pytest.mark.parametrize("text, labels", [
    ("distributed under the BSD 3-Clause", "bsd-3"), ("released under the modified BSD", "bsd-3"), ("provided under ISC", "isc"), ("shared under zlib", "zlib"),
    ("Licensed under Apache-2.0", "apache-2"), ("licensed under GPL-3.0-only", "gpl-3"), ("licensed under the GNU GPL v3", "gpl-3"), ("GPLv2 license", "gpl-2"),
    ("licensed under MPL-2.0", "mpl-2"), ("the LGPL 2.1 licence", "lgpl-2.1"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"),
    ("SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause", "bsd-3,gpl-2"),
    ("SPDX-License-Identifier: MIT\nruby and json files", "mit"), ("Licensed under MIT or Apache-2.0", "apache-2,mit"), ("a test under way with json", "")])
def test_license_short_forms(spark, text, labels):
    assert licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


def test_license_lists_of_any_length(spark):
    """Long lists need no stack: identifiers, unknown parts and words joined by 'or'."""
    texts = [("SPDX-License-Identifier: " + "MIT OR " * 100_000 + "Apache-2.0", "apache-2,mit"), ("Licensed under " + "MIT or ISC and " * 20_000 + "Zlib", "isc,mit,zlib"),
             ("may not be copied" + " or x" * 100_000 + " without permission", "proprietary"), ("SPDX-License-Identifier: " + "LicenseRef-a OR " * 50_000 + "MIT-0 OR MIT", "mit,mit-0"),
             ("may not be copied or distributed without permission", "proprietary"), ("SPDX-License-Identifier: MIT-0 OR ISC OR MIT", "isc,mit,mit-0")]
    got = licenses.license_scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    assert [r.labels for r in sorted(got, key=lambda r: r.doc_id)] == [w for _, w in texts]


def test_license_base_columns_against_a_scan(spark):
    """Counts and places of the base phrases over a whole table, word by word."""
    import re
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_scan(docs).collect()}
    upper = {i: i + 32 for i in range(65, 91)}
    phrases = [(p.split(), label) for p, label in licenses.BASE]
    for doc_id, text in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(upper))
        found = [(i, label) for p, label in phrases for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        at = [i for i, _ in found]
        assert got[doc_id] == (len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))), doc_id
