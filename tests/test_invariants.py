"""Accounting invariants: kept + dropped = input, good + quarantine = input."""
from pyspark.sql import functions as F

from quillspark.fixtures import fx
from quillspark.operators import modules as M
from quillspark.operators import paths as P
from quillspark.operators.tree import nodes
from quillspark.operators.decls import declarations

SF = "/root/testdata/sf0.001"


def test_walk_filter_accounts_for_every_file(spark):
    f = fx(spark, SF, "fx1_files")
    w = P.walk_filter(f, root="/repo", excludes=["glb:**/vendor"])
    total = f.count()
    kept = w.filter(F.col("drop_reason").isNull()).count()
    dropped = w.filter(F.col("drop_reason").isNotNull()).count()
    assert kept + dropped == total and kept > 0 and dropped > 0


def test_manifest_quarantine_adds_up(spark):
    man = fx(spark, SF, "fx2_manifests")
    mods, ws, bad = M.parse_manifests(man)
    assert mods.count() + bad.count() + ws.select("manifest_path").distinct().count() == man.count()


def test_unclosed_block_goes_to_quarantine(spark):
    df = spark.createDataFrame([(1, "package x\n\ntype A struct {\n\tX int\n\ntype B int\n")], "file_id long, content string")
    good, bad = declarations(nodes(df, ["file_id"], text=True), ["file_id"])
    assert [r["name"] for r in good.collect()] == ["B"]
    assert bad.count() == 1


def test_global_index_is_dense(spark):
    from quillspark.operators.windows import global_index
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7 % 1000).alias("k"))
    idx = global_index(df, ["k"], "i").orderBy("k").select("i").collect()
    assert [r["i"] for r in idx] == list(range(1, 1001))


def test_run_blocks_chunked_equals_plain(spark):
    from quillspark.operators.windows import run_blocks
    rows = []
    # one hot user spanning many chunks, runs crossing chunk boundaries, plus small users
    for i in range(600):
        rows.append((1, i, i // 37, "ab"[(i // 5) % 2] if i % 50 else None))
    for u in range(2, 6):
        for i in range(40):
            rows.append((u, i, i // 10, "xyz"[(i // 3) % 3]))
    df = spark.createDataFrame(rows, "user_id long, seq long, day long, kind string")
    plain = run_blocks(df, ["user_id"], ["seq"], "kind").select("user_id", "seq", "block_id")
    chunked = run_blocks(df, ["user_id"], ["seq"], "kind", chunk=F.col("day")).select("user_id", "seq", "block_id")
    assert sorted(plain.collect()) == sorted(chunked.collect())


def test_package_function_of_any_size(spark, monkeypatch):
    import pandas as pd
    from quillspark.operators import udf

    def _sums(pdf):
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "n": [len(pdf)], "s": [int(pdf["v"].sum())]})

    def _merged(pdf):
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "n": [int(pdf["n"].sum())], "s": [int(pdf["s"].sum())]})
    hot = F.when(F.col("id") < 1_000_000, 0).otherwise(F.col("id") % 7 + 1)
    df = spark.range(0, 1_000_500, 1, 6).select(hot.alias("g"), F.col("id").alias("v"))
    want = sorted(tuple(r) for r in df.groupBy("g").agg(F.count("v").alias("n"), F.sum("v").alias("s")).collect())
    assert sorted(tuple(r) for r in udf.walk_packages(df, "g", _sums, _merged, "g long, n long, s long").collect()) == want
    monkeypatch.setattr(udf, "STATES", 2)
    assert sorted(tuple(r) for r in udf.walk_packages(df, "g", _sums, _merged, "g long, n long, s long").collect()) == want


def test_package_stream_is_ordered_and_whole(spark):
    import pandas as pd
    from quillspark.operators.udf import stream_packages

    def count_up(package, batches):
        if package == "skipped":
            return
        n, ok, last = 0, True, -1
        for pdf in batches:
            ok &= (pdf["v"].diff().dropna() > 0).all() and pdf["v"].iloc[0] > last
            n, last = n + len(pdf), pdf["v"].iloc[-1]
        yield pd.DataFrame({"g": [package], "n": [n], "ordered": [bool(ok)]})
    name = F.when(F.col("id") < 30_000, "hot").when(F.col("id") % 3 == 0, "skipped").when(F.col("id") % 3 == 1, F.lit(None)).otherwise("b")
    df = spark.range(0, 30_300, 1, 5).select(name.alias("g"), F.col("id").alias("v"))
    got = {r.g: (r.n, r.ordered) for r in stream_packages(df, "g", ["v"], count_up, "g string, n long, ordered boolean").collect()}
    assert got == {"hot": (30_000, True), None: (100, True), "b": (100, True)}


WALKED = "doc_id long, source string, n int, revision int"


def _walk(spark, folders, schema, seen=None):
    from quillspark.streaming.incremental import incremental_walk
    src, out, ckpt = folders

    def process(batch):
        if seen is not None:
            seen.append(batch.select("doc_id").distinct().count())
        return batch.select("doc_id", "source", F.length("text").alias("n"), "revision")
    incremental_walk(spark, src, schema, ckpt, out, process, ["doc_id"], "revision")


def test_incremental_walk_reads_new_files_and_touched_buckets_only(spark):
    import glob
    from quillspark.session import read_table
    from quillspark.sources.sinks import scratch_dir
    from quillspark.streaming.incremental import final_state
    docs = read_table(spark, SF, "documents").select("doc_id", "source", "text", F.lit(0).alias("revision"))
    folders = [scratch_dir(spark, x) for x in ("t1s", "t1o", "t1c")]
    src, out, _ = folders
    local = out.removeprefix("file:")
    seen = []
    docs.filter(F.col("doc_id") % 2 == 0).write.mode("append").parquet(src)
    _walk(spark, folders, docs.schema, seen)
    assert final_state(spark, out, WALKED).count() == docs.filter(F.col("doc_id") % 2 == 0).count()
    # of the first batch's buckets, those that the next one doesn't touch are made unreadable meanwhile
    new = docs.filter("doc_id in (4, 5)").select("doc_id", "source", F.lit("xyz").alias("text"), F.lit(1).alias("revision"))
    touched = {r[0] for r in new.select(F.pmod(F.xxhash64("doc_id"), F.lit(64))).collect()}
    kept = {}
    for path in glob.glob(f"{local}/data/batch=0/__bucket=*/*.parquet"):
        if int(path.split("__bucket=")[1].split("/")[0]) not in touched:
            kept[path] = open(path, "rb").read()
            open(path, "wb").write(b"not parquet")
    assert len(kept) > 10
    new.coalesce(1).write.mode("append").parquet(src)
    _walk(spark, folders, docs.schema, seen)
    assert seen[1:] == [2]
    written = {int(p.split("__bucket=")[1].split("/")[0]) for p in glob.glob(f"{local}/data/batch=1/__bucket=*/*.parquet")}
    assert written == touched
    for path, data in kept.items():
        open(path, "wb").write(data)
    state = {r.doc_id: (r.n, r.revision) for r in final_state(spark, out, WALKED).collect()}
    assert state[4] == (3, 1) and state[5] == (3, 1) and state[6][1] == 0 and len(state) == docs.filter(F.col("doc_id") % 2 == 0).count() + 1
    # an older revision that comes late changes nothing
    docs.filter("doc_id = 4").write.mode("append").parquet(src)
    _walk(spark, folders, docs.schema)
    assert {r.doc_id: (r.n, r.revision) for r in final_state(spark, out, WALKED).collect()} == state


def test_killed_walk_repeats_to_the_same_state(spark, monkeypatch):
    from quillspark.session import read_table
    from quillspark.sources.sinks import scratch_dir
    from quillspark.streaming import incremental
    docs = read_table(spark, SF, "documents").select("doc_id", "source", "text", F.lit(0).alias("revision"))
    folders = [scratch_dir(spark, x) for x in ("t1s", "t1o", "t1c")]
    src, out, _ = folders
    docs.filter("doc_id < 50").write.mode("append").parquet(src)
    _walk(spark, folders, docs.schema)
    before = sorted(incremental.final_state(spark, out, WALKED).collect())
    docs.filter("doc_id between 40 and 90").withColumn("revision", F.lit(1)).write.mode("append").parquet(src)
    whole = incremental._write_manifest

    def killed(*args):
        raise RuntimeError("killed")
    monkeypatch.setattr(incremental, "_write_manifest", killed)
    try:
        _walk(spark, folders, docs.schema)
        raise AssertionError("the walk should have been killed")
    except Exception as e:
        assert "killed" in str(e)
    assert sorted(incremental.final_state(spark, out, WALKED).collect()) == before  # data is there, but not in a manifest
    monkeypatch.setattr(incremental, "_write_manifest", whole)
    _walk(spark, folders, docs.schema)
    state = {r.doc_id: r.revision for r in incremental.final_state(spark, out, WALKED).collect()}
    assert state == {r.doc_id: int(r.doc_id >= 40) for r in docs.filter("doc_id <= 90").select("doc_id").collect()}


def test_workspace_load_status(spark):
    from quillspark.operators.modules import manifest_table
    rows = [(0, "/w/a/go.mod", "module example.com/a\n\ngo 1.21"),
            (1, "/w/b/go.mod", "go 1.21"),
            (2, "/w/go.work", "go 1.21\n\nuse (\n\t./a\n)"),
            (3, "/v/go.work", "go 1.21\n\nuse ./missing"),
            (4, "/u/go.work", "go 1.21\n\nuse (\n\t../w/a\n\t../w/b\n)")]
    df = spark.createDataFrame(rows, "module_order long, path string, content string")
    st = {r["manifest_path"]: r["ok"] for r in manifest_table(df).collect()}
    assert st == {"/w/a/go.mod": True, "/w/b/go.mod": False, "/w/go.work": True, "/v/go.work": False,
                  "/u/go.work": False}


def test_package_doc_rows_through_sink(spark):
    from quillspark.operators.aggregates import package_aggregate, package_doc_rows
    from quillspark.sources.sinks import scratch_dir, write_per_group
    rows = [("d1", f"d1/f{i:03d}.go", "p", f"doc {i}" if i % 3 else "", ["t"], 1) for i in range(60)]
    files = spark.createDataFrame(rows, "dir string, path string, package string, doc string, tags array<string>, n_decls long")
    out = scratch_dir(spark, "pkgdoc")
    write_per_group(package_doc_rows(files), out, ["path"], group_col="dir", text_col="doc")
    back = spark.read.text(out).withColumn("f", F.input_file_name()).withColumn("m", F.monotonically_increasing_id())
    text = "\n".join(r["value"] for r in back.orderBy("f", "m").collect())
    assert text == package_aggregate(files).first()["doc"]


def test_constraint_any_depth(spark):
    """Any nesting is reduced; tags are taken literally; malformed text is null."""
    from quillspark.operators.lines import constraint_holds
    deep = "!" * 40 + "(" * 30 + "linux" + ")" * 30
    cases = {deep: True, "go1x18": False, "go1.18 && linux": True, "!(linux || darwin)": False, "!linux && x": False, "linux &&": None, "(linux": None,
             " || ".join(["x"] * 60 + ["linux"]): True}
    df = spark.createDataFrame([(k,) for k in cases], "e string").withColumn("ok", constraint_holds("e", ["linux", "go1.18"]))
    assert {r.e: r.ok for r in df.collect()} == cases


def test_old_style_keeps_its_grammar(spark):
    from quillspark.operators import lines as L
    files = spark.createDataFrame([(1, "// +build !a,b c\n\npackage x"), (2, "//go:build a && b\n// +build c\npackage x")], "f long, content string")
    got = {(r.f, r.tag): r.old_style for r in L.build_tags(L.lines(files, ["f"], partition=False), ["f"]).collect()}
    assert got == {(1, "!a,b c"): True, (2, "a && b"): False, (2, "c"): True}


def test_prefix_lengths_without_cap(spark):
    from pyspark.sql import functions as F
    from quillspark.operators.modules import prefix_candidates
    small = spark.range(1, 5001).select(F.expr("repeat('a', int(id))").alias("base"))
    big = spark.createDataFrame([("a" * 4999 + "b",), ("b",)], "path string")
    assert prefix_candidates(big, "path", small, "base").count() == 4999


def test_tag_presence_by_key(spark):
    from quillspark.operators.aggregates import tag_presence, undocumented
    rows = [(1, "A", 'db:"a"', "X", True, "", 0, False), (1, "B", 'json:"b"', "Y", True, "", 0, False), (1, "C", None, "Z", True, "", 0, True)]
    df = spark.createDataFrame(rows, "f long, owner string, tag string, name string, exported boolean, member_doc string, depth int, anonymous boolean") \
        .selectExpr("*", "1L AS line_no", "0 AS name_pos", "'T' AS type_text")
    assert {r.owner: r.has_tags for r in tag_presence(df, ["f"]).collect()} == {"A": False, "B": True, "C": False}
    assert {r.owner: r.undocumented for r in undocumented(df, ["f"]).collect()} == {"A": "X", "B": "Y"}


def test_paths_with_blanks_and_explicit_files(spark, tmp_path):
    from quillspark.sources.corpus import read_corpus
    for name in ("my pkg/a b.go", "my pkg/c+d.go", "x%20y/e.go"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("package p\n")
    got = {r.rel_path for r in read_corpus(spark, [str(tmp_path)]).collect()}
    assert got == {"my pkg/a b.go", "my pkg/c+d.go", "x%20y/e.go"}
    files = [str(tmp_path / "my pkg/a b.go"), str(tmp_path / "my pkg/c+d.go")]
    assert {r.path for r in read_corpus(spark, [], files).collect()} == set(files)
    assert {r.rel_path for r in read_corpus(spark, [str(tmp_path)], excludes=["glb:**/my pkg/**"]).collect()} == {"x%20y/e.go"}


def test_four_part_token_is_no_package(spark):
    from quillspark.operators.refs import doc_tokens
    docs = spark.createDataFrame([(1, "see `a.b.c.d` and `a.b.c`")], "d long, doc string")
    got = {r.token: (r.alias, r.receiver, r.ident) for r in doc_tokens(docs, ["d"]).collect()}
    assert got == {"a.b.c.d": ("", "", ""), "a.b.c": ("a", "b", "c")}
