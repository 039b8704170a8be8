"""Queries for the flagship plan, package aggregates, numbering, rendering,
sinks, user functions and the incremental walk."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..fixtures import cte, fx, text_tasks
from ..operators import examples as EX
from ..operators import lines as L
from ..operators import paths as P
from ..operators import refs as R
from ..operators.udf import stream_packages, walk_files, walk_packages
from ..operators.windows import global_index, run_blocks, section_rank
from ..session import read_table
from ..sources.corpus import package_output_file
from ..sources.sinks import scratch_dir, write_merged, write_per_group
from ..streaming.incremental import final_state, incremental_walk
from . import render as RD
from .catalog import query
from .queries_decls import fx1_decls, fx1_fields
from .queries_paths import PAGE_DIR_SQL, PAGE_PATH_SQL, page_corpus

# --- flagship: page corpus → filters → link edges → classes per package ------
FLAG_EXCLUDES = ["glb:**/fr/**", "cheap"]
FLAG_GLOB = "**/{en,de,es}/**"


def page_links(spark, sf_dir):
    c = page_corpus(spark, sf_dir)
    kept, _excluded = P.exclude_filter(c, FLAG_EXCLUDES, ["url", "path"])
    kept = P.glob_filter(kept, "path", FLAG_GLOB)
    host = F.substring_index("path", "/", 1)
    hrefs = kept.select("dir", host.alias("host"),
                        F.explode(F.regexp_extract_all("content", F.lit(r'href="([^"]*)"'), 1)).alias("href"))
    edges = hrefs.select(F.col("dir").alias("package"),
                         F.when(F.col("href").startswith("/"), F.concat("host", "href")).otherwise(F.col("href"))
                         .alias("import_path"))
    allp = page_corpus(spark, sf_dir)
    info = allp.select(F.col("dir").alias("fq_package")).distinct() \
        .select("fq_package", F.lit(None).cast("string").alias("anchor"),
                package_output_file("fq_package", "fq_package").alias("out_file"))
    info = info.withColumn("anchor", F.concat(F.lit("pkg-"), F.col("fq_package")))
    hosts = allp.select(F.substring_index("path", "/", 1).alias("name")).distinct()
    return R.classify_package_refs(edges, info, hosts)


@query("flagship_page_links", oracle=f"""
WITH p AS (SELECT url, {PAGE_PATH_SQL} AS path, {PAGE_DIR_SQL} AS dir, html FROM pages),
k AS (SELECT * FROM p WHERE NOT (regexp_full_match(url, '(?:(?s:.*)/)?fr/(?:(?s:.*))?') OR regexp_full_match(path, '(?:(?s:.*)/)?fr/(?:(?s:.*))?')
                                 OR regexp_matches(url, 'cheap') OR regexp_matches(path, 'cheap'))
      AND regexp_full_match(path, '(?:(?s:.*)/)?(?:en|de|es)/(?:(?s:.*))?')),
l AS (SELECT DISTINCT dir, CASE WHEN starts_with(h, '/') THEN split_part(path, '/', 1) || h ELSE h END AS target
      FROM (SELECT dir, path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM k)),
known AS (SELECT DISTINCT dir AS d FROM p),
hosts AS (SELECT DISTINCT split_part(path, '/', 1) AS host FROM p)
SELECT dir AS package, CASE WHEN target IN (SELECT d FROM known) THEN 'internal-known'
  WHEN EXISTS (SELECT 1 FROM hosts WHERE target = host OR starts_with(target, host || '/')) THEN 'internal' ELSE 'external' END AS link_class,
  count(*) AS n_links
FROM l GROUP BY 1, 2""")
def flagship_page_links(spark, sf_dir):
    refs = page_links(spark, sf_dir)
    return refs.groupBy("package", F.col("class").alias("link_class")).agg(F.count(F.lit(1)).alias("n_links"))


# --- W1 ---------------------------------------------------------------------
@query("w1_sequence_anchors", oracle=f"""
SELECT dir, 'pkg-' || CAST(row_number() OVER (ORDER BY dir) AS VARCHAR) AS anchor
FROM (SELECT DISTINCT {PAGE_DIR_SQL} AS dir FROM pages)""")
def w1_sequence_anchors(spark, sf_dir):
    d = page_corpus(spark, sf_dir).select("dir").distinct()
    return global_index(d, ["dir"], "idx").select("dir", F.concat(F.lit("pkg-"), F.col("idx").cast("string")).alias("anchor"))


# --- W2 ---------------------------------------------------------------------
@query("w2_adjacent_runs", oracle="""
WITH e AS (SELECT user_id, event_id, event_type,
             CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS chg,
             ts FROM events),
b AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block_id FROM e)
SELECT user_id, CAST(block_id AS BIGINT) AS block_id, min(event_type) AS event_type, count(*) AS n_events,
       arg_min(event_id, (ts, event_id)) AS first_event
FROM b GROUP BY user_id, block_id""")
def w2_adjacent_runs(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    # a user may hold a large share of all events: runs are numbered per (user, day) and stitched
    b = run_blocks(ev, ["user_id"], ["ts", "event_id"], "event_type", chunk=F.date_trunc("day", "ts"))
    return b.groupBy("user_id", "block_id").agg(
        F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n_events"),
        F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


# --- O2 ---------------------------------------------------------------------
@query("o2_section_order", oracle=cte("fx1_files") + """
SELECT file_id, CAST(v.dl AS BIGINT) AS decl_line, v.r1 AS rank_default, v.r2 AS rank_package_mode
FROM fx1_files, (VALUES (15, 3, 2), (25, 8, 3), (29, 8, 3), (33, 5, 5), (40, 7, 4), (42, 2, 1), (47, 6, NULL), (49, 4, NULL)) v(dl, r1, r2)""")
def o2_section_order(spark, sf_dir):
    s = fx1_sections(spark, sf_dir)
    return s.select("file_id", "decl_line", section_rank("section").alias("rank_default"),
                    section_rank("section", package_mode=True).alias("rank_package_mode"))


# --- A2 ---------------------------------------------------------------------
def fx1_file_summary(spark, sf_dir):
    files = fx(spark, sf_dir, "fx1_files")
    ln = L.lines(files, ["file_id"], partition=text_tasks(spark, sf_dir, "fx1_files"))
    pkg_line = ln.filter(F.col("text").startswith("package ")) \
        .groupBy("file_id").agg(F.min("line_no").alias("line_no"),
                                F.min_by(F.regexp_extract("text", r"^package\s+(.*)$", 1), "line_no").alias("package"))
    pdoc = L.attach_docs(pkg_line, L.comment_blocks(ln, ["file_id"]), ["file_id"])
    tags = L.build_tags(ln, ["file_id"]).groupBy("file_id").agg(F.collect_list("tag").alias("tags"))
    d = fx1_decls(spark, sf_dir)
    nd = d.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_decls"))
    return files.select("file_id", "path", P.dir_of("path").alias("dir")) \
        .join(pdoc.select("file_id", "package", "doc").hint("merge"), "file_id", "left") \
        .join(tags.hint("merge"), "file_id", "left").join(nd.hint("merge"), "file_id", "left")


@query("a2_package_aggregate", oracle=cte("fx1_files") + """
, f AS (SELECT file_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(content, 'package ([^\\n]*)', 1) AS package,
          'Package ' || regexp_extract(content, 'package ([^\\n]*)', 1) || ' holds parts.' AS doc,
          CASE file_id % 4 WHEN 0 THEN 'linux' WHEN 1 THEN 'integration && !cgo' WHEN 2 THEN 'extra,linux' END AS tag FROM fx1_files)
SELECT dir, arg_min(package, path) AS package, string_agg(doc, chr(10) ORDER BY path) AS doc,
       coalesce(array_to_string(list_sort(list_distinct(list(tag) FILTER (WHERE tag IS NOT NULL))), ','), '') AS build_tags,
       count(*) AS n_files, CAST(8 * count(*) AS BIGINT) AS n_decls
FROM f GROUP BY dir""")
def a2_package_aggregate(spark, sf_dir):
    from ..operators.aggregates import package_aggregate
    return package_aggregate(fx1_file_summary(spark, sf_dir))


# --- A8 / A9 ----------------------------------------------------------------
@query("a8_example_json", oracle=cte("fx1_files") + """
SELECT file_id, 'Part' || CAST(file_id AS VARCHAR) AS owner,
  '{' || chr(10) || '  "name": "example",' || chr(10) || '  "price": 0.0,' || chr(10) || '  "tags": ["example"],' || chr(10) || '  "Ref": "value"' || chr(10) || '}' AS example_json
FROM fx1_files""")
def a8_example_json(spark, sf_dir):
    return EX.example_json(fx1_fields(spark, sf_dir), ["file_id"])


@query("a9_example_yaml", oracle=cte("fx1_files") + """
SELECT file_id, 'Part' || CAST(file_id AS VARCHAR) AS owner,
  'name: "example"' || chr(10) || 'Price: 0.0' || chr(10) || 'Tags:' || chr(10) || '  - "example"' || chr(10) || 'Ref: "value"' AS example_yaml
FROM fx1_files""")
def a9_example_yaml(spark, sf_dir):
    return EX.example_yaml(fx1_fields(spark, sf_dir), ["file_id"])


# --- R1 / R2 / P3 -----------------------------------------------------------
def fx1_sections(spark, sf_dir, overrides=None):
    d = fx1_decls(spark, sf_dir)
    files = fx(spark, sf_dir, "fx1_files").select("file_id", "path", P.dir_of("path").alias("package"))
    return RD.render_sections(d.join(files.hint("merge"), "file_id"), overrides)


R1_SQL = cte("fx1_files") + """
, f AS (SELECT file_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS package FROM fx1_files)
, s AS (SELECT f.file_id, f.path, f.package, CAST(v.dl AS BIGINT) AS decl_line, v.section,
   CASE WHEN v.kind = 'const' THEN '[source, go]' || chr(10) || '----' || chr(10) || 'const' || chr(10) || '----'
        ELSE '[[' || regexp_replace(f.package || '.' || replace(v.name, '#', CAST(f.file_id AS VARCHAR)), '[^A-Za-z0-9_\\-]', '-', 'g') || ']]' || chr(10)
             || '=== ' || replace(v.name, '#', CAST(f.file_id AS VARCHAR)) || chr(10) || '[source, go]' || chr(10) || '----' || chr(10)
             || replace(v.decl, '#', CAST(f.file_id AS VARCHAR)) || chr(10) || '----'
             || CASE WHEN v.doc = '' THEN '' ELSE chr(10) || chr(10) || replace(v.doc, '#', CAST(f.file_id AS VARCHAR)) END END AS text
   FROM f, (VALUES (15, 'struct', 'structs', 'Part#', 'type Part# struct', 'Part# uses ' || chr(96) || 'fmt.Println' || chr(96) || ', ' || chr(96) || 'al.Item' || chr(96) || '.'),
                   (25, 'method', 'functions', 'Total', 'func (p *Part#) Total(a, b int, f al.Item) (float64, error)', 'Total returns it.'),
                   (29, 'func', 'functions', 'New#', 'func New#() *Part#', ''), (33, 'const', 'consts', '', 'const', ''),
                   (40, 'var', 'vars', 'x#', 'var x#, Y# = 1, 2', ''), (42, 'interface', 'interfaces', 'Shape#', 'type Shape# interface', ''),
                   (47, 'functype', 'functypes', 'Handler#', 'type Handler# func(al.Item) error', ''),
                   (49, 'type', 'types', 'ID#', 'type ID# string', '')) v(dl, kind, section, name, decl, doc))
"""


@query("r1_decl_sections", oracle=R1_SQL + "SELECT file_id, decl_line, text FROM s")
def r1_decl_sections(spark, sf_dir):
    return fx1_sections(spark, sf_dir).select("file_id", "decl_line", "text")


@query("r2_section_wrappers", oracle=R1_SQL + """
SELECT package, section, '== ' || CASE section WHEN 'structs' THEN 'Structs' WHEN 'functions' THEN 'Functions' WHEN 'consts' THEN 'Constants'
  WHEN 'vars' THEN 'Variables' WHEN 'interfaces' THEN 'Interfaces' WHEN 'functypes' THEN 'Function Types' WHEN 'types' THEN 'Types' END
  || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY path, decl_line) AS text
FROM s GROUP BY package, section""")
def r2_section_wrappers(spark, sf_dir):
    return RD.section_wrappers(fx1_sections(spark, sf_dir), ["package"])


@query("p3_layout_override", oracle=R1_SQL + """
SELECT file_id, decl_line, CASE WHEN section = 'structs' THEN 'STRUCT ' || regexp_extract(text, '=== ([^\\n]*)', 1) ELSE text END AS text FROM s""")
def p3_layout_override(spark, sf_dir):
    over = {"struct": lambda: F.concat(F.lit("STRUCT "), F.col("name"))}
    return fx1_sections(spark, sf_dir, over).select("file_id", "decl_line", "text")


# --- R3 / R4 / R5 -----------------------------------------------------------
@query("r3_package_index", oracle=f"""
WITH d AS (SELECT DISTINCT {PAGE_DIR_SQL} AS dir FROM pages),
o AS (SELECT dir, CASE WHEN strpos(dir, '/') = 0 THEN '' ELSE regexp_extract(dir, '^(.*)/[^/]*$', 1) || '/' END || replace(dir, '/', '_') || '.adoc' AS out_file FROM d)
SELECT CAST(row_number() OVER (ORDER BY dir) AS BIGINT) AS idx, 'include::' || out_file || '[leveloffset=+1]' AS text,
       '== ' || dir || chr(10) || chr(10) || 'link:' || out_file || '[' || dir || ']' AS heading_text
FROM o""")
def r3_package_index(spark, sf_dir):
    d = page_corpus(spark, sf_dir).select(F.col("dir").alias("fq_package")).distinct()
    info = global_index(d, ["fq_package"], "idx").withColumn("out_file", package_output_file("fq_package", "fq_package"))
    inc = RD.package_index(info)
    head = RD.package_index(info, include=False).withColumnRenamed("text", "heading_text")
    return inc.join(head, "idx")


@query("r4_module_index", oracle=cte("fx11_manifests") + """
, mods AS (SELECT module_order, regexp_extract(content, '(?m)^[ 	]*module[ 	]+"?([^\\s"]+)"?', 1) AS name,
                  regexp_extract(path, '^(.*)/[^/]*$', 1) AS base FROM fx11_manifests
           WHERE NOT ends_with(path, '/go.work') AND regexp_matches(content, '(?m)^[ 	]*module[ 	]'))
SELECT 0 AS rank, CAST(0 AS BIGINT) AS pos, '= API' || chr(10) || ':toc:' || chr(10) AS text
UNION ALL SELECT 1, CAST(module_order AS BIGINT), '. <<module-' || CAST(module_order AS VARCHAR) || ',' || name || '>>' FROM mods
UNION ALL SELECT 2, CAST(module_order AS BIGINT), 'include::' || base || '/' || translate(string_split(name, '/')[-1], '._', '--') || '.adoc[]' FROM mods""")
def r4_module_index(spark, sf_dir):
    from ..sources.corpus import module_output_file
    from .queries_modules import manifests11
    m = manifests11(spark, sf_dir)[0]
    m = m.withColumn("out_file", module_output_file("base", "short_name"))
    return RD.module_index(m, "API")


@query("r5_reference_section", oracle=cte("fx2_manifests", "fx7_imports") + """
, mods AS (SELECT regexp_extract(content, 'module ([^\\n]*)', 1) AS name FROM fx2_manifests WHERE NOT ends_with(path, '/go.work') AND contains(content, 'module '))
, d AS (SELECT DISTINCT 'example.com/m' || CAST(file_id % 25 AS VARCHAR) || '/p' || CAST(file_id % 40 AS VARCHAR) AS package, import_path FROM fx7_imports)
, c AS (SELECT d.*, EXISTS (SELECT 1 FROM mods m WHERE d.import_path = m.name OR starts_with(d.import_path, m.name || '/')) AS internal FROM d)
SELECT package, '=== Internal' || chr(10) ||
  coalesce(string_agg(CASE WHEN internal THEN '* link:' || replace(import_path, '/', '_') || '.adoc[' || import_path || ']' END, chr(10) ORDER BY import_path), '')
  || chr(10) || chr(10) || '=== External' || chr(10) ||
  coalesce(string_agg(CASE WHEN NOT internal THEN '* link:https://pkg.go.dev/' || import_path || '[' || import_path || ']' END, chr(10) ORDER BY import_path), '') AS text
FROM c GROUP BY package""")
def r5_reference_section(spark, sf_dir):
    from .queries_modules import module_table
    imp = fx(spark, sf_dir, "fx7_imports")
    pkg = F.concat(F.lit("example.com/m"), (F.col("file_id") % 25).cast("string"), F.lit("/p"),
                   (F.col("file_id") % 40).cast("string"))
    pi = imp.select(pkg.alias("package"), "import_path")
    empty = pi.sparkSession.createDataFrame([], "fq_package string, anchor string, out_file string")
    refs = R.classify_package_refs(pi, empty, module_table(spark, sf_dir))
    return RD.reference_section(refs)


# --- W3 / S5: merged document with one header --------------------------------
@query("w3_s5_merged_document", oracle=cte("fx1_files") + """
, pk AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM fx1_files)
, rows AS (SELECT 0 AS r, '' AS dir, '= Corpus' AS text UNION ALL SELECT 1, dir, '== ' || dir FROM pk)
SELECT CAST(row_number() OVER (ORDER BY r, dir) AS BIGINT) AS line_no, text FROM rows""")
def w3_s5_merged_document(spark, sf_dir):
    files = fx(spark, sf_dir, "fx1_files")
    pk = files.select(P.dir_of("path").alias("dir")).distinct()
    header = spark.range(1).select(F.lit(0).alias("r"), F.lit("").alias("dir"), F.lit("= Corpus").alias("text"))
    rows = header.unionByName(pk.select(F.lit(1).alias("r"), "dir", F.concat(F.lit("== "), "dir").alias("text")))
    out = scratch_dir(spark, "merged")
    write_merged(rows, out, ["r", "dir"])
    back = spark.read.text(out).withColumnRenamed("value", "text")
    # global order of a merged document = part file order, then line order
    back = back.withColumn("part", F.input_file_name()).withColumn("mid", F.monotonically_increasing_id())
    return global_index(back, ["part", "mid"], "line_no").select("line_no", "text")


# --- S4 ---------------------------------------------------------------------
@query("s4_per_package_documents", oracle=R1_SQL + """
SELECT regexp_extract(package, '^(.*)/[^/]*$', 1) || '/' || replace(package, '/', '_') || '.adoc' AS out_file, count(*) AS n_sections
FROM s GROUP BY 1""")
def s4_per_package_documents(spark, sf_dir):
    s = fx1_sections(spark, sf_dir)
    rows = s.select(package_output_file("package", "package").alias("out_file"), "path", "decl_line",
                    F.regexp_replace("text", "\n", " ").alias("text"))
    out = scratch_dir(spark, "per-package")
    write_per_group(rows, out, ["path", "decl_line"])
    back = spark.read.text(out)
    return back.groupBy("out_file").agg(F.count(F.lit(1)).alias("n_sections"))


# --- P1 / P2 ----------------------------------------------------------------
def _count_lines(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": pdf["doc_id"], "n_lines": pdf["text"].str.count("\n").astype("int64") + 1})


@query("p1_per_file_function", oracle="SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents")
def p1_per_file_function(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return walk_files(docs, _count_lines, "doc_id long, n_lines long")


def _source_summary(pdf: pd.DataFrame) -> pd.DataFrame:
    """What some rows of a source add up to."""
    return pd.DataFrame({"source": [pdf["source"].iloc[0]], "n_docs": [len(pdf)],
                         "n_chars": [int(pdf["text"].str.len().sum())],
                         "first_doc": [int(pdf["doc_id"].min())]})


def _merge_summaries(states: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"source": [states["source"].iloc[0]], "n_docs": [int(states["n_docs"].sum())], "n_chars": [int(states["n_chars"].sum())],
                         "first_doc": [int(states["first_doc"].min())]})


@query("p2_per_package_function", oracle="""
SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(doc_id) AS first_doc FROM documents GROUP BY source""")
def p2_per_package_function(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return walk_packages(docs, "source", _source_summary, _merge_summaries, "source string, n_docs long, n_chars long, first_doc long")


def _gaps(source, batches):
    """Widest gap between neighbouring ids of a source, and the document before it."""
    last = widest = at = None
    for pdf in batches:
        for doc in pdf["doc_id"]:
            if last is not None and (widest is None or doc - last > widest):
                widest, at = int(doc - last), int(last)
            last = doc
    if widest is not None:
        yield pd.DataFrame({"source": [source], "widest_gap": [widest], "after_doc": [at]})


@query("p2_package_stream", oracle="""
WITH n AS (SELECT source, doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) - doc_id AS gap FROM documents)
SELECT source, max(gap) AS widest_gap, arg_max(doc_id, [gap, -doc_id]) AS after_doc FROM n WHERE gap IS NOT NULL GROUP BY source""")
def p2_package_stream(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("source", "doc_id")
    return stream_packages(docs, "source", ["doc_id"], _gaps, "source string, widest_gap long, after_doc long")


# --- T1 ---------------------------------------------------------------------
@query("t1_incremental_walk", oracle="""
SELECT doc_id, source, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents""")
def t1_incremental_walk(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    src, target, ckpt = (scratch_dir(spark, f"t1-{x}") for x in ("src", "out", "ckpt"))
    schema = "doc_id long, source string, n_lines long, revision int"

    def process(batch):
        return batch.select("doc_id", "source", (F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"), "revision")

    # the corpus arrives twice: half of the documents, some in an old revision, then the others and the new revisions
    old = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("draft\n"), "text")).otherwise(F.col("text"))
    first = docs.filter("doc_id % 2 = 0").withColumn("text", old).withColumn("revision", F.lit(0))
    second = docs.filter("doc_id % 2 = 1 or doc_id % 4 = 0").withColumn("revision", F.lit(1))
    for arrived in (first, second):
        arrived.write.option("maxRecordsPerFile", 2000).mode("append").parquet(src)
        incremental_walk(spark, src, arrived.schema, ckpt, target, process, ["doc_id"], "revision")
    return final_state(spark, target, schema).select("doc_id", "source", "n_lines")
