"""Queries for corpus-from-table, path filters and path functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import cte, fx
from ..functions import text as X
from ..operators import paths as P
from ..operators.windows import global_index
from ..session import read_table
from ..sources.corpus import corpus_from_table, package_output_file
from .catalog import query

# Page corpus: virtual path = URL without scheme, query and fragment.
PAGE_PATH_SQL = "regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '[?#].*$', '')"
PAGE_DIR_SQL = f"CASE WHEN strpos({PAGE_PATH_SQL}, '/') = 0 THEN '.' ELSE regexp_extract({PAGE_PATH_SQL}, '^(.*)/[^/]*$', 1) END"


def page_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return corpus_from_table(pages.withColumn("path", P.url_path("url")), "path", "html",
                             keep=["page_id", "url"])


# --- S2 ---------------------------------------------------------------------
@query("s2_corpus_from_table", oracle=f"""
SELECT page_id, {PAGE_PATH_SQL} AS path, {PAGE_DIR_SQL} AS dir,
       string_split({PAGE_PATH_SQL}, '/')[-1] AS file_name, CAST(length(html) AS BIGINT) AS n_chars
FROM pages""")
def s2_corpus_from_table(spark, sf_dir):
    c = page_corpus(spark, sf_dir)
    return c.select("page_id", "path", "dir", "file_name", F.length("content").cast("long").alias("n_chars"))


# --- F1 ---------------------------------------------------------------------
F1_PATTERN = "*.example.{com,net}/[a-e]?/**"


@query("f1_glob_filter", oracle=f"""
SELECT page_id, {PAGE_PATH_SQL} AS path FROM pages
WHERE regexp_full_match({PAGE_PATH_SQL}, '[^/]*\\.example\\.(?:com|net)/[a-e][^/]/(?:(?s:.*))?')""")
def f1_glob_filter(spark, sf_dir):
    return P.glob_filter(page_corpus(spark, sf_dir), "path", F1_PATTERN).select("page_id", "path")


# --- F2 ---------------------------------------------------------------------
F2_PATTERNS = ["glb:**/fr/**", "cheap", "   ", r"\?page=2", "glb:m.*/**"]


@query("f2_exclude_reason", oracle=f"""
SELECT page_id, CASE
  WHEN regexp_full_match(url, '(?:(?s:.*)/)?fr/(?:(?s:.*))?') OR regexp_full_match({PAGE_PATH_SQL}, '(?:(?s:.*)/)?fr/(?:(?s:.*))?') THEN 'glb:**/fr/**'
  WHEN regexp_matches(url, 'cheap') OR regexp_matches({PAGE_PATH_SQL}, 'cheap') THEN 'cheap'
  WHEN regexp_matches(url, '\\?page=2') OR regexp_matches({PAGE_PATH_SQL}, '\\?page=2') THEN '\\?page=2'
  WHEN regexp_full_match(url, 'm\\.[^/]*/(?:(?s:.*))?') OR regexp_full_match({PAGE_PATH_SQL}, 'm\\.[^/]*/(?:(?s:.*))?') THEN 'glb:m.*/**'
END AS excluded_by FROM pages""")
def f2_exclude_reason(spark, sf_dir):
    c = page_corpus(spark, sf_dir)
    return c.select("page_id", P.excluded_by(F2_PATTERNS, "url", "path").alias("excluded_by"))


# --- F3 ---------------------------------------------------------------------
F3_PATTERNS = ["glb:www.*", "glb:*/de", "/9[0-9]*$"]


@query("f3_subtree_prune", oracle=f"""
WITH p AS (SELECT page_id, {PAGE_PATH_SQL} AS path FROM pages),
lv AS (SELECT page_id, k, CASE WHEN k = 0 THEN '.' ELSE array_to_string(string_split(path, '/')[1:k], '/') END AS d
       FROM p, LATERAL (SELECT unnest(generate_series(0, len(string_split(path, '/')))) AS k)),
hit AS (SELECT page_id, k, CASE WHEN regexp_full_match(d, 'www\\.[^/]*') THEN 'glb:www.*'
                              WHEN regexp_full_match(d, '[^/]*/de') THEN 'glb:*/de'
                              WHEN regexp_matches(d, '/9[0-9]*$') THEN '/9[0-9]*$' END AS pat FROM lv)
SELECT p.page_id, arg_min(h.pat, h.k) AS excluded_by
FROM p LEFT JOIN hit h ON h.page_id = p.page_id AND h.pat IS NOT NULL GROUP BY p.page_id""")
def f3_subtree_prune(spark, sf_dir):
    c = page_corpus(spark, sf_dir)
    return c.select("page_id", P.subtree_excluded_by(P.relative_to("path", ""), "", F3_PATTERNS).alias("excluded_by"))


# --- F4 / F5 and the combined walk rules (on Fx1) ----------------------------
@query("f4_suffix_filter", oracle=cte("fx1_files") + """
SELECT file_id, CASE WHEN NOT ends_with(path, '.go') THEN NULL WHEN ends_with(path, '_test.go') THEN 'test' ELSE 'source' END AS suffix_class
FROM fx1_files""")
def f4_suffix_filter(spark, sf_dir):
    f = fx(spark, sf_dir, "fx1_files")
    return f.select("file_id", P.suffix_class(F.substring_index("path", "/", -1)).alias("suffix_class"))


@query("f5_segment_filter", oracle=cte("fx1_files") + """
SELECT file_id,
  CASE WHEN len(list_filter(string_split(regexp_extract(substr(path, 7), '^(.*)/[^/]*$', 1), '/'), lambda s: s = 'internal')) > 0 THEN 'internal'
       WHEN len(list_filter(string_split(regexp_extract(substr(path, 7), '^(.*)/[^/]*$', 1), '/'), lambda s: starts_with(s, '_'))) > 0 THEN 'underscore' END AS hidden
FROM fx1_files""")
def f5_segment_filter(spark, sf_dir):
    f = fx(spark, sf_dir, "fx1_files")
    rel_dir = P.dir_of(P.relative_to("path", "/repo"))
    hidden = F.when(P.has_internal_segment(rel_dir), "internal").when(P.has_underscore_segment(rel_dir), "underscore")
    return f.select("file_id", hidden.alias("hidden"))


S1_EXCLUDES = ["glb:**/vendor", "glb:**/*brass*/**"]


@query("s1_walk_rules", oracle=cte("fx1_files") + """
, r AS (SELECT file_id, path, substr(path, 7) AS rel, regexp_extract(substr(path, 7), '^(.*)/[^/]*$', 1) AS rel_dir FROM fx1_files)
SELECT file_id, CASE
  WHEN regexp_matches(path, '/vendor(/|$)') THEN 'excluded by glb:**/vendor'
  WHEN regexp_matches(rel_dir, 'brass') THEN 'excluded by glb:**/*brass*/**'
  WHEN NOT ends_with(path, '.go') THEN 'not a source file'
  WHEN ends_with(path, '_test.go') THEN 'test file'
  WHEN list_contains(string_split(rel_dir, '/'), 'internal') THEN 'internal directory'
  WHEN len(list_filter(string_split(rel_dir, '/'), lambda s: starts_with(s, '_'))) > 0 THEN 'underscored directory'
END AS drop_reason FROM r""")
def s1_walk_rules(spark, sf_dir):
    f = fx(spark, sf_dir, "fx1_files")
    return P.walk_filter(f, root="/repo", excludes=S1_EXCLUDES).select("file_id", "drop_reason")


# --- O1 ---------------------------------------------------------------------
@query("o1_corpus_order", oracle=f"""
SELECT page_id, {PAGE_PATH_SQL} AS path, row_number() OVER (ORDER BY {PAGE_PATH_SQL}, page_id) AS ord FROM pages""")
def o1_corpus_order(spark, sf_dir):
    c = page_corpus(spark, sf_dir).select("page_id", "path")
    return global_index(c, ["path", "page_id"], "ord")


# --- X1 / X2 / X11 / S6 -----------------------------------------------------
@query("x1_anchor_id", oracle=f"""
SELECT page_id, regexp_replace({PAGE_DIR_SQL} || '.' || string_split({PAGE_PATH_SQL}, '/')[-1], '[^A-Za-z0-9_\\-]', '-', 'g') AS anchor
FROM pages""")
def x1_anchor_id(spark, sf_dir):
    c = page_corpus(spark, sf_dir)
    return c.select("page_id", X.anchor_id("dir", "file_name").alias("anchor"))


@query("x2_module_short_name", oracle=f"""
SELECT page_id, translate(string_split({PAGE_DIR_SQL}, '/')[-1], '._', '--') AS short_name FROM pages""")
def x2_module_short_name(spark, sf_dir):
    c = page_corpus(spark, sf_dir)
    return c.select("page_id", X.module_short_name("dir").alias("short_name"))


@query("x11_relative_path", oracle=f"""
WITH s AS (SELECT page_id, string_split({PAGE_DIR_SQL}, '/')[2:] AS s FROM pages)
SELECT page_id, CASE WHEN len(s) > 0 AND s[1] = 'en' THEN repeat('../', len(s) - 1) || 'index.adoc'
                     ELSE repeat('../', len(s)) || 'en/index.adoc' END AS rel FROM s""")
def x11_relative_path(spark, sf_dir):
    c = page_corpus(spark, sf_dir)
    host = F.substring_index("path", "/", 1)
    target = F.concat(host, F.lit("/en/index.adoc"))
    return c.select("page_id", X.relative_path("dir", target).alias("rel"))


@query("s6_output_path", oracle=f"""
WITH d AS (SELECT DISTINCT {PAGE_DIR_SQL} AS dir FROM pages)
SELECT dir,
  CASE WHEN strpos(dir, '/') = 0 THEN '' ELSE regexp_extract(dir, '^(.*)/[^/]*$', 1) || '/' END || replace(dir, '/', '_') || '.adoc' AS out_file,
  'docs/packages/' || replace(dir, '/', '_') || '.adoc' AS out_file_with_base
FROM d""")
def s6_output_path(spark, sf_dir):
    d = page_corpus(spark, sf_dir).select("dir").distinct()
    return d.select("dir", package_output_file("dir", "dir").alias("out_file"),
                    package_output_file("dir", "dir", outfile="docs/api.adoc").alias("out_file_with_base"))


# --- A1 ---------------------------------------------------------------------
@query("a1_group_by_dir", oracle=f"""
SELECT {PAGE_DIR_SQL} AS dir, count(*) AS n_files, min({PAGE_PATH_SQL}) AS first_path, max({PAGE_PATH_SQL}) AS last_path
FROM pages GROUP BY 1""")
def a1_group_by_dir(spark, sf_dir):
    return P.group_by_dir(page_corpus(spark, sf_dir))


# --- S1: recursive file scan of a written corpus ------------------------------
S1_SCAN_EXCLUDES = ["glb:**/m=3"]


@query("s1_corpus_scan", oracle=cte("fx1_files") + """
, w AS (SELECT 'm=' || CAST(file_id % 5 AS VARCHAR) || '/t=' || CAST(file_id % 7 AS VARCHAR) AS rel_dir FROM fx1_files)
SELECT rel_dir, count(*) AS n_rows FROM w WHERE NOT starts_with(rel_dir, 'm=3/') GROUP BY 1""")
def s1_corpus_scan(spark, sf_dir):
    """Fx1 is written as text files under ``m=<module>/t=<bucket>/`` folders and
    scanned back recursively with the walk rules (suffix ``.txt``, one excluded
    module folder); each written row is one line of its file."""
    from ..sources.corpus import read_corpus
    from ..sources.sinks import scratch_dir
    f = fx(spark, sf_dir, "fx1_files")
    root = scratch_dir(spark, "s1-corpus")
    rows = f.select((F.col("file_id") % 5).alias("m"), (F.col("file_id") % 7).alias("t"),
                    F.regexp_replace("content", "\n", "\\\\n").alias("value"))
    rows.write.mode("overwrite").partitionBy("m", "t").text(root)
    files = read_corpus(spark, [root], suffix=".txt", excludes=S1_SCAN_EXCLUDES)
    per_file = files.select(P.dir_of("rel_path").alias("rel_dir"),
                            F.size(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("n"))
    return per_file.groupBy("rel_dir").agg(F.sum("n").cast("long").alias("n_rows"))
