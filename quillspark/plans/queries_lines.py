"""Queries for lines, doc blocks, build tags and doc text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import cte, fx
from ..functions import text as X
from ..operators import lines as L
from ..operators.paths import dir_of, relative_to
from ..session import read_table
from .catalog import query
from .queries_paths import page_corpus

TAGSET = ["linux", "amd64", "integration"]


# --- E1 ---------------------------------------------------------------------
@query("e1_lines", oracle="""
SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line_no,
       unnest(string_split(text, chr(10))) AS text FROM documents""")
def e1_lines(spark, sf_dir):
    return L.lines(read_table(spark, sf_dir, "documents"), ["doc_id"], "text", partition=False)


# --- E2 / E3 (Fx6) ----------------------------------------------------------
def _fx6_targets(spark, sf_dir):
    ln = L.lines(fx(spark, sf_dir, "fx6_comments"), ["doc_id"])
    targets = ln.filter(F.col("text").rlike(r"^(func|var) ")).select("doc_id", "line_no")
    return ln, targets


@query("e2_doc_attach", oracle=cte("fx6_comments") + """
SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 7 END AS BIGINT) AS line_no,
       CASE doc_id % 3 WHEN 0 THEN 'first ' || o.o_orderpriority || chr(10) || 'second' || chr(10) || 'third' ELSE 'third' END AS doc
FROM fx6_comments JOIN orders o ON o.o_orderkey = doc_id
UNION ALL SELECT doc_id, CAST(4 AS BIGINT), '' FROM fx6_comments WHERE doc_id % 3 = 2""")
def e2_doc_attach(spark, sf_dir):
    ln, targets = _fx6_targets(spark, sf_dir)
    return L.attach_docs(targets, L.comment_blocks(ln, ["doc_id"]), ["doc_id"])


@query("e3_full_doc", oracle=cte("fx6_comments") + """
SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 7 END AS BIGINT) AS line_no,
       CASE doc_id % 3 WHEN 0 THEN 'first ' || o.o_orderpriority || chr(10) || 'second' || chr(10) || 'third'
                       WHEN 1 THEN 'first ' || o.o_orderpriority || chr(10) || 'second' || chr(10) || chr(10) || 'third'
                       ELSE 'third' END AS full_doc
FROM fx6_comments JOIN orders o ON o.o_orderkey = doc_id
UNION ALL SELECT doc_id, CAST(4 AS BIGINT), '' FROM fx6_comments WHERE doc_id % 3 = 2""")
def e3_full_doc(spark, sf_dir):
    ln, targets = _fx6_targets(spark, sf_dir)
    return L.full_docs(ln, targets, ["doc_id"])


# --- E4 / E5 / F8 (Fx1 headers) ---------------------------------------------
def fx1_lines(spark, sf_dir):
    return L.lines(fx(spark, sf_dir, "fx1_files"), ["file_id"], partition=False)


@query("e4_build_tags", oracle=cte("fx1_files") + """
SELECT file_id, CASE file_id % 4 WHEN 0 THEN 'linux' WHEN 1 THEN 'integration && !cgo' ELSE 'extra,linux' END AS tag,
       CAST(1 AS BIGINT) AS first_line, CAST(0 AS BIGINT) AS pos
FROM fx1_files WHERE file_id % 4 <> 3""")
def e4_build_tags(spark, sf_dir):
    return L.build_tags(fx1_lines(spark, sf_dir), ["file_id"]).drop("old_style")


@query("e5_tag_discovery", oracle=cte("fx1_files") + """
SELECT DISTINCT CASE file_id % 4 WHEN 1 THEN 'integration' ELSE 'extra' END AS tag
FROM fx1_files WHERE file_id % 4 IN (1, 2) AND ends_with(path, '.go') AND NOT contains(path, '/vendor/')""")
def e5_tag_discovery(spark, sf_dir):
    files = fx(spark, sf_dir, "fx1_files").filter(F.col("path").endswith(".go"))
    files = files.withColumn("rel_dir", dir_of(relative_to("path", "/repo")))
    ln = L.lines(files, ["file_id", "rel_dir"], partition=False, head=L.HEADER_LINES)
    return L.discover_tags(ln, ["file_id", "rel_dir"], "rel_dir")


@query("f8_build_constraint", oracle=cte("fx1_files") + """
SELECT file_id, file_id % 4 <> 2 AS holds FROM fx1_files""")
def f8_build_constraint(spark, sf_dir):
    files = fx(spark, sf_dir, "fx1_files")
    tags = L.build_tags(fx1_lines(spark, sf_dir), ["file_id"])
    t = F.col("tag")
    expr = F.when(F.col("old_style"), L.plus_build_to_expr(t)).otherwise(t)
    per_line = tags.select("file_id", "old_style", L.constraint_holds(expr, TAGSET).alias("ok"))
    # a //go:build line outdoes +build lines; a malformed line leaves the file undecided (null)
    counts = lambda old: (F.col("old_style") == F.lit(old)) & F.col("ok").isNull()
    verdict = lambda old: F.when(~F.bool_or(counts(old)), F.bool_and(F.when(F.col("old_style") == F.lit(old), F.col("ok"))))
    per_file = per_line.groupBy("file_id").agg(
        F.when(F.bool_or(~F.col("old_style")), verdict(False)).otherwise(verdict(True)).alias("ok"), F.lit(True).alias("any"))
    return files.join(per_file, "file_id", "left").select("file_id", F.when(F.col("any").isNull(), True).otherwise(F.col("ok")).alias("holds"))


# Constraints of every part, one of them nested by its key: text, whether it holds for TAGSET
CONSTRAINTS = ["linux && !windows", "!(linux || darwin)", "windows || linux && extra", "(windows || linux) && !extra", "!!linux", "linux &&", "(linux", "linux darwin", "&& linux", "linux)"]
CONSTRAINT_SQL = "SELECT p_partkey, CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CONSTRAINTS)) \
    + " ELSE repeat('!(windows || ', CAST(p_partkey % 40 AS INT)) || 'linux' || repeat(')', CAST(p_partkey % 40 AS INT)) END AS expr FROM part"
HOLDS_SQL = """CASE p_partkey % 11 WHEN 0 THEN 'linux' IN {t} AND 'windows' NOT IN {t} WHEN 1 THEN NOT ('linux' IN {t} OR 'darwin' IN {t})
  WHEN 2 THEN 'windows' IN {t} OR ('linux' IN {t} AND 'extra' IN {t}) WHEN 3 THEN ('windows' IN {t} OR 'linux' IN {t}) AND 'extra' NOT IN {t} WHEN 4 THEN 'linux' IN {t}
  WHEN 10 THEN (p_partkey % 40 % 2 = 0) = ('linux' IN {t}) ELSE NULL END""".replace("{t}", "(" + ", ".join(f"'{t}'" for t in TAGSET) + ")")


def constraints(spark, sf_dir):
    read_table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(CONSTRAINT_SQL)


@query("f8_constraint_grammar", oracle=f"SELECT p_partkey, {HOLDS_SQL} AS holds FROM part")
def f8_constraint_grammar(spark, sf_dir):
    return constraints(spark, sf_dir).select("p_partkey", L.constraint_holds("expr", TAGSET).alias("holds"))


@query("q1_constraint_rejects", oracle=f"WITH c AS ({CONSTRAINT_SQL}) SELECT p_partkey, 'build constraint' AS stage, 'malformed constraint ' || expr AS message FROM c WHERE p_partkey % 11 BETWEEN 5 AND 9")
def q1_constraint_rejects(spark, sf_dir):
    return L.constraint_rejects(constraints(spark, sf_dir), ["p_partkey"], "expr", TAGSET)


# --- X3 / X4 / X5 (Fx10) ----------------------------------------------------
@query("x3_macro_expand", oracle=cte("fx10_docs") + """
SELECT doc_id, replace(replace(replace(replace(doc, '${gad:current:fq}', path), '${gad:current:fqdir}', regexp_extract(path, '^(.*)/[^/]*$', 1)),
       '${gad:current:dir}', string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/')[-1]), '${gad:current:file}', string_split(path, '/')[-1]) AS doc
FROM fx10_docs""")
def x3_macro_expand(spark, sf_dir):
    d = fx(spark, sf_dir, "fx10_docs")
    return d.select("doc_id", X.expand_macros("doc", "path").alias("doc"))


@query("x4_region_tag_strip", oracle=cte("fx10_docs") + """
SELECT doc_id, regexp_replace(doc, '\\s*tag::.*\\[\\]', '', 'g') AS doc FROM fx10_docs""")
def x4_region_tag_strip(spark, sf_dir):
    d = fx(spark, sf_dir, "fx10_docs")
    return d.select("doc_id", X.strip_region_tags("doc").alias("doc"))


@query("x5_heading_strip", oracle=cte("fx10_docs") + """
SELECT doc_id, regexp_replace(doc, '(?m)^[ \t]*#{1,6}(?:[ \t]+(.*?))?[ \t]*$', '\\1', 'g') AS doc FROM fx10_docs
UNION ALL SELECT -doc_id - 1, regexp_replace(text, '(?m)^[ \t]*#{1,6}(?:[ \t]+(.*?))?[ \t]*$', '\\1', 'g') FROM documents""")
def x5_heading_strip(spark, sf_dir):
    d = fx(spark, sf_dir, "fx10_docs").select("doc_id", "doc")
    docs = read_table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("doc"))
    return d.unionByName(docs).select("doc_id", X.strip_headings("doc").alias("doc"))


@query("x3_doc_macro_pass", oracle=cte("fx10_docs") + """
SELECT doc_id, regexp_replace(regexp_replace(replace(doc, '${gad:current:fq}', path), '\\s*tag::.*\\[\\]', '', 'g'),
       '(?m)^[ \t]*#{1,6}(?:[ \t]+(.*?))?[ \t]*$', '\\1', 'g') AS doc FROM fx10_docs""")
def x3_doc_macro_pass(spark, sf_dir):
    d = fx(spark, sf_dir, "fx10_docs")
    return d.select("doc_id", X.process_doc("doc", "path").alias("doc"))


# --- X6 / X7 / X8 / X12 -----------------------------------------------------
@query("x6_strip_markup", oracle="""
SELECT page_id, replace(regexp_replace(html, '<[^>]*(?:>|\\z)', '', 'g'), '>', '') AS text FROM pages""")
def x6_strip_markup(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", X.strip_markup("html").alias("text"))


@query("x7_entities", oracle="""
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;') AS escaped,
       replace(replace(replace(replace(replace(replace(replace(html, '&#34;', '"'), '&gt;', '>'), '&lt;', '<'), '&#39;', ''''), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS unescaped
FROM pages""")
def x7_entities(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", X.escape_entities("html").alias("escaped"), X.unescape_entities("html").alias("unescaped"))


@query("x8_tabify", oracle="""
WITH l AS (SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line_no,
                  unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT doc_id, line_no, regexp_replace(text, '^([^ ]*) ', '\\1' || chr(9)) AS first_tab,
       regexp_replace(text, '(?s)^(.*) ([^ ]*)$', '\\1' || chr(9) || '\\2') AS last_tab FROM l""")
def x8_tabify(spark, sf_dir):
    ln = L.lines(read_table(spark, sf_dir, "documents"), ["doc_id"], "text", partition=False)
    return ln.select("doc_id", "line_no", X.tabify_first("text").alias("first_tab"),
                     X.tabify_last("text").alias("last_tab"))


@query("x12_text_helpers", oracle="""
WITH p AS (SELECT page_id, html, string_split(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '[?#].*$', ''), '/')[-1] AS f FROM pages)
SELECT page_id, regexp_replace(html || chr(10) || chr(10), '\\n+$', '') AS trimmed,
       CASE WHEN f = '' THEN '' ELSE chr(9) || f END AS indented,
       repeat('  ', length(f) % 4) AS pad, regexp_replace(f, '\\.[^.]*$', '') AS stem FROM p""")
def x12_text_helpers(spark, sf_dir):
    c = page_corpus(spark, sf_dir)
    return c.select("page_id", X.trim_newlines(F.concat("content", F.lit("\n\n"))).alias("trimmed"),
                    X.indent_line("file_name").alias("indented"),
                    X.make_indent(F.length("file_name") % 4).alias("pad"),
                    X.strip_extension("file_name").alias("stem"))
