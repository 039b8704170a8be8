"""Queries for references: doc tokens, alias map, resolution, rewrite, package refs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import cte, fx
from ..operators import refs as R
from ..operators.decls import type_refs
from .catalog import query
from .queries_modules import MODS_SQL, module_table

OWN_PKG_SQL = "'example.com/' || regexp_extract(path, '^/repo/([^/]+)/', 1) || '/p'"


def fx10_tokens(spark, sf_dir):
    docs = fx(spark, sf_dir, "fx10_docs")
    return docs, R.doc_tokens(docs, ["doc_id"], "doc")


# --- E16 --------------------------------------------------------------------
@query("e16_doc_refs", oracle=cte("fx10_docs") + """
, t AS (SELECT doc_id, unnest(regexp_extract_all(doc, '`([^`]+)`', 1)) AS original,
               CAST(unnest(range(0, len(regexp_extract_all(doc, '`([^`]+)`', 1)))) AS BIGINT) AS tok_pos FROM fx10_docs)
SELECT doc_id, tok_pos, original, original IN ('string', 'int', 'error', 'bool', 'any') AS builtin,
  CASE WHEN contains(original, '/') THEN 'github.com/acme/lib/v2' END AS pkg_path,
  CASE WHEN contains(original, '/') THEN 'Box' WHEN contains(original, '.') THEN string_split(original, '.')[1] ELSE '' END AS receiver,
  CASE WHEN contains(original, '/') THEN 'Get' WHEN contains(original, '.') THEN string_split(original, '.')[2] ELSE original END AS ident
FROM t""")
def e16_doc_refs(spark, sf_dir):
    _, t = fx10_tokens(spark, sf_dir)
    return t.select("doc_id", "tok_pos", "original", "builtin", "pkg_path", "receiver", "ident")


# --- J7 ---------------------------------------------------------------------
ALIAS_SQL = """
, am AS (SELECT file_id, alias_key, arg_max(import_path, {'p': pos, 'o': o, 'i': import_path}) AS import_path FROM (
    SELECT file_id, alias AS alias_key, import_path, pos, 0 AS o FROM fx7_imports WHERE alias NOT IN ('', '.', '_')
    UNION ALL SELECT file_id, string_split(import_path, '/')[-1], import_path, pos, 1 FROM fx7_imports WHERE alias NOT IN ('.', '_'))
  GROUP BY 1, 2)
"""


@query("j7_alias_map", oracle=cte("fx7_imports") + ALIAS_SQL + "SELECT file_id, alias_key, import_path FROM am")
def j7_alias_map(spark, sf_dir):
    return R.alias_map(fx(spark, sf_dir, "fx7_imports"), ["file_id"])


# --- J9 / J10 ---------------------------------------------------------------
def fx10_resolved(spark, sf_dir):
    docs = fx(spark, sf_dir, "fx10_docs")
    own = F.concat(F.lit("example.com/"), F.regexp_extract("path", r"^/repo/([^/]+)/", 1), F.lit("/p"))
    toks = R.doc_tokens(docs.withColumn("own_package", own), ["doc_id"], "doc", keep=["own_package"])
    am = R.alias_map(fx(spark, sf_dir, "fx7_imports"), ["file_id"]).withColumnRenamed("file_id", "doc_id")
    return docs, R.resolve_refs(toks, ["doc_id"], am, "own_package", module_table(spark, sf_dir))


RESOLVE_SQL = cte("fx2_manifests", "fx7_imports", "fx10_docs") + MODS_SQL + ALIAS_SQL + f"""
, t AS (SELECT doc_id, {OWN_PKG_SQL} AS own, unnest(regexp_extract_all(doc, '`([^`]+)`', 1)) AS original,
               CAST(unnest(range(0, len(regexp_extract_all(doc, '`([^`]+)`', 1)))) AS BIGINT) AS tok_pos FROM fx10_docs)
, r AS (SELECT t.doc_id, t.tok_pos, t.original,
          CASE WHEN t.original = 'string' THEN NULL
               WHEN contains(t.original, '/') THEN 'github.com/acme/lib/v2'
               WHEN t.original = 'al.Item' AND a.import_path IS NOT NULL THEN a.import_path
               ELSE t.own END AS package_path,
          CASE WHEN contains(t.original, '/') THEN 'Box' WHEN t.original = 'Part.Price' THEN 'Part'
               WHEN t.original = 'al.Item' AND a.import_path IS NULL THEN 'al' ELSE '' END AS receiver,
          CASE WHEN contains(t.original, '/') THEN 'Get' WHEN contains(t.original, '.') THEN string_split(t.original, '.')[2] ELSE t.original END AS ident
        FROM t LEFT JOIN am a ON a.file_id = t.doc_id AND a.alias_key = 'al')
, k AS (SELECT r.*, CASE WHEN receiver <> '' THEN 'method' ELSE 'type' END AS kind,
          NOT EXISTS (SELECT 1 FROM mods m WHERE r.package_path = m.name OR starts_with(r.package_path, m.name || '/')) AS external
        FROM r)
, l AS (SELECT k.*, CASE WHEN package_path IS NULL THEN NULL
          WHEN external AND receiver <> '' THEN 'link:https://pkg.go.dev/' || package_path || '#' || receiver || '.' || ident || '[' || original || ']'
          WHEN external THEN 'link:https://pkg.go.dev/' || package_path || '#' || ident || '[' || original || ']'
          ELSE '<<' || regexp_replace(package_path || '.' || CASE WHEN receiver <> '' THEN receiver || '.' ELSE '' END || ident, '[^A-Za-z0-9_\\-]', '-', 'g') || ',' || original || '>>' END AS link
        FROM k)
"""


@query("j9_doc_resolve", oracle=RESOLVE_SQL + """
SELECT doc_id, tok_pos, package_path, CASE WHEN package_path IS NULL THEN NULL ELSE kind END AS kind,
       CASE WHEN package_path IS NULL THEN NULL ELSE external END AS external, link FROM l""")
def j9_doc_resolve(spark, sf_dir):
    _, r = fx10_resolved(spark, sf_dir)
    ok = F.col("package_path").isNotNull() & ~F.col("builtin")
    return r.select("doc_id", "tok_pos", F.when(ok, F.col("package_path")).alias("package_path"),
                    F.when(ok, F.col("kind")).alias("kind"), F.when(ok, F.col("external")).alias("external"), "link")


@query("j10_doc_rewrite", oracle=RESOLVE_SQL + """
SELECT d.doc_id,
  replace(replace(replace(replace(d.doc,
    chr(96) || 'al.Item' || chr(96), (SELECT link FROM l WHERE l.doc_id = d.doc_id AND l.original = 'al.Item')),
    chr(96) || 'Part.Price' || chr(96), (SELECT link FROM l WHERE l.doc_id = d.doc_id AND l.original = 'Part.Price')),
    chr(96) || 'github.com/acme/lib/v2.Box.Get' || chr(96), coalesce((SELECT link FROM l WHERE l.doc_id = d.doc_id AND contains(l.original, '/')), '')),
    chr(96) || 'Item' || CAST(o.o_custkey % 7 AS VARCHAR) || chr(96), (SELECT link FROM l WHERE l.doc_id = d.doc_id AND starts_with(l.original, 'Item'))) AS doc_linked
FROM fx10_docs d JOIN orders o ON o.o_orderkey = d.doc_id""")
def j10_doc_rewrite(spark, sf_dir):
    docs, r = fx10_resolved(spark, sf_dir)
    return R.rewrite_docs(docs.select("doc_id", "doc"), ["doc_id"], r).select("doc_id", "doc_linked")


# --- J11 --------------------------------------------------------------------
PKG_OF_FILE = "'example.com/m' || CAST(file_id % 25 AS VARCHAR) || '/p' || CAST(file_id % 40 AS VARCHAR)"


@query("j11_package_refs", oracle=cte("fx2_manifests", "fx7_imports") + MODS_SQL + f"""
, pi AS (SELECT DISTINCT {PKG_OF_FILE} AS fq FROM fx7_imports)
, pinfo AS (SELECT fq, 'pkg-' || CAST(row_number() OVER (ORDER BY fq) AS VARCHAR) AS anchor, 'packages/' || replace(fq, '/', '_') || '.adoc' AS out_file FROM pi)
, d AS (SELECT DISTINCT {PKG_OF_FILE} AS package, import_path FROM fx7_imports)
SELECT d.package, d.import_path,
  CASE WHEN p.fq IS NOT NULL THEN 'internal-known'
       WHEN EXISTS (SELECT 1 FROM mods m WHERE d.import_path = m.name OR starts_with(d.import_path, m.name || '/')) THEN 'internal'
       ELSE 'external' END AS class, p.anchor,
  CASE WHEN p.fq IS NOT NULL THEN p.out_file
       WHEN EXISTS (SELECT 1 FROM mods m WHERE d.import_path = m.name OR starts_with(d.import_path, m.name || '/')) THEN replace(d.import_path, '/', '_') || '.adoc'
       ELSE 'https://pkg.go.dev/' || d.import_path END AS link
FROM d LEFT JOIN pinfo p ON p.fq = d.import_path""")
def j11_package_refs(spark, sf_dir):
    return _package_refs(spark, sf_dir)


# the same documents, seen from a master file below the same directory, one beside it and one elsewhere
@query("j11_relative_files", oracle=cte("fx2_manifests", "fx7_imports") + MODS_SQL + f"""
, known AS (SELECT DISTINCT {PKG_OF_FILE} AS fq FROM fx7_imports)
, d AS (SELECT DISTINCT {PKG_OF_FILE} AS package, import_path FROM fx7_imports)
SELECT v.outfile, d.package, d.import_path, v.pre || 'packages/' || replace(d.import_path, '/', '_') || '.adoc' AS link
FROM d JOIN known k ON k.fq = d.import_path, (VALUES ('docs/all.adoc', '../'), ('packages/all.adoc', ''), ('a/b/all.adoc', '../../')) v(outfile, pre)
""".replace("v.pre || 'packages/' ||", "CASE WHEN v.pre = '' THEN '' ELSE v.pre || 'packages/' END ||"))
def j11_relative_files(spark, sf_dir):
    parts = [_package_refs(spark, sf_dir, o).filter(F.col("class") == "internal-known").select(F.lit(o).alias("outfile"), "package", "import_path", "link")
             for o in ("docs/all.adoc", "packages/all.adoc", "a/b/all.adoc")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _package_refs(spark, sf_dir, outfile=None):
    from ..operators.windows import global_index
    imp = fx(spark, sf_dir, "fx7_imports")
    pkg = F.concat(F.lit("example.com/m"), (F.col("file_id") % 25).cast("string"), F.lit("/p"),
                   (F.col("file_id") % 40).cast("string"))
    pi = imp.select(pkg.alias("fq_package"), "import_path").withColumnRenamed("fq_package", "package")
    info = global_index(pi.select(F.col("package").alias("fq_package")).distinct(), ["fq_package"], "idx")
    info = info.select("fq_package", F.concat(F.lit("pkg-"), F.col("idx").cast("string")).alias("anchor"),
                       F.concat(F.lit("packages/"), F.translate("fq_package", "/", "_"), F.lit(".adoc")).alias("out_file"))
    return R.classify_package_refs(pi, info, module_table(spark, sf_dir), outfile)


# --- J8 ---------------------------------------------------------------------
@query("j8_type_links", oracle=cte("fx2_manifests", "fx7_imports", "fx9_types") + MODS_SQL + ALIAS_SQL + """
, r AS (SELECT decl_id, pos, unnest(list_filter(regexp_extract_all(type_text, '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)?'),
               lambda s: s NOT IN ('map', 'chan', 'func', 'struct', 'interface'))) AS ref FROM fx9_types)
, q AS (SELECT r.*, a.import_path FROM r LEFT JOIN am a ON a.file_id = r.decl_id AND contains(r.ref, '.') AND a.alias_key = string_split(r.ref, '.')[1])
SELECT decl_id, pos, ref,
  CASE WHEN ref IN ('string', 'T') THEN ref
       WHEN NOT contains(ref, '.') THEN '<<' || regexp_replace('example.com/m' || CAST(decl_id % 25 AS VARCHAR) || '/p.' || ref, '[^A-Za-z0-9_\\-]', '-', 'g') || ',' || ref || '>>'
       WHEN import_path IS NULL THEN ref
       WHEN EXISTS (SELECT 1 FROM mods m WHERE q.import_path = m.name OR starts_with(q.import_path, m.name || '/'))
         THEN '<<' || regexp_replace(import_path || '.' || string_split(ref, '.')[2], '[^A-Za-z0-9_\\-]', '-', 'g') || ',' || ref || '>>'
       ELSE 'link:https://pkg.go.dev/' || import_path || '#' || string_split(ref, '.')[2] || '[' || ref || ']' END AS link
FROM q""")
def j8_type_links(spark, sf_dir):
    t = fx(spark, sf_dir, "fx9_types")
    refs = type_refs(t, ["decl_id", "pos"], "type_text")
    am = R.alias_map(fx(spark, sf_dir, "fx7_imports"), ["file_id"]).withColumnRenamed("file_id", "decl_id")
    own = F.concat(F.lit("example.com/m"), (F.col("decl_id") % 25).cast("string"), F.lit("/p"))
    # the fixture's declarations are generic in T: their type parameter rows
    tparams = t.select("decl_id", F.lit("T").alias("name")).distinct()
    out = R.link_type_refs(refs, ["decl_id"], am, own, module_table(spark, sf_dir), tparams)
    return out.select("decl_id", "pos", "ref", "link")
