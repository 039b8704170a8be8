"""Queries for manifests and module ownership (Fx2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import cte, fx
from ..operators import modules as M
from .catalog import query

KEY = ["l_orderkey", "l_linenumber"]


def path_rows(spark, sf_dir):
    return fx(spark, sf_dir, "fx2_paths")


DEFAULT_MODULE = "example.com/root"


def manifests(spark, sf_dir):
    return M.parse_manifests(fx(spark, sf_dir, "fx2_manifests"))


def module_table(spark, sf_dir):
    return manifests(spark, sf_dir)[0]


# Oracle building blocks: valid modules stated directly in SQL.
MODS_SQL = """
, mods AS (SELECT module_order, regexp_extract(content, '(?m)^[ \t]*module[ \t]+"?([^\\s"]+)"?', 1) AS name,
                  regexp_extract(path, '^(.*)/[^/]*$', 1) AS base,
                  regexp_extract(content, '(?m)^[ \t]*go[ \t]+([^\\s]+)', 1) AS go_version
           FROM fx2_manifests WHERE NOT ends_with(path, '/go.work') AND regexp_matches(content, '(?m)^[ \t]*module[ \t]'))
"""


# --- S3 / X9 ----------------------------------------------------------------
# Manifest-only queries read Fx11 (the Fx2 manifests plus two per customer),
# so their work grows with the data.
MODS11_SQL = MODS_SQL.replace("fx2_manifests", "fx11_manifests")


def manifests11(spark, sf_dir):
    return M.parse_manifests(fx(spark, sf_dir, "fx11_manifests"))


@query("s3_manifest_scan", oracle=cte("fx11_manifests") + MODS11_SQL + """
SELECT module_order, name, base, go_version, translate(string_split(name, '/')[-1], '._', '--') AS short_name FROM mods""")
def s3_manifest_scan(spark, sf_dir):
    return manifests11(spark, sf_dir)[0].select("module_order", "name", "base", "go_version", "short_name")


@query("s3_workspace_members", oracle=cte("fx11_manifests") + """
, u AS (SELECT module_order, path, list_filter(list_transform(string_split(regexp_extract(content, '(?s)use[ 	]*\\((.*?)\\)', 1), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l
        FROM fx11_manifests WHERE ends_with(path, '/go.work'))
SELECT module_order, CAST(unnest(range(0, len(l))) AS BIGINT) AS pos, unnest(l) AS use_path,
       unnest(list_transform(l, lambda x: regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || regexp_replace(x, '^\\./', ''))) AS member_base
FROM u""")
def s3_workspace_members(spark, sf_dir):
    return manifests11(spark, sf_dir)[1].select("module_order", "pos", "use_path", "member_base")


@query("s3_manifest_rejects", oracle=cte("fx11_manifests") + """
SELECT 'manifest' AS stage, path, 'no module line in ' || path AS message
FROM fx11_manifests WHERE NOT ends_with(path, '/go.work') AND NOT regexp_matches(content, '(?m)^[ 	]*module[ 	]')""")
def s3_manifest_rejects(spark, sf_dir):
    return manifests11(spark, sf_dir)[2]


@query("x9_version_canonical", oracle=cte("fx11_manifests") + MODS11_SQL + """
SELECT module_order, go_version,
  CASE WHEN len(string_split(regexp_extract(regexp_replace(trim(go_version), '^go', ''), '^[0-9.]*'), '.')) = 1
       THEN regexp_extract(regexp_replace(trim(go_version), '^go', ''), '^[0-9.]*')
       ELSE string_split(regexp_extract(regexp_replace(trim(go_version), '^go', ''), '^[0-9.]*'), '.')[1] || '.' ||
            string_split(regexp_extract(regexp_replace(trim(go_version), '^go', ''), '^[0-9.]*'), '.')[2] END AS go_version_short
FROM mods""")
def x9_version_canonical(spark, sf_dir):
    return manifests11(spark, sf_dir)[0].select("module_order", "go_version", "go_version_short")


# --- J2 / F10 / U1 ----------------------------------------------------------
@query("j2_first_prefix_owner", oracle=cte("fx2_manifests", "fx2_paths") + MODS_SQL + f"""
, c AS (SELECT p.l_orderkey, p.l_linenumber, p.import_path, p.path, arg_min(m.name, m.module_order) AS owner
        FROM fx2_paths p JOIN mods m ON starts_with(p.path, m.base) GROUP BY p.l_orderkey, p.l_linenumber, p.import_path, p.path)
SELECT p.l_orderkey, p.l_linenumber, p.path, coalesce(c.owner, '{DEFAULT_MODULE}') AS owner
FROM fx2_paths p LEFT JOIN c USING (l_orderkey, l_linenumber, import_path, path)""")
def j2_first_prefix_owner(spark, sf_dir):
    out = M.first_prefix_owner(path_rows(spark, sf_dir), "path", module_table(spark, sf_dir), DEFAULT_MODULE)
    return out.select(*KEY, "path", "owner")


@query("f10_module_paths", oracle=cte("fx2_manifests", "fx2_paths") + MODS_SQL + """
SELECT m.name AS module, p.l_orderkey, p.l_linenumber FROM fx2_paths p JOIN mods m ON starts_with(p.path, m.base)""")
def f10_module_paths(spark, sf_dir):
    paths = fx(spark, sf_dir, "fx2_paths").select(*KEY, "path")
    mods = module_table(spark, sf_dir).select("base", F.col("name").alias("module"))
    return M.prefix_candidates(paths, "path", mods, "base").select("module", *KEY)


@query("u1_module_union", oracle=cte("fx2_manifests", "fx2_paths") + MODS_SQL + """
SELECT m.name AS module, regexp_extract(p.path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n_files
FROM fx2_paths p JOIN mods m ON starts_with(p.path, m.base) GROUP BY 1, 2""")
def u1_module_union(spark, sf_dir):
    paths = fx(spark, sf_dir, "fx2_paths").select(*KEY, "path")
    mods = module_table(spark, sf_dir).select("base", F.col("name").alias("module"))
    pairs = M.prefix_candidates(paths, "path", mods, "base")
    return pairs.groupBy("module", M.dir_of("path").alias("dir")).agg(F.count(F.lit(1)).alias("n_files"))


# --- J3 / J4 ----------------------------------------------------------------
@query("j3_longest_prefix", oracle=cte("fx2_manifests", "fx2_paths") + MODS_SQL + """
, c AS (SELECT p.l_orderkey, p.l_linenumber, p.import_path, p.path, arg_min(m.name, [-length(m.name), m.module_order]) AS module
        FROM fx2_paths p JOIN mods m ON starts_with(p.import_path, m.name) GROUP BY p.l_orderkey, p.l_linenumber, p.import_path, p.path)
SELECT p.l_orderkey, p.l_linenumber, p.import_path, c.module FROM fx2_paths p LEFT JOIN c USING (l_orderkey, l_linenumber, import_path, path)""")
def j3_longest_prefix(spark, sf_dir):
    out = M.longest_prefix_module(path_rows(spark, sf_dir), "import_path", module_table(spark, sf_dir))
    return out.select(*KEY, "import_path", "module")


@query("j4_module_membership", oracle=cte("fx2_manifests", "fx2_paths") + MODS_SQL + """
SELECT p.l_orderkey, p.l_linenumber,
  EXISTS (SELECT 1 FROM mods m WHERE starts_with(p.import_path, m.name)) AS raw_member,
  EXISTS (SELECT 1 FROM mods m WHERE p.import_path = m.name OR starts_with(p.import_path, m.name || '/')) AS boundary_member
FROM fx2_paths p""")
def j4_module_membership(spark, sf_dir):
    out = M.module_membership(path_rows(spark, sf_dir), "import_path", module_table(spark, sf_dir))
    return out.select(*KEY, "raw_member", "boundary_member")


# --- J5 / J6 / Q1 -----------------------------------------------------------
def manifest_dirs(spark, sf_dir):
    return M.manifest_table(fx(spark, sf_dir, "fx2_manifests"))


J5_SQL = cte("fx2_manifests", "fx2_paths") + MODS_SQL + """
, man AS (SELECT regexp_extract(f.path, '^(.*)/[^/]*$', 1) AS base, f.path AS manifest_path,
                 CASE WHEN ends_with(f.path, '/go.work') THEN 'workspace' ELSE 'module' END AS kind,
                 ends_with(f.path, '/go.work') OR m.name IS NOT NULL AS ok, m.name
          FROM fx2_manifests f LEFT JOIN mods m ON m.module_order = f.module_order AND NOT ends_with(f.path, '/go.work'))
, hits AS (SELECT p.l_orderkey, p.l_linenumber, p.import_path, p.path AS fpath, man.*, length(man.base) AS blen
           FROM fx2_paths p JOIN man ON starts_with(p.path, man.base || '/'))
, best AS (SELECT l_orderkey, l_linenumber, import_path, fpath, arg_max(manifest_path, [blen, CASE WHEN kind = 'workspace' THEN 1 ELSE 0 END]) AS manifest_path
           FROM hits GROUP BY l_orderkey, l_linenumber, import_path, fpath)
SELECT p.l_orderkey, p.l_linenumber, b.manifest_path, man.kind AS manifest_kind, man.name AS manifest_name,
  CASE WHEN b.manifest_path IS NULL THEN 'no manifest found' WHEN man.ok THEN 'ok'
       ELSE 'unusable ' || string_split(b.manifest_path, '/')[-1] END AS status
FROM fx2_paths p LEFT JOIN best b ON b.l_orderkey = p.l_orderkey AND b.l_linenumber = p.l_linenumber AND b.import_path = p.import_path AND b.fpath = p.path LEFT JOIN man ON man.manifest_path = b.manifest_path"""


@query("j5_nearest_manifest", oracle=J5_SQL)
def j5_nearest_manifest(spark, sf_dir):
    paths = path_rows(spark, sf_dir).withColumn("dir", M.dir_of("path"))
    return M.nearest_manifest(paths, "dir", manifest_dirs(spark, sf_dir)) \
        .select(*KEY, "manifest_path", "manifest_kind", "manifest_name", "status")


@query("j6_resolve_package", oracle=cte("fx2_manifests", "fx2_paths") + MODS_SQL + """
, c AS (SELECT p.l_orderkey, p.l_linenumber, p.import_path, p.path, arg_min(m.name, m.module_order) AS owner, arg_min(m.base, m.module_order) AS base
        FROM fx2_paths p JOIN mods m ON starts_with(p.path, m.base) GROUP BY p.l_orderkey, p.l_linenumber, p.import_path, p.path)
SELECT p.l_orderkey, p.l_linenumber,
  CASE WHEN regexp_extract(p.path, '^(.*)/[^/]*$', 1) = c.base THEN c.owner
       WHEN starts_with(regexp_extract(p.path, '^(.*)/[^/]*$', 1), c.base || '/')
       THEN c.owner || '/' || substr(regexp_extract(p.path, '^(.*)/[^/]*$', 1), length(c.base) + 2) END AS fq_package
FROM fx2_paths p LEFT JOIN c USING (l_orderkey, l_linenumber, import_path, path)""")
def j6_resolve_package(spark, sf_dir):
    owned = M.first_prefix_owner(path_rows(spark, sf_dir), "path", module_table(spark, sf_dir))
    return owned.select(*KEY, M.resolve_package("path", "owner_base", "owner").alias("fq_package"))


# files with and without a name of their own, a caller's module and a package clause
CHAIN_SQL = """
, o AS (SELECT p.*, CASE WHEN p.l_orderkey % 5 = 0 THEN p.import_path ELSE '' END AS own_fq,
          CASE WHEN p.l_linenumber % 2 = 0 THEN '/repo' END AS caller_base, CASE WHEN p.l_orderkey % 7 <> 0 THEN 'p' || CAST(p.l_linenumber AS VARCHAR) ELSE '' END AS clause
        FROM fx2_paths p)
, dirs AS (SELECT o.*, regexp_extract(o.path, '^(.*)/[^/]*$', 1) AS dir FROM o)
, first AS (SELECT d.path, arg_min(m.name, m.module_order) AS owner, arg_min(m.base, m.module_order) AS base
            FROM (SELECT DISTINCT path FROM fx2_paths) d JOIN mods m ON starts_with(d.path, m.base) GROUP BY d.path)
, named AS (SELECT d.*, f.owner, f.base, CASE WHEN d.dir = f.base THEN f.owner
              WHEN starts_with(d.dir, f.base || '/') THEN f.owner || substr(d.dir, length(f.base) + 1) END AS by_module
            FROM dirs d LEFT JOIN first f USING (path))
"""


def chain_rows(spark, sf_dir):
    """Owned paths with what else a file's package may be named by."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    return M.first_prefix_owner(path_rows(spark, sf_dir), "path", module_table(spark, sf_dir)).withColumns({
        "own_fq": F.when(order % 5 == 0, F.col("import_path")).otherwise(""),
        "caller_base": F.when(line % 2 == 0, F.lit("/repo")),
        "clause": F.when(order % 7 != 0, F.concat(F.lit("p"), line.cast("string"))).otherwise("")})


@query("j6_package_chain", oracle=cte("fx2_manifests", "fx2_paths") + MODS_SQL + CHAIN_SQL + """
SELECT l_orderkey, l_linenumber, CASE WHEN own_fq <> '' THEN own_fq WHEN by_module IS NOT NULL THEN by_module
  WHEN caller_base IS NOT NULL AND starts_with(dir, '/repo/') THEN 'example.com/root/' || substr(dir, 7)
  WHEN clause <> '' THEN clause ELSE 'example.com/caller' END AS package_path
FROM named""")
def j6_package_chain(spark, sf_dir):
    return chain_rows(spark, sf_dir).select(*KEY, M.package_path(
        F.col("own_fq"), M.resolve_package("path", "owner_base", "owner"),
        M.resolve_package("path", "caller_base", F.lit("example.com/root")), F.col("clause"),
        F.lit("example.com/caller")).alias("package_path"))


@query("q1_resolve_rejects", oracle=cte("fx2_manifests", "fx2_paths") + MODS_SQL + CHAIN_SQL + """
SELECT 'package name' AS stage, path, CASE WHEN base IS NULL THEN 'no module for the file' ELSE 'not inside module ' || owner || ' at ' || base END AS message
FROM named WHERE by_module IS NULL""")
def q1_resolve_rejects(spark, sf_dir):
    return M.resolve_rejects(chain_rows(spark, sf_dir), "path", "owner_base", "owner")


@query("q1_quarantine", oracle=cte("fx2_manifests", "fx2_paths") + """
SELECT 'manifest' AS stage, path, 'no module line in ' || path AS message
FROM fx2_manifests WHERE NOT ends_with(path, '/go.work') AND NOT regexp_matches(content, '(?m)^[ \t]*module[ \t]')
UNION ALL
SELECT 'manifest lookup' AS stage, path, 'unusable go.mod' AS message FROM fx2_paths
WHERE regexp_extract(path, '^/repo/(m[0-9]+)/', 1) IN (SELECT regexp_extract(path, '^/repo/(m[0-9]+)/', 1) FROM fx2_manifests
      WHERE NOT ends_with(path, '/go.work') AND NOT regexp_matches(content, '(?m)^[ \t]*module[ \t]'))""")
def q1_quarantine(spark, sf_dir):
    bad_manifests = manifests(spark, sf_dir)[2]
    paths = path_rows(spark, sf_dir).withColumn("dir", M.dir_of("path"))
    looked = M.nearest_manifest(paths, "dir", manifest_dirs(spark, sf_dir))
    bad_paths = looked.filter(F.col("status") != "ok").select(
        F.lit("manifest lookup").alias("stage"), "path", F.col("status").alias("message"))
    return bad_manifests.unionByName(bad_paths)


# --- J12 --------------------------------------------------------------------
J12_CANDIDATES = ["part_7.go", "part_11.go", "part_1.go", "part_2.go", "part_3.go"]


@query("j12_first_existing", oracle=cte("fx1_files") + """
, pk AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM fx1_files)
, c AS (SELECT pk.dir, x.prio, pk.dir || '/' || x.cand AS fp
        FROM pk, (VALUES (0, 'part_7.go'), (1, 'part_11.go'), (2, 'part_1.go'), (3, 'part_2.go'), (4, 'part_3.go')) x(prio, cand))
, hit AS (SELECT c.dir, arg_min(c.fp, c.prio) AS overview FROM c JOIN fx1_files f ON f.path = c.fp GROUP BY c.dir)
SELECT pk.dir, hit.overview FROM pk LEFT JOIN hit USING (dir)""")
def j12_first_existing(spark, sf_dir):
    files = fx(spark, sf_dir, "fx1_files")
    pk = files.select(M.dir_of("path").alias("dir")).distinct()
    return M.first_existing(pk, "dir", files, "path", J12_CANDIDATES)
