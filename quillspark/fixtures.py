"""Fixture views built by SQL from the driver tables.

The SQL text of each view is the same in Spark and DuckDB, so the engine and
the oracle read identical input at every scale factor.  ``chr(96)`` is the
back-tick and ``chr(36)`` the dollar sign (avoids ``${...}`` substitution).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import read_table, register_tables
from .shapes import files_sql, link_files_sql, package_files_sql

# Fixed fixture texts (given with the test data description).
FX_SQL: dict[str, str] = {}

FX_SQL["fx1_files"] = """
SELECT p_partkey AS file_id, 'example.com/m' || CAST(p_partkey % 5 AS STRING) AS module,
 '/repo/m' || CAST(p_partkey % 5 AS STRING) || CASE WHEN p_partkey % 11 = 0 THEN '/internal' WHEN p_partkey % 13 = 0 THEN '/_gen' WHEN p_partkey % 17 = 0 THEN '/vendor' ELSE '' END
 || '/' || lower(p_type) || '/part_' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 7 = 0 THEN '_test.go' WHEN p_partkey % 19 = 0 THEN '.txt' ELSE '.go' END AS path,
 CASE p_partkey % 4 WHEN 0 THEN '//go:build linux' WHEN 1 THEN '//go:build integration && !cgo' WHEN 2 THEN '// +build extra,linux' ELSE '' END || chr(10) || '' || chr(10) || '// Package ' || lower(p_type) || ' holds parts.' || chr(10) || 'package ' || lower(p_type) || chr(10) || '' || chr(10) || 'import (' || chr(10) || chr(9) || '"fmt"' || chr(10) || chr(9) || 'al "example.com/m' || CAST((p_partkey + 1) % 5 AS STRING) || '/' || lower(p_type) || '"' || chr(10) || chr(9) || '"github.com/acme/lib' || CAST(p_partkey % 3 AS STRING) || '"' || chr(10) || ')' || chr(10) || '' || chr(10) || '// Summary of part.' || chr(10) || '' || chr(10) || '// Part' || CAST(p_partkey AS STRING) || ' uses ' || chr(96) || 'fmt.Println' || chr(96) || ', ' || chr(96) || 'al.Item' || chr(96) || '.' || chr(10) || 'type Part' || CAST(p_partkey AS STRING) || ' struct {' || chr(10) || chr(9) || '// Name is the name.' || chr(10) || chr(9) || 'Name string ' || chr(96) || 'json:"name,omitempty" yaml:"name"' || chr(96) || chr(10) || chr(9) || 'Price float64 ' || chr(96) || 'json:"price"' || chr(96) || chr(10) || chr(9) || 'secret int' || chr(10) || chr(9) || 'Tags []string ' || chr(96) || 'json:"tags"' || chr(96) || chr(10) || chr(9) || 'Ref *al.Item' || chr(10) || '}' || chr(10) || '' || chr(10) || '// Total returns it.' || chr(10) || 'func (p *Part' || CAST(p_partkey AS STRING) || ') Total(a, b int, f al.Item) (float64, error) {' || chr(10) || chr(9) || 'return 0, nil' || chr(10) || '}' || chr(10) || '' || chr(10) || 'func New' || CAST(p_partkey AS STRING) || '() *Part' || CAST(p_partkey AS STRING) || ' {' || chr(10) || chr(9) || 'return nil' || chr(10) || '}' || chr(10) || '' || chr(10) || 'const (' || chr(10) || chr(9) || '// A is first.' || chr(10) || chr(9) || 'A' || CAST(p_partkey AS STRING) || ' = iota + 1' || chr(10) || chr(9) || 'B' || CAST(p_partkey AS STRING) || chr(10) || chr(9) || 'c' || CAST(p_partkey AS STRING) || chr(10) || ')' || chr(10) || '' || chr(10) || 'var x' || CAST(p_partkey AS STRING) || ', Y' || CAST(p_partkey AS STRING) || ' = 1, 2' || chr(10) || '' || chr(10) || 'type Shape' || CAST(p_partkey AS STRING) || ' interface {' || chr(10) || chr(9) || 'Area(scale float64) float64' || chr(10) || chr(9) || '~int | (string) | ~int' || chr(10) || '}' || chr(10) || '' || chr(10) || 'type Handler' || CAST(p_partkey AS STRING) || ' func(al.Item) error' || chr(10) || '' || chr(10) || 'type ID' || CAST(p_partkey AS STRING) || ' string' || chr(10) || '' AS content FROM part
"""

FX_SQL["fx2_manifests"] = """
SELECT n_nationkey AS module_order, '/repo/m' || CAST(n_nationkey AS STRING) || '/go.mod' AS path,
 CASE WHEN n_nationkey % 10 = 9 THEN 'go 1.21' ELSE 'module example.com/m' || CAST(n_nationkey AS STRING) || chr(10) || chr(10) || 'go 1.' || CAST(18 + n_regionkey AS STRING) || '.3' END AS content FROM nation
 UNION ALL SELECT 100, '/repo/go.work', 'go 1.21' || chr(10) || chr(10) || 'use (' || chr(10) || chr(9) || './m0' || chr(10) || chr(9) || './m1' || chr(10) || ')'
"""

FX_SQL["fx2_paths"] = """
SELECT l_orderkey, l_linenumber, 'example.com/m' || CAST(l_suppkey % 30 AS STRING) || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '/p' || CAST(l_partkey % 40 AS STRING) END AS import_path,
 '/repo/m' || CAST(l_suppkey % 30 AS STRING) || '/p' || CAST(l_partkey % 40 AS STRING) || '/f' || CAST(l_orderkey AS STRING) || '.go' AS path FROM lineitem
"""

FX_SQL["fx6_comments"] = """
SELECT o_orderkey AS doc_id, '// first ' || o_orderpriority || chr(10) || '// second' || chr(10)
 || CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN chr(10) ELSE chr(10) || 'var q = 1' || chr(10) || chr(10) END
 || '// third' || chr(10) || 'func F' || CAST(o_orderkey AS STRING) || '() {}' AS content FROM orders
"""

FX_SQL["fx7_imports"] = """
SELECT l_orderkey AS file_id, l_linenumber AS pos, CASE l_linenumber % 4 WHEN 0 THEN 'al' WHEN 1 THEN '' WHEN 2 THEN '_' ELSE 'x' || CAST(l_suppkey % 3 AS STRING) END AS alias,
 CASE WHEN l_partkey % 5 = 0 THEN 'fmt' WHEN l_partkey % 5 < 3 THEN 'example.com/m' || CAST(l_suppkey % 30 AS STRING) || '/p' || CAST(l_partkey % 40 AS STRING) ELSE 'github.com/acme/lib' || CAST(l_partkey % 25 AS STRING) END AS import_path FROM lineitem
"""

FX_SQL["fx8_consts"] = """
SELECT l_orderkey AS group_id, l_linenumber AS pos, 'C' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS name,
 CASE WHEN l_linenumber = 1 THEN 'iota + ' || CAST(l_suppkey % 9 AS STRING) WHEN l_partkey % 6 = 0 THEN CAST(l_suppkey AS STRING) || ' << iota' WHEN l_partkey % 6 = 1 THEN CAST(l_suppkey AS STRING) ELSE NULL END AS expr FROM lineitem
"""

FX_SQL["fx9_types"] = """
SELECT l_orderkey AS decl_id, l_linenumber AS pos, CASE l_partkey % 8 WHEN 0 THEN '*' WHEN 1 THEN '[]' WHEN 2 THEN '[3]' WHEN 3 THEN 'map[string]' WHEN 4 THEN '<-chan ' WHEN 5 THEN '...' WHEN 6 THEN '[]*' ELSE '' END
 || CASE l_suppkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'al.Item' WHEN 2 THEN 'Part' || CAST(l_suppkey AS STRING) WHEN 3 THEN 'T' ELSE 'al.Box[T]' END AS type_text,
 'json:"n' || CAST(l_linenumber AS STRING) || CASE WHEN l_linenumber % 2 = 0 THEN ',omitempty' ELSE '' END || '" yaml:"y"' AS tag FROM lineitem
"""

FX_SQL["fx10_docs"] = """
SELECT o_orderkey AS doc_id, '/repo/m' || CAST(o_custkey % 30 AS STRING) || '/p/f' || CAST(o_orderkey AS STRING) || '.go' AS path,
 '# Title ' || o_orderpriority || chr(10) || 'See ' || chr(96) || 'Item' || CAST(o_custkey % 7 AS STRING) || chr(96) || ' and ' || chr(96) || 'al.Item' || chr(96) || ', ' || chr(96) || 'Part.Price' || chr(96) || ', ' || chr(96) || 'string' || chr(96)
 || CASE WHEN o_orderkey % 2 = 0 THEN ', ' || chr(96) || 'github.com/acme/lib/v2.Box.Get' || chr(96) ELSE '' END || '.' || chr(10) || 'include::' || chr(36) || '{gad:current:fq}[tag=x]' || chr(10) || ' tag::x[]' || chr(10) || '  ##' || chr(10) || 'not # heading' AS doc FROM orders
"""
# Fx3: the export-name and receiver-key cases of the reference's tests spread
# over `part` by key so the view grows with the table (no cross join).
FX_SQL["fx3_names"] = """
SELECT p_partkey AS name_id,
 CASE p_partkey % 11 WHEN 0 THEN 'Foo' WHEN 1 THEN '*Foo' WHEN 2 THEN '[]*Foo' WHEN 3 THEN 'map[string]*pkg.Foo'
 WHEN 4 THEN 'chan<- Foo' WHEN 5 THEN '<-chan Foo' WHEN 6 THEN '(...Foo)' WHEN 7 THEN 'pkg.Bar' WHEN 8 THEN '[]string'
 WHEN 9 THEN 'map[int]*pkg.unexported' ELSE 'func()' END || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' END AS name,
 CASE p_partkey % 15 WHEN 0 THEN 'Foo' WHEN 1 THEN '*Foo' WHEN 2 THEN '**Foo' WHEN 3 THEN '&Foo' WHEN 4 THEN 'pkg.Foo'
 WHEN 5 THEN '*pkg.Foo' WHEN 6 THEN 'Foo[T]' WHEN 7 THEN '*Foo[T, U]' WHEN 8 THEN 'pkg.Foo[T]' WHEN 9 THEN 'pkg.'
 WHEN 10 THEN '*' WHEN 11 THEN '' WHEN 12 THEN '  Foo  ' WHEN 13 THEN '*pkg.Foo[T, U]' ELSE 'github.com/user/pkg.Foo' END AS receiver
FROM part
"""

# Fx11: module and workspace manifests that grow with the data: every
# customer gets a module manifest (no module line when its balance is
# negative → rejected) and a workspace manifest; the Fx2 manifests are kept.
FX_SQL["fx11_manifests"] = """
SELECT module_order, path, content FROM fx2_manifests
UNION ALL
SELECT 1000 + c_custkey AS module_order, '/corpus/c' || CAST(c_custkey AS STRING) || '/go.mod' AS path,
 CASE WHEN c_acctbal < 0 THEN 'go 1.21'
      ELSE 'module example.org/' || lower(c_mktsegment) || '/c_' || CAST(c_custkey AS STRING) || chr(10) || chr(10) || 'go ' ||
        CASE c_nationkey % 4 WHEN 0 THEN '1.' || CAST(18 + c_nationkey % 7 AS STRING) || '.' || CAST(c_nationkey AS STRING)
                             WHEN 1 THEN 'go1.' || CAST(c_nationkey AS STRING) || 'rc1'
                             WHEN 2 THEN '1.' || CAST(c_nationkey AS STRING)
                             ELSE '  1.2x' END END AS content
FROM customer
UNION ALL
SELECT 100000000 + c_custkey, '/corpus/c' || CAST(c_custkey AS STRING) || '/go.work',
 'go 1.21' || chr(10) || chr(10) || 'use (' || chr(10) || chr(9) || './a' || chr(10) || chr(9) || './b_' || CAST(c_nationkey AS STRING) || chr(10) || ')'
FROM customer
"""

# Fx12: files of varied declaration shapes.
FX_SQL["fx12_files"] = files_sql()
FX_SQL["fx13_files"] = link_files_sql()
FX_SQL["fx14_files"] = package_files_sql()

# Which base tables each view reads.
FX_BASE = {
    "fx1_files": ["part"],
    "fx2_manifests": ["nation"],
    "fx2_paths": ["lineitem"],
    "fx3_names": ["part"],
    "fx6_comments": ["orders"],
    "fx7_imports": ["lineitem"],
    "fx8_consts": ["lineitem"],
    "fx9_types": ["lineitem"],
    "fx10_docs": ["orders"],
    "fx11_manifests": ["customer"],
    "fx12_files": ["part"],
    "fx13_files": ["part"],
    "fx14_files": ["supplier"],
}

#: Source texts of a task, whatever the number of files.
TASK_FILES = 4_000
FX_TEXTS = ("fx1_files", "fx12_files", "fx13_files", "fx14_files")

# Views a view is built on (registered / inlined first).
FX_DEPS = {"fx11_manifests": ["fx2_manifests"]}


def text_tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks for the texts of view ``name``, one for each row of its table: TASK_FILES or fewer each."""
    base, = FX_BASE[name]
    return max(spark.sparkContext.defaultParallelism, -(-read_table(spark, sf_dir, base).count() // TASK_FILES))


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Return fixture view ``name`` built from the tables under ``sf_dir``."""
    for dep in FX_DEPS.get(name, []):
        fx(spark, sf_dir, dep)
    register_tables(spark, sf_dir, FX_BASE[name])
    if name in FX_TEXTS:
        # the base table is one small file: its rows are spread before each becomes a source text, as a corpus's files are
        base, = FX_BASE[name]
        spark.table(base).repartition(text_tasks(spark, sf_dir, name)).createOrReplaceTempView(base)
    df = spark.sql(FX_SQL[name])
    df.createOrReplaceTempView(name)
    return df


def cte(*names: str) -> str:
    """``WITH`` prefix that defines fixture views for an oracle query."""
    ordered: list[str] = []
    for n in names:
        for dep in FX_DEPS.get(n, []):
            if dep not in ordered:
                ordered.append(dep)
        if n not in ordered:
            ordered.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({FX_SQL[n].strip()})" for n in ordered) + "\n"
