"""Queries for declarations and members (Fx1/Fx5, Fx3, Fx7, Fx8, Fx9).

Oracles state the expected rows from the fixture's definition (its fixed
line layout per file), not from the engine's plan.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..fixtures import cte, fx, text_tasks
from ..operators import aggregates as A
from ..operators import decls as D
from ..operators import examples as EX
from ..operators import lines as L
from ..operators.paths import dir_of
from ..operators.tree import nodes
from ..shapes import rows_sql
from ..sources.sinks import kept
from .catalog import query

K = ["file_id"]


DECLS = ("type", "func", "var", "const")


def fx1_nodes(spark, sf_dir, *words, text=False):
    return nodes(fx(spark, sf_dir, "fx1_files"), K, text=text, words=words or DECLS)


def fx1_decls(spark, sf_dir):
    return D.declarations(fx1_nodes(spark, sf_dir, text=True), K)[0]


# Expected declaration rows of every Fx1 file; '#' stands for the file id.
DECL_VALUES = """(VALUES
 (15, 22, 'struct', 'Part#', 'type Part# struct', 'Part# uses ' || chr(96) || 'fmt.Println' || chr(96) || ', ' || chr(96) || 'al.Item' || chr(96) || '.', true, NULL),
 (25, 27, 'method', 'Total', 'func (p *Part#) Total(a, b int, f al.Item) (float64, error)', 'Total returns it.', true, 'Part#'),
 (29, 31, 'func', 'New#', 'func New#() *Part#', '', true, NULL),
 (33, 38, 'const', '', 'const', '', false, NULL),
 (40, 40, 'var', 'x#', 'var x#, Y# = 1, 2', '', false, NULL),
 (42, 45, 'interface', 'Shape#', 'type Shape# interface', '', true, NULL),
 (47, 47, 'functype', 'Handler#', 'type Handler# func(al.Item) error', '', true, NULL),
 (49, 49, 'type', 'ID#', 'type ID# string', '', true, NULL)) v(dl, el, kind, name, decl, doc, exported, rkey)"""

DECLS_SQL = cte("fx1_files") + f"""
, d AS (SELECT f.file_id, CAST(v.dl AS BIGINT) AS decl_line, CAST(v.el AS BIGINT) AS end_line, v.kind,
          replace(v.name, '#', CAST(f.file_id AS VARCHAR)) AS name, replace(v.decl, '#', CAST(f.file_id AS VARCHAR)) AS decl,
          replace(v.doc, '#', CAST(f.file_id AS VARCHAR)) AS doc, v.exported,
          replace(v.rkey, '#', CAST(f.file_id AS VARCHAR)) AS receiver_key,
          array_to_string(string_split(f.content, chr(10))[v.dl:v.el], chr(10)) AS full_decl, f.path
        FROM fx1_files f, {DECL_VALUES})
"""


# --- E6 ---------------------------------------------------------------------
@query("e6_declarations", oracle=DECLS_SQL + "SELECT file_id, decl_line, end_line, kind, name, decl, doc, exported, receiver_key, full_decl FROM d")
def e6_declarations(spark, sf_dir):
    d = fx1_decls(spark, sf_dir)
    return d.select(*K, "decl_line", "end_line", "kind", "name", "decl", "doc", "exported", "receiver_key", "full_decl")


@query("f7_exported_filter", oracle=DECLS_SQL + "SELECT file_id, decl_line, name FROM d WHERE exported")
def f7_exported_filter(spark, sf_dir):
    d = fx1_decls(spark, sf_dir)
    private = False
    return d.filter(F.col("exported") | F.lit(private)).select(*K, "decl_line", "name")


@query("f9_unattached_funcs", oracle=DECLS_SQL + "SELECT file_id, name FROM d WHERE kind IN ('func', 'method') AND receiver_key IS NULL")
def f9_unattached_funcs(spark, sf_dir):
    d = fx1_decls(spark, sf_dir)
    return d.filter(F.col("kind").isin("func", "method") & F.col("receiver_key").isNull()).select(*K, "name")


@query("a4_kind_totals", oracle=DECLS_SQL + """
SELECT regexp_extract(path, '^/repo/(m[0-9]+)', 1) AS module,
 count(*) FILTER (WHERE kind = 'struct') AS struct, count(*) FILTER (WHERE kind = 'interface') AS interface,
 count(*) FILTER (WHERE kind = 'type') AS type, count(*) FILTER (WHERE kind = 'functype') AS functype,
 count(*) FILTER (WHERE kind = 'func') AS func, count(*) FILTER (WHERE kind = 'method') AS method,
 count(*) FILTER (WHERE kind = 'var') AS var, count(*) FILTER (WHERE kind = 'const') AS const
FROM d GROUP BY 1""")
def a4_kind_totals(spark, sf_dir):
    d = fx1_decls(spark, sf_dir)
    files = fx(spark, sf_dir, "fx1_files").select(*K, F.regexp_extract("path", r"^/repo/(m[0-9]+)", 1).alias("module"))
    return A.kind_totals(d.join(files.hint("merge"), K), ["module"])


# --- F6 / J1 key (Fx3) ------------------------------------------------------
@query("f6_visibility", oracle=cte("fx3_names") + """
SELECT name_id, name_id % 11 NOT IN (8, 9, 10) AS exported FROM fx3_names""")
def f6_visibility(spark, sf_dir):
    n = fx(spark, sf_dir, "fx3_names")
    return n.select("name_id", D.is_exported("name").alias("exported"))


@query("j1_receiver_key", oracle=cte("fx3_names") + """
SELECT name_id, CASE name_id % 15 WHEN 9 THEN 'pkg.' WHEN 10 THEN '' WHEN 11 THEN '' ELSE 'Foo' END AS receiver_key FROM fx3_names""")
def j1_receiver_key(spark, sf_dir):
    n = fx(spark, sf_dir, "fx3_names")
    return n.select("name_id", D.receiver_key("receiver").alias("receiver_key"))


# --- J1 / J13 ---------------------------------------------------------------
@query("j1_owner_methods", oracle=DECLS_SQL + """
SELECT s.file_id, s.name AS owner, m.name AS method, m.file_id AS method_file
FROM d s JOIN d m ON m.kind = 'method' AND m.receiver_key = s.name
  AND regexp_extract(m.path, '^(.*)/[^/]*$', 1) = regexp_extract(s.path, '^(.*)/[^/]*$', 1)
WHERE s.kind = 'struct'""")
def j1_owner_methods(spark, sf_dir):
    owners, meths = owners_and_methods(spark, sf_dir)
    return D.owner_methods(owners.filter(F.col("kind") == "struct"), meths, how="inner").select("file_id", "owner", "method", "method_file")


J1_SQL = DECLS_SQL + """
, w AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS package FROM d)
, o AS (SELECT * FROM w WHERE kind IN ('struct', 'interface', 'type', 'functype'))
, m AS (SELECT file_id AS method_file, package, receiver_key AS owner, name AS method FROM w WHERE kind = 'method')
"""


def owners_and_methods(spark, sf_dir):
    """All named types with their package, and all methods by package and receiver key."""
    d = fx1_decls(spark, sf_dir).filter(F.col("kind").isin("struct", "interface", "type", "functype", "method")).select(*K, "kind", "name", "receiver_key")
    # read twice below
    d = kept(d.join(fx(spark, sf_dir, "fx1_files").select(*K, dir_of("path").alias("package")).hint("merge"), K))
    return (d.filter(F.col("kind") != "method").select("package", F.col("name").alias("owner"), *K, "kind"),
            d.filter(F.col("kind") == "method").select("package", F.col("receiver_key").alias("owner"), F.col("name").alias("method"),
                                                       F.col("file_id").alias("method_file")))


@query("j1_types_and_methods", oracle=J1_SQL + "SELECT o.file_id, o.kind, o.name AS owner, m.method, m.method_file FROM o LEFT JOIN m ON m.package = o.package AND m.owner = o.name")
def j1_types_and_methods(spark, sf_dir):
    return D.owner_methods(*owners_and_methods(spark, sf_dir)).select(*K, "kind", "owner", "method", "method_file")


@query("j1_types_with_methods", oracle=J1_SQL + "SELECT file_id, kind, name AS owner FROM o WHERE (package, name) IN (SELECT package, owner FROM m WHERE owner IS NOT NULL)")
def j1_types_with_methods(spark, sf_dir):
    return D.owner_methods(*owners_and_methods(spark, sf_dir), how="left_semi").select(*K, "kind", "owner")


@query("j13_priority_owner", oracle=DECLS_SQL + """
SELECT m.file_id, m.name AS method,
  CASE WHEN EXISTS (SELECT 1 FROM d s WHERE s.kind = 'struct' AND s.name = m.receiver_key AND regexp_extract(s.path, '^(.*)/[^/]*$', 1) = regexp_extract(m.path, '^(.*)/[^/]*$', 1)) THEN 'struct'
       WHEN EXISTS (SELECT 1 FROM d s WHERE s.kind = 'type' AND s.name = m.receiver_key AND regexp_extract(s.path, '^(.*)/[^/]*$', 1) = regexp_extract(m.path, '^(.*)/[^/]*$', 1)) THEN 'type' END AS owner_kind
FROM d m WHERE m.kind = 'method'""")
def j13_priority_owner(spark, sf_dir):
    d = fx1_decls(spark, sf_dir)
    files = fx(spark, sf_dir, "fx1_files").select(*K, dir_of("path").alias("package"))
    # read three times below
    d = kept(d.filter(F.col("kind").isin("method", "struct", "type")).select(*K, "kind", "name", "receiver_key").join(files.hint("merge"), K))
    meths = d.filter(F.col("kind") == "method").select(*K, "package", F.col("name").alias("method"),
                                                       F.col("receiver_key").alias("owner"))
    s = d.filter(F.col("kind") == "struct").select("package", F.col("name").alias("owner"), F.lit("struct").alias("s_kind")).distinct()
    t = d.filter(F.col("kind") == "type").select("package", F.col("name").alias("owner"), F.lit("type").alias("t_kind")).distinct()
    return meths.join(s.hint("merge"), ["package", "owner"], "left").join(t.hint("merge"), ["package", "owner"], "left") \
        .select(*K, "method", F.coalesce("s_kind", "t_kind").alias("owner_kind"))


# --- E7 / A3 ----------------------------------------------------------------
@query("e7_imports", oracle=cte("fx1_files") + """
SELECT file_id, CAST(v.ln AS BIGINT) AS line_no, CAST(v.pos AS BIGINT) AS pos, v.alias,
  CASE v.pos WHEN 0 THEN 'fmt' WHEN 1 THEN regexp_extract(content, 'al "([^"]*)"', 1) ELSE 'github.com/acme/lib' || CAST(file_id % 3 AS VARCHAR) END AS import_path, '' AS doc
FROM fx1_files, (VALUES (7, 0, ''), (8, 1, 'al'), (9, 2, '')) v(ln, pos, alias)""")
def e7_imports(spark, sf_dir):
    ln = L.lines(D.import_part(fx(spark, sf_dir, "fx1_files")), K, partition=text_tasks(spark, sf_dir, "fx1_files"))
    return D.imports(ln, K).select(*K, "line_no", "pos", "alias", "import_path", "doc")


@query("a3_import_block", oracle=cte("fx7_imports") + """
, first AS (SELECT file_id, import_path, arg_min(alias, [CAST(pos AS VARCHAR), alias]) AS alias FROM fx7_imports GROUP BY 1, 2)
, n AS (SELECT file_id, count(*) AS n, arg_min(alias, [CAST(pos AS VARCHAR), alias]) AS a1, arg_min(import_path, [CAST(pos AS VARCHAR), alias]) AS p1 FROM fx7_imports GROUP BY 1)
, body AS (SELECT file_id, string_agg(CASE WHEN alias <> '' THEN chr(9) || alias || ' "' || import_path || '"' || chr(10) ELSE chr(9) || '"' || import_path || '"' || chr(10) END, ''
           ORDER BY contains(import_path, '/'), import_path) AS body FROM first GROUP BY 1)
SELECT n.file_id, CASE WHEN n.n = 1 THEN CASE WHEN a1 <> '' THEN 'import ' || a1 || ' "' || p1 || '"' ELSE 'import "' || p1 || '"' END
                       ELSE 'import (' || chr(10) || body.body || ')' END AS import_block
FROM n JOIN body USING (file_id)""")
def a3_import_block(spark, sf_dir):
    imp = fx(spark, sf_dir, "fx7_imports")
    return A.import_block(imp, K)


# --- E8 / A5 / A6 -----------------------------------------------------------
def fx1_fields(spark, sf_dir):
    return D.fields(fx1_nodes(spark, sf_dir, "type"), K)


FIELD_VALUES = """(VALUES (17, 'Name', 'string', 'json:"name,omitempty" yaml:"name"', 'Name is the name.', true),
 (18, 'Price', 'float64', 'json:"price"', '', true), (19, 'secret', 'int', '', '', false),
 (20, 'Tags', '[]string', 'json:"tags"', '', true), (21, 'Ref', '*al.Item', '', '', true)) v(ln, name, type_text, tag, doc, exported)"""


@query("e8_fields", oracle=cte("fx1_files") + f"""
SELECT file_id, 'Part' || CAST(file_id AS VARCHAR) AS owner, CAST(v.ln AS BIGINT) AS line_no, v.name, v.type_text, v.tag,
       v.doc AS member_doc, v.exported, false AS embedded, CAST(0 AS BIGINT) AS depth FROM fx1_files, {FIELD_VALUES}""")
def e8_fields(spark, sf_dir):
    f = fx1_fields(spark, sf_dir)
    return f.select(*K, "owner", "line_no", "name", "type_text", "tag", "member_doc", "exported", "embedded",
                    F.col("depth").cast("long").alias("depth"))


@query("a5_tag_presence", oracle=cte("fx1_files") + "SELECT file_id, 'Part' || CAST(file_id AS VARCHAR) AS owner, true AS has_tags FROM fx1_files")
def a5_tag_presence(spark, sf_dir):
    return A.tag_presence(fx1_fields(spark, sf_dir), K)


@query("a6_undocumented", oracle=cte("fx1_files") + "SELECT file_id, 'Part' || CAST(file_id AS VARCHAR) AS owner, 'Price,Tags,Ref' AS undocumented FROM fx1_files")
def a6_undocumented(spark, sf_dir):
    return A.undocumented(fx1_fields(spark, sf_dir), K)


@query("e15_tag_value", oracle=cte("fx9_types") + """
SELECT decl_id, pos, tag, 'n' || CAST(pos AS VARCHAR) || CASE WHEN pos % 2 = 0 THEN ',omitempty' ELSE '' END AS json, 'y' AS yaml, '' AS xml
FROM fx9_types""")
def e15_tag_value(spark, sf_dir):
    t = fx(spark, sf_dir, "fx9_types")
    return t.select("decl_id", "pos", "tag", D.tag_value("tag", "json").alias("json"),
                    D.tag_value("tag", "yaml").alias("yaml"), D.tag_value("tag", "xml").alias("xml"))


# --- E9 / E10 ---------------------------------------------------------------
@query("e10_const_values", oracle=cte("fx8_consts") + """
, w AS (SELECT group_id, pos, name, expr,
          CAST(row_number() OVER (PARTITION BY group_id ORDER BY pos, expr NULLS LAST, name) - 1 AS BIGINT) AS iota,
          last_value(expr IGNORE NULLS) OVER (PARTITION BY group_id ORDER BY pos, expr NULLS LAST, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eff_expr
        FROM fx8_consts)
SELECT group_id, pos, name, iota, eff_expr,
  CASE WHEN regexp_full_match(eff_expr, '[0-9]+') THEN CAST(eff_expr AS BIGINT)
       WHEN regexp_full_match(eff_expr, 'iota \\+ [0-9]+') THEN iota + CAST(regexp_extract(eff_expr, '[0-9]+$') AS BIGINT)
       WHEN regexp_full_match(eff_expr, '[0-9]+ << iota') THEN CAST(regexp_extract(eff_expr, '^[0-9]+') AS BIGINT) << iota END AS v
FROM w""".replace("SELECT group_id, pos, name, iota, eff_expr,", "SELECT group_id, pos, name, iota, eff_expr, CAST(v AS VARCHAR) AS value FROM (SELECT group_id, pos, name, iota, eff_expr,") + ")")
def e10_const_values(spark, sf_dir):
    c = fx(spark, sf_dir, "fx8_consts")
    # order inside a group: position, then expression (nulls last), then name
    c = c.withColumn("__ord", F.struct("pos", F.col("expr").isNull().alias("n"), "expr", "name"))
    out = D.const_values(c, ["group_id"], "__ord", "expr")
    # value as text: null when the expression is not one of the evaluated forms
    return out.select("group_id", "pos", "name", "iota", "eff_expr", F.col("value").cast("string").alias("value"))


@query("e9_var_specs", oracle=cte("fx1_files") + """
SELECT file_id, v.name || CAST(file_id AS VARCHAR) AS name, CAST(v.ln AS BIGINT) AS line_no, v.kind, v.doc, v.exported
FROM fx1_files, (VALUES ('A', 35, 'const', 'A is first.', true), ('B', 36, 'const', '', true), ('c', 37, 'const', '', false),
                       ('x', 40, 'var', '', false), ('Y', 40, 'var', '', true)) v(name, ln, kind, doc, exported)""")
def e9_var_specs(spark, sf_dir):
    return D.value_specs(fx1_nodes(spark, sf_dir, "var", "const"), K)


# --- E11 --------------------------------------------------------------------
def fx1_interfaces(spark, sf_dir):
    return D.interface_members(fx1_nodes(spark, sf_dir, "type"), K)


@query("e11_interface_methods", oracle=cte("fx1_files") + """
SELECT file_id, 'Shape' || CAST(file_id AS VARCHAR) AS owner, 'Area' AS name, '(scale float64) float64' AS signature FROM fx1_files""")
def e11_interface_methods(spark, sf_dir):
    return fx1_interfaces(spark, sf_dir)[0].select(*K, "owner", "name", "signature")


@query("e11_type_set", oracle=cte("fx1_files") + """
SELECT file_id, 'Shape' || CAST(file_id AS VARCHAR) AS owner, v.term, CAST(v.pos AS BIGINT) AS pos
FROM fx1_files, (VALUES ('~int', 0), ('string', 1)) v(term, pos)""")
def e11_type_set(spark, sf_dir):
    return fx1_interfaces(spark, sf_dir)[1].select(*K, "owner", "term", "pos")


# --- E12 / A7 / X10 ---------------------------------------------------------
def fx1_params(spark, sf_dir):
    d = fx1_decls(spark, sf_dir)
    s = D.signature_parts(d.filter(F.col("kind").isin("func", "method", "functype")))
    out = D.param_rows(D.signature_lists(s, K), K, carry=["kind", "decl_name"])
    return d, out


PARAM_VALUES = """(VALUES (25, 'receiver', 0, 'p', '*Part#'), (25, 'param', 0, 'a', 'int'), (25, 'param', 1, 'b', 'int'),
 (25, 'param', 2, 'f', 'al.Item'), (25, 'result', 0, '', 'float64'), (25, 'result', 1, '', 'error'),
 (29, 'result', 0, '', '*Part#'), (47, 'param', 0, '', 'al.Item'), (47, 'result', 0, '', 'error')) v(dl, role, pos, name, type_text)"""


@query("e12_params", oracle=cte("fx1_files") + f"""
SELECT file_id, CAST(v.dl AS BIGINT) AS decl_line, v.role, CAST(v.pos AS BIGINT) AS pos, v.name,
       replace(v.type_text, '#', CAST(file_id AS VARCHAR)) AS type_text FROM fx1_files, {PARAM_VALUES}""")
def e12_params(spark, sf_dir):
    p = fx1_params(spark, sf_dir)[1]
    return p.filter(F.col("pos").isNotNull()).select(*K, "decl_line", "role", "pos", "name", "type_text")


@query("a7_signatures", oracle=cte("fx1_files") + """
SELECT file_id, CAST(v.dl AS BIGINT) AS decl_line, v.kind, replace(v.name, '#', CAST(file_id AS VARCHAR)) AS name,
       replace(v.sig, '#', CAST(file_id AS VARCHAR)) AS signature
FROM fx1_files, (VALUES (25, 'method', 'Total', 'func (p *Part#) Total(a int, b int, f al.Item) (float64, error)'),
                       (29, 'func', 'New#', 'func New#() *Part#'), (47, 'functype', 'Handler#', 'type Handler# func(al.Item) error')) v(dl, kind, name, sig)""")
def a7_signatures(spark, sf_dir):
    return A.signatures(fx1_params(spark, sf_dir)[1], K)


@query("x10_type_params", oracle=cte("fx9_types") + """
SELECT decl_id, '[' || string_agg(CASE WHEN pos % 3 = 0 THEN 'T' || CAST(pos AS VARCHAR) ELSE 'T' || CAST(pos AS VARCHAR) || ' ' || type_text END, ', ' ORDER BY pos, type_text) || ']' AS tparams
FROM fx9_types GROUP BY decl_id""")
def x10_type_params(spark, sf_dir):
    from ..functions.text import format_type_params
    t = fx(spark, sf_dir, "fx9_types")
    p = t.select("decl_id", "pos", F.concat(F.lit("T"), F.col("pos").cast("string")).alias("name"),
                 F.when(F.col("pos") % 3 == 0, F.lit("")).otherwise(F.col("type_text")).alias("type_text"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct("pos", "type_text", "name"))),
                      lambda x: F.struct(x["name"].alias("name"), x["type_text"].alias("type_text")))
    return p.groupBy("decl_id").agg(format_type_params(arr).alias("tparams"))


# --- varied shapes (Fx12) -----------------------------------------------------
def fx12_nodes(spark, sf_dir, *words, text=False):
    return nodes(fx(spark, sf_dir, "fx12_files"), K, text=text, words=words or DECLS)


def _shapes(what: str, columns: str) -> str:
    return cte("fx12_files") + rows_sql(what, columns)


def _id(column: str) -> str:
    return f"replace({column}, '#', CAST(file_id AS VARCHAR)) AS {column}"


@query("e6_declaration_shapes", oracle=_shapes("decls", "l, e, kind, name, decl, doc, exported, receiver_key") + f"""
SELECT file_id, base + l AS decl_line, base + e AS end_line, kind, {_id('name')}, {_id('decl')}, {_id('doc')}, exported, {_id('receiver_key')} FROM wanted""")
def e6_declaration_shapes(spark, sf_dir):
    d, _ = D.declarations(fx12_nodes(spark, sf_dir, text=True), K)
    return d.select(*K, "decl_line", "end_line", "kind", "name", "decl", "doc", "exported", "receiver_key")


@query("q1_declaration_rejects", oracle=_shapes("bad", "l, message") + "SELECT file_id, base + l AS decl_line, message FROM wanted")
def q1_declaration_rejects(spark, sf_dir):
    return D.declaration_rejects(fx12_nodes(spark, sf_dir), K).select(*K, "decl_line", "message")


@query("q1_member_rejects", oracle=_shapes("odd", "l, message") + "SELECT file_id, base + l AS decl_line, message FROM wanted")
def q1_member_rejects(spark, sf_dir):
    return D.member_rejects(fx12_nodes(spark, sf_dir, "type"), K).select(*K, "decl_line", "message")


@query("e8_field_shapes", oracle=_shapes("fields", "l, owner, depth, struct_path, name, type_text, tag, member_doc, exported, embedded, anonymous") + f"""
SELECT file_id, base + l AS line_no, {_id('owner')}, CAST(depth AS BIGINT) AS depth, struct_path, name, {_id('type_text')}, tag, member_doc, exported, embedded, anonymous FROM wanted""")
def e8_field_shapes(spark, sf_dir):
    f = D.fields(fx12_nodes(spark, sf_dir, "type"), K)
    return f.select(*K, "line_no", "owner", F.col("depth").cast("long").alias("depth"), "struct_path", "name", "type_text", "tag",
                    "member_doc", "exported", "embedded", "anonymous")


@query("a5_tag_shapes", oracle=_shapes("tags", "owner, has_tags") + f"SELECT file_id, {_id('owner')}, has_tags FROM wanted")
def a5_tag_shapes(spark, sf_dir):
    return A.tag_presence(D.fields(fx12_nodes(spark, sf_dir, "type"), K), K)


@query("a8_example_shapes", oracle=_shapes("examples", "owner, example_json") + f"SELECT file_id, {_id('owner')}, example_json FROM wanted")
def a8_example_shapes(spark, sf_dir):
    own = kept(fx12_nodes(spark, sf_dir, text=True))
    owners = D.declarations(own, K)[0].filter(F.col("kind") == "struct").select(*K, F.col("decl_line").alias("owner_line"), F.col("name").alias("owner"))
    return EX.example_json(D.fields(own, K), K, owners)


@query("a9_example_shapes", oracle=_shapes("yaml", "owner, example_yaml") + f"SELECT file_id, {_id('owner')}, example_yaml FROM wanted")
def a9_example_shapes(spark, sf_dir):
    own = kept(fx12_nodes(spark, sf_dir, "type", text=True))
    owners = D.declarations(own, K)[0].filter(F.col("kind") == "struct").select(*K, F.col("decl_line").alias("owner_line"), F.col("name").alias("owner"))
    return EX.example_yaml(D.fields(own, K), K, owners)


@query("e9_spec_shapes", oracle=_shapes("specs", "l, kind, name, exported") + f"SELECT file_id, base + l AS line_no, kind, {_id('name')}, exported FROM wanted")
def e9_spec_shapes(spark, sf_dir):
    return D.value_specs(fx12_nodes(spark, sf_dir, "var", "const"), K).select(*K, "line_no", "kind", "name", "exported")


@query("e11_member_shapes", oracle=_shapes("members", "owner, what, pos, member") + f"SELECT file_id, {_id('owner')}, what, CAST(pos AS BIGINT) AS pos, member FROM wanted")
def e11_member_shapes(spark, sf_dir):
    m, t = D.interface_members(fx12_nodes(spark, sf_dir, "type"), K)
    turn = Window.partitionBy(*K, "owner_line").orderBy("node")
    m = m.select(*K, "owner", F.lit("method").alias("what"), (F.row_number().over(turn) - 1).cast("long").alias("pos"),
                 F.concat("name", "signature").alias("member"))
    return m.unionByName(t.select(*K, "owner", F.lit("term").alias("what"), "pos", F.col("term").alias("member")))


@query("a7_signature_shapes", oracle=_shapes("signatures", "l, signature") + f"SELECT file_id, base + l AS decl_line, {_id('signature')} FROM wanted")
def a7_signature_shapes(spark, sf_dir):
    own = kept(fx12_nodes(spark, sf_dir, text=True))
    one = [*K, "node"]  # several may stand on a line
    heads = [*one, "decl_line", "kind", "name", "decl"]
    d = D.declarations(own, K)[0].filter(F.col("kind").isin("func", "method", "functype")).select(heads)
    m = D.method_heads(D.interface_members(own, K)[0]).select(heads)
    parts = D.signature_parts(d.unionByName(m))
    return A.signatures(D.param_rows(D.signature_lists(parts, one), one, carry=["kind", "decl_name"]), one).select(*K, "decl_line", "signature")


# --- E13 / E14 (Fx9) --------------------------------------------------------
@query("e13_type_shape", oracle=cte("fx9_types") + """
SELECT decl_id, pos, type_text,
  CASE WHEN starts_with(type_text, '*') THEN 'pointer' WHEN starts_with(type_text, '...') THEN 'ellipsis'
       WHEN starts_with(type_text, '[]') THEN 'slice' WHEN starts_with(type_text, '[3]') THEN 'array'
       WHEN starts_with(type_text, 'map[') THEN 'map' WHEN starts_with(type_text, '<-chan') THEN 'chan'
       WHEN type_text = 'al.Box[T]' THEN 'index' WHEN type_text = 'al.Item' THEN 'selector' ELSE 'ident' END AS kind,
  CASE WHEN starts_with(type_text, '*') THEN substr(type_text, 2) WHEN starts_with(type_text, '...') THEN substr(type_text, 4)
       WHEN starts_with(type_text, '[]') THEN substr(type_text, 3) WHEN starts_with(type_text, '[3]') THEN substr(type_text, 4)
       WHEN starts_with(type_text, 'map[string]') THEN substr(type_text, 12) WHEN starts_with(type_text, '<-chan ') THEN substr(type_text, 8) END AS elem,
  CASE WHEN starts_with(type_text, 'map[') THEN 'string' END AS key
FROM fx9_types""")
def e13_type_shape(spark, sf_dir):
    t = fx(spark, sf_dir, "fx9_types")
    return t.select("decl_id", "pos", "type_text", D.type_kind("type_text").alias("kind"),
                    D.type_element("type_text").alias("elem"), D.type_key("type_text").alias("key"))


@query("e14_type_refs", oracle=cte("fx9_types") + """
, r AS (SELECT decl_id, pos, type_text, list_filter(regexp_extract_all(type_text, '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)?'),
               lambda s: s NOT IN ('map', 'chan', 'func', 'struct', 'interface')) AS refs FROM fx9_types)
SELECT decl_id, pos, CAST(unnest(range(0, len(refs))) AS BIGINT) AS ref_pos, unnest(refs) AS ref FROM r""")
def e14_type_refs(spark, sf_dir):
    t = fx(spark, sf_dir, "fx9_types")
    return D.type_refs(t, ["decl_id", "pos"], "type_text").select("decl_id", "pos", "ref_pos", "ref")
