"""Queries for linked types, signatures and owners (Fx13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import cte, fx
from ..operators import aggregates as A
from ..operators import decls as D
from ..operators import lines as L
from ..operators import links as LK
from ..operators import refs as R
from ..operators.tree import nodes
from ..shapes import link_rows_sql
from ..sources.sinks import kept
from .catalog import query
from .queries_modules import module_table

K = ["file_id"]
ONE = ["file_id", "node"]


def _own():
    return F.concat(F.lit("example.com/m"), (F.col("file_id") % 25).cast("string"), F.lit("/p"))


def _wanted(what: str, columns: str = "l, t") -> str:
    return cte("fx13_files") + link_rows_sql(what, columns)


def _parsed(spark, sf_dir):
    """Node table and declarations of Fx13, computed once for all that reads them."""
    n = kept(nodes(fx(spark, sf_dir, "fx13_files"), K, text=True, words=("type", "func")))
    return n, kept(D.declarations(n, K)[0].drop("full_decl"))


def _aliases(spark, sf_dir):
    return kept(R.alias_map(D.imports(L.lines(D.import_part(fx(spark, sf_dir, "fx13_files")), K, partition=False), K, docs=False), K))


def _signature_params(spark, sf_dir, mode, separate=False, html=False):
    n, d = _parsed(spark, sf_dir)
    return LK.signature_params(n, d, K, K, _aliases(spark, sf_dir), module_table(spark, sf_dir), _own(), mode, separate, html)


def _register(name: str, mode: str, separate: bool = False) -> None:
    @query(f"j8_signatures_{name}", oracle=_wanted(name) + "SELECT file_id, l AS decl_line, t AS signature FROM wanted")
    def run(spark, sf_dir):
        return A.signatures(_signature_params(spark, sf_dir, mode, separate), ONE).select(*K, "decl_line", "signature")


for _name, _mode, _separate in (("off", "off", False), ("internal", "internal", False), ("external", "external", False), ("separate", "external", True)):
    _register(_name, _mode, _separate)


@query("j8_field_headings", oracle=_wanted("headings") + "SELECT file_id, l AS line_no, t AS heading FROM wanted")
def j8_field_headings(spark, sf_dir):
    n, d = _parsed(spark, sf_dir)
    f = kept(D.fields(n, K).select(*K, "owner", "line_no", "name_pos", "name", "type_text"))
    scope = LK.names_of(LK.type_params(d).select(*K, F.col("name").alias("owner"), "type_params"), "type_params").select(*K, "owner", "name")
    out = LK.linked_texts(f, [*K, "name_pos"], "type_text", K, _aliases(spark, sf_dir), module_table(spark, sf_dir), _own(), scope, [*K, "owner"])
    return out.select(*K, "line_no", F.when(F.col("name") == "", F.col("linked")).otherwise(F.concat_ws("\t", "name", "linked")).alias("heading"))


@query("j13_owner_type_params", oracle=_wanted("owners", "l, t, owner_kind, owner_params") + "SELECT file_id, l AS decl_line, t AS method, owner_kind, owner_params FROM wanted")
def j13_owner_type_params(spark, sf_dir):
    d = kept(D.declarations(nodes(fx(spark, sf_dir, "fx13_files"), K, text=True, words=("type", "func")), K)[0].select(*K, "decl_line", "kind", "name", "decl", "receiver_key"))
    out = LK.owner_type_params(d.filter(F.col("kind") == "method"), LK.type_params(d), K)
    return out.select(*K, "decl_line", F.col("name").alias("method"), "owner_kind", "owner_params")


def _blocks(spark, sf_dir):
    pieces = A.signature_pieces(_signature_params(spark, sf_dir, "external", html=True), ONE)
    return LK.signature_tokens(pieces).withColumn("blocks", LK.highlight_blocks(F.col("tokens"), F.col("kind")))


@query("w2_signature_markup", oracle=_wanted("markup") + "SELECT file_id, l AS decl_line, t AS markup FROM wanted")
def w2_signature_markup(spark, sf_dir):
    return _blocks(spark, sf_dir).select(*K, "decl_line", LK.block_markup(F.col("blocks")).alias("markup"))


@query("w2_signature_blocks", oracle=_wanted("markup") + """
, parts AS (SELECT file_id, l, t, regexp_extract_all(t, '<span class="hljs-(keyword|title|params|type)">', 1) AS classes,
            CAST(contains(t, 'hljs-function') AS INTEGER) AS wraps FROM wanted)
SELECT file_id, l AS decl_line, len(classes) AS n_classed, list_filter(classes, lambda c: c = 'params') = ['params', 'params'] AS with_receiver, wraps FROM parts""")
def w2_signature_blocks(spark, sf_dir):
    blocks = F.col("blocks")
    classes = blocks["class"]
    wrapped = F.filter(blocks, lambda b: b["wrapper"] != "")["block"]
    return _blocks(spark, sf_dir).select(
        *K, "decl_line", F.size(F.filter(classes, lambda c: c != "")).cast("long").alias("n_classed"),
        (F.size(F.filter(classes, lambda c: c == "hljs-params")) == 2).alias("with_receiver"), F.size(F.array_distinct(wrapped)).alias("wraps"))
