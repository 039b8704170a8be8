"""Ordered aggregations.

Ordered string concatenation is ``collect_list(struct(order…, value))`` +
``array_sort`` inside one group; only small per-owner lists (members of one
declaration, imports of one file) are collected.  Package-level aggregates
collect per-file summaries (doc, tags), never file content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decls import tag_value


def ordered_join(order: Sequence[Column | str], value: Column | str, sep: str) -> Column:
    """Aggregate: ``value`` of the group concatenated with ``sep`` in ``order``.

    Rows whose value is null are not collected at all (``collect_list``
    skips nulls), so a sparse value costs nothing for the rows without it.
    """
    vals = [F.col(c) if isinstance(c, str) else c for c in order]
    v = F.col(value) if isinstance(value, str) else value
    s = F.when(v.isNotNull(), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(vals)], v.alias("v")))
    # sort_array compares natively (array_sort by an interpreted function); no struct is null, so their orders are the same
    return F.array_join(F.sort_array(F.collect_list(s))["v"], sep)


# --- A2 ---------------------------------------------------------------------
def package_aggregate(files: DataFrame, dir_col: str = "dir") -> DataFrame:
    """Per directory: first file's package name, docs joined by newline in path
    order, sorted distinct build tags, summed member counts.

    ``files``: ``dir, path, package, doc, tags ARRAY<STRING>, n_decls``.
    Build tags are made distinct per directory before they are collected, so
    a directory with very many files collects only its distinct tags.
    """
    tags = files.select(dir_col, F.explode("tags").alias("__t")).distinct() \
        .groupBy(dir_col).agg(F.array_join(F.array_sort(F.collect_list("__t")), ",").alias("build_tags"))
    main = files.groupBy(dir_col).agg(
        F.min_by("package", "path").alias("package"),
        ordered_join(["path"], F.when(F.col("doc") != "", F.col("doc")), "\n").alias("doc"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum("n_decls").cast("long").alias("n_decls"),
    )
    return main.join(tags.hint("merge"), dir_col, "left").withColumn("build_tags", F.coalesce("build_tags", F.lit("")))


def package_doc_rows(files: DataFrame, dir_col: str = "dir") -> DataFrame:
    """A2 doc in row form for packages too large for one string: one row per
    non-empty file doc with its order key; write it with the S4 sink
    (``write_per_group(rows, out, ["path"], group_col=dir_col, text_col="doc")``),
    which splits a large package over several ordered part files."""
    return files.filter(F.col("doc") != "").select(dir_col, "path", "doc")


# --- A3 ---------------------------------------------------------------------
def import_block(imports: DataFrame, key: Sequence[str]) -> DataFrame:
    """Import block text per file: distinct by path (first alias wins), paths
    without ``/`` first then lexical; one import uses the single-line form."""
    first = imports.groupBy(*key, "import_path").agg(
        F.min_by("alias", F.struct("pos", "alias")).alias("alias"))
    n = imports.groupBy(*key).agg(F.count(F.lit(1)).alias("n"),
                                  F.min_by(F.struct("alias", "import_path"), F.struct("pos", "alias")).alias("one"))
    line = F.when(F.col("alias") != "", F.format_string('\t%s "%s"\n', "alias", "import_path")) \
        .otherwise(F.format_string('\t"%s"\n', "import_path"))
    body = first.groupBy(*key).agg(
        ordered_join([F.col("import_path").contains("/"), F.col("import_path")], line, "").alias("body"))
    single = F.when(F.col("one.alias") != "", F.format_string('import %s "%s"', "one.alias", "one.import_path")) \
        .otherwise(F.format_string('import "%s"', "one.import_path"))
    return n.join(body, list(key)).select(
        *key, F.when(F.col("n") == 1, single).otherwise(F.concat(F.lit("import (\n"), "body", F.lit(")")))
        .alias("import_block"))


# --- A4 ---------------------------------------------------------------------
DECL_KINDS = ["struct", "interface", "type", "functype", "func", "method", "var", "const"]


def kind_totals(decls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Declarations per kind as columns (pivot with fixed values: no extra job)."""
    return decls.groupBy(*by).pivot("kind", DECL_KINDS).agg(F.count(F.lit(1))).na.fill(0, DECL_KINDS)


# --- A5 / A6 ----------------------------------------------------------------
def tag_presence(fields: DataFrame, key: Sequence[str], names: Sequence[str] = ("json", "yaml")) -> DataFrame:
    """Whether a member of the owner has a tag with one of the keys ``names``."""
    tagged = F.lit(False)
    for name in names:
        tagged = tagged | (tag_value(F.coalesce("tag", F.lit("")), name) != "")
    return fields.groupBy(*key, "owner").agg(F.bool_or(tagged).alias("has_tags"))


def undocumented(fields: DataFrame, key: Sequence[str]) -> DataFrame:
    """Visible top-level members with an empty doc, in declaration order."""
    u = fields.filter(F.col("exported") & (F.col("member_doc") == "") & (F.col("depth") == 0)
                      & ~F.coalesce(F.col("anonymous"), F.lit(False)))
    name = F.when(F.col("name") == "", F.col("type_text")).otherwise(F.col("name"))
    return u.groupBy(*key, "owner").agg(ordered_join(["line_no", "name_pos"], name, ",").alias("undocumented"))


# --- A7 ---------------------------------------------------------------------
def _plist(role: str) -> Column:
    item = F.when(F.col("name") == "", F.col("type_text")).otherwise(F.concat_ws(" ", "name", "type_text"))
    return ordered_join(["pos"], F.when((F.col("role") == role) & F.col("pos").isNotNull(), item), ", ")


def signature_pieces(params: DataFrame, key: Sequence[str]) -> DataFrame:
    """``kind, name`` and the lists of each declaration as text (``recv, tparams, params, results``) with the number of results, from E12 rows.

    ``params`` carries ``kind`` and ``decl_name`` and has at least one row per
    declaration (null ``pos`` for an empty list), so one aggregation per
    declaration builds the text — no join back to the declarations.
    """
    return params.groupBy(*key, "decl_line").agg(
        F.first("kind").alias("kind"), F.first("decl_name").alias("name"),
        _plist("receiver").alias("recv"), _plist("type_param").alias("tparams"), _plist("param").alias("params"), _plist("result").alias("results"),
        F.sum(F.when((F.col("role") == "result") & F.col("pos").isNotNull(), 1).otherwise(0)).alias("n_res"))


def signatures(params: DataFrame, key: Sequence[str]) -> DataFrame:
    """Signature text of func / method / functype declarations and interface methods from their E12 rows,
    type params included: ``func (r T) Name[K any](…) …``, ``type Name func(…) …``, ``Name(…) …``."""
    agg = signature_pieces(params, key)
    return agg.select(*key, "decl_line", "kind", "name", signature_text().alias("signature"))


def signature_text() -> Column:
    """The signature from the columns of :func:`signature_pieces`."""
    res = F.when(F.col("n_res") == 0, F.lit("")) \
        .when(F.col("n_res") == 1, F.concat(F.lit(" "), "results")) \
        .otherwise(F.concat(F.lit(" ("), "results", F.lit(")")))
    recv = F.when(F.col("recv") != "", F.concat(F.lit("("), "recv", F.lit(") "))).otherwise("")
    named = F.concat("name", F.when(F.col("tparams") != "", F.concat(F.lit("["), "tparams", F.lit("]"))).otherwise(""))
    rest = F.concat(F.lit("("), "params", F.lit(")"), res)
    return F.when(F.col("kind") == "functype", F.concat(F.lit("type "), named, F.lit(" func"), rest)) \
        .when(F.col("kind") == "interface_method", F.concat(named, rest)) \
        .otherwise(F.concat(F.lit("func "), recv, named, rest))
