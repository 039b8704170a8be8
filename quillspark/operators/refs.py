"""References between files, packages and declarations.

All lookups are joins: the alias map is a per-file lookup table (not a MAP
column), module membership is the boundary-aware equi-join of
:mod:`.modules`, and a rewritten doc is re-assembled from its literal pieces
and resolved tokens with one ordered aggregation per doc.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import anchor_id, relative_path
from .modules import explode_slash_prefixes

# Builtin type names (never linked).
BUILTIN_TYPES = ["bool", "byte", "complex64", "complex128", "error", "float32", "float64", "int", "int8", "int16",
                 "int32", "int64", "rune", "string", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr", "any"]

TOKEN_RX = r"`([^`]+)`"
EXTERNAL_DOC_URL = "https://pkg.go.dev/"


# --- J7 ---------------------------------------------------------------------
def alias_map(imports: DataFrame, key: Sequence[str], pos_col: str = "pos") -> DataFrame:
    """Per file: ``alias_key → import_path``; keys are the explicit alias and the
    last path segment; ``.``/``_`` imports are skipped; the last import wins."""
    imp = imports.filter(~F.col("alias").isin(".", "_") & (F.col("import_path") != ""))
    by_alias = imp.filter(F.col("alias") != "").select(*key, F.col("alias").alias("alias_key"), "import_path",
                                                       F.col(pos_col).alias("__p"), F.lit(0).alias("__o"))
    by_base = imp.select(*key, F.substring_index("import_path", "/", -1).alias("alias_key"), "import_path",
                         F.col(pos_col).alias("__p"), F.lit(1).alias("__o"))
    return by_alias.unionByName(by_base).filter(F.col("alias_key") != "").groupBy(*key, "alias_key") \
        .agg(F.max_by("import_path", F.struct("__p", "__o", "import_path")).alias("import_path"))


# --- E16 --------------------------------------------------------------------
def doc_tokens(docs: DataFrame, key: Sequence[str], doc_col: str = "doc", keep: Sequence[str] = ()) -> DataFrame:
    """Each back-ticked token with its position; the token is split into
    ``pkg_path`` / ``alias`` / ``receiver`` / ``ident`` candidates (before resolution).
    ``keep`` columns of the doc row are carried along (no join back)."""
    # docs move by key before they are taken apart; the alias join on (key, alias)
    # and a second pass over the tokens use that partitioning
    src = docs.select(*dict.fromkeys([*key, *keep, doc_col])).repartition(*key)
    toks = src.select(*key, *keep, F.posexplode(F.regexp_extract_all(F.col(doc_col), F.lit(TOKEN_RX), 1))
                       .alias("tok_pos", "original"))
    t = F.trim(F.col("original"))
    parts = F.split(t, r"\.")
    n = F.size(parts)
    has_slash = t.contains("/")
    # a token with '/' splits at the first dot after its last slash
    last_slash = F.length(t) - F.locate("/", F.reverse(t)) + 1
    after = t.substr(last_slash, F.length(t))
    dot = F.locate(".", after)
    fq_path = F.when(dot == 0, t).otherwise(t.substr(F.lit(1), last_slash + dot - 2))
    rest = F.when(dot == 0, F.lit("")).otherwise(after.substr(dot + 1, F.length(after)))
    rest_has_dot = F.instr(rest, ".") > 0
    toks = toks.withColumn("token", t).withColumn("builtin", t.isin(*BUILTIN_TYPES)) \
        .withColumn("tok_pos", F.col("tok_pos").cast("long"))
    return toks.select(
        "*",
        F.when(has_slash, fq_path).alias("pkg_path"),
        F.when(has_slash, F.substring_index(fq_path, "/", -1))
        .when((n == 1) | (n > 3), F.lit("")).otherwise(parts[0]).alias("alias"),
        F.when(has_slash, F.when(rest_has_dot, F.substring_index(rest, ".", 1)).otherwise(F.lit("")))
        .when(n == 2, parts[0]).when(n == 3, parts[1]).otherwise(F.lit("")).alias("receiver"),
        F.when(has_slash, F.when(rest_has_dot, F.regexp_extract(rest, r"^[^.]*\.([^.]*)", 1)).otherwise(rest))
        .when(n == 1, parts[0]).when(n == 2, parts[1]).when(n == 3, parts[2]).otherwise(F.lit("")).alias("ident"),
    )


# --- J9 ---------------------------------------------------------------------
def resolve_refs(tokens: DataFrame, key: Sequence[str], aliases: DataFrame, own_package: str,
                 module_names: DataFrame) -> DataFrame:
    """Resolve tokens: alias lookups (J7), own-package fallback, internal flag (J4
    boundary form against ``module_names.name``), kind, link text."""
    am = aliases.select(*key, F.col("alias_key").alias("__lk"), F.col("import_path").alias("__p"))
    # one lookup per token: a single-part token is looked up as a whole, any
    # other token by its alias part (one join, one shuffle of the tokens)
    one = (F.col("alias") == "") & (F.col("receiver") == "")
    t = tokens.withColumn("__lk", F.when(F.col("pkg_path").isNull(), F.when(one, F.col("ident")).otherwise(F.col("alias")))) \
        .join(am, [*key, "__lk"], "left").drop("__lk")
    # flags are materialised first: the columns they read are rewritten below
    t = t.withColumn("__one", one) \
        .withColumn("__pkg_only", one & F.col("__p").isNotNull()) \
        .withColumn("__two_same", (F.col("alias") != "") & (F.col("alias") == F.col("receiver")) & F.col("pkg_path").isNull()) \
        .withColumn("__alias_hit", ~one & F.col("__p").isNotNull())
    pkg_only, two_same, alias_hit = F.col("__pkg_only"), F.col("__two_same"), F.col("__alias_hit")
    t = t.withColumn("alias", F.when(pkg_only, F.col("ident")).when(two_same & ~alias_hit, F.lit(""))
                     .otherwise(F.col("alias"))) \
        .withColumn("receiver", F.when(two_same & alias_hit, F.lit("")).otherwise(F.col("receiver"))) \
        .withColumn("ident", F.when(pkg_only, F.lit("")).otherwise(F.col("ident")))
    by_alias = F.when(F.col("alias") == "", F.lit(None)).when(alias_hit, F.col("__p")) \
        .when(~F.col("alias").rlike(r"[./]"), F.col("alias"))
    path = F.coalesce(F.col("pkg_path"), F.when(pkg_only, F.col("__p")), by_alias,
                      F.when(F.col("ident") != "", F.col(own_package)))
    t = t.withColumn("package_path", path)
    # internal flag: each distinct package path meets the module names by its
    # '/'-prefixes once, and one join brings the flag to the tokens
    names = module_names.select(F.col("name").alias("__pre")).distinct()
    paths = t.select(F.col("package_path").alias("__path")).filter("__path IS NOT NULL").distinct()
    known = explode_slash_prefixes(paths, "__path", "__pre").join(names, "__pre") \
        .select(F.col("__path").alias("package_path"), F.lit(True).alias("__int")).distinct()
    t = t.join(known, "package_path", "left")
    external = F.when(~F.col("package_path").rlike(r"[./]"), F.lit(True)) \
        .otherwise(~F.coalesce(F.col("__int"), F.lit(False)))
    kind = F.when(F.col("receiver") != "", "method").when(F.col("ident") == "", "package").otherwise("type")
    t = t.withColumn("external", external).withColumn("kind", kind)
    anchor = F.when(F.col("receiver") != "",
                    anchor_id(F.col("package_path"), F.concat_ws(".", "receiver", "ident"))) \
        .otherwise(anchor_id(F.col("package_path"), F.col("ident")))
    ext_link = F.when(F.col("kind") == "package",
                      F.format_string("link:" + EXTERNAL_DOC_URL + "%s[%s]", "package_path", "original")) \
        .when(F.col("receiver") != "",
              F.format_string("link:" + EXTERNAL_DOC_URL + "%s#%s.%s[%s]", "package_path", "receiver", "ident",
                              "original")) \
        .otherwise(F.format_string("link:" + EXTERNAL_DOC_URL + "%s#%s[%s]", "package_path", "ident", "original"))
    int_link = F.format_string("<<%s,%s>>", anchor, F.col("original"))
    link = F.when(F.col("builtin") | F.col("package_path").isNull(), F.lit(None)) \
        .when(F.col("external"), ext_link).otherwise(int_link)
    return t.withColumn("link", link).drop("__p", "__one", "__pkg_only", "__two_same", "__alias_hit", "__int")


# --- J10 --------------------------------------------------------------------
def rewrite_docs(docs: DataFrame, key: Sequence[str], resolved: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Replace every resolved token by its link; unresolved tokens stay as written."""
    links = resolved.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("tok_pos", F.coalesce("link", F.concat(F.lit("`"), "original", F.lit("`")))
                                             .alias("s")))).alias("__links"))
    d = docs.join(links, list(key), "left")
    lits = F.split(F.col(doc_col), TOKEN_RX, -1)
    toks = F.concat(F.coalesce(F.transform("__links", lambda x: x["s"]), F.array().cast("array<string>")),
                    F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(lits, toks, lambda a, b: F.concat(F.coalesce(a, F.lit("")),
                                                                         F.coalesce(b, F.lit("")))), "")
    return d.withColumn(doc_col + "_linked", F.when(F.col(doc_col).isNull(), None).otherwise(rebuilt)).drop("__links")


# --- J11 --------------------------------------------------------------------
def classify_package_refs(pkg_imports: DataFrame, package_info: DataFrame, module_names: DataFrame,
                          outfile: str | None = None) -> DataFrame:
    """Distinct imports per package → internal-known (anchor + document),
    internal (module member, derived document) or external (URL).
    With ``outfile`` a known package's document is given relative to that file's directory."""
    d = pkg_imports.select("package", "import_path").distinct()
    info = package_info.select(F.col("fq_package").alias("import_path"), F.col("anchor").alias("known_anchor"),
                               F.col("out_file").alias("known_file"))
    d = d.join(info, "import_path", "left")
    names = module_names.select(F.col("name").alias("__pre")).distinct()
    mem = explode_slash_prefixes(d.select("import_path").distinct(), "import_path", "__pre") \
        .join(names, "__pre", "left_semi").select("import_path").distinct().withColumn("__int", F.lit(True))
    d = d.join(mem, "import_path", "left")
    cls = F.when(F.col("known_anchor").isNotNull(), "internal-known") \
        .when(F.coalesce("__int", F.lit(False)), "internal").otherwise("external")
    known = F.col("known_file") if outfile is None else relative_path(F.lit(outfile.rpartition("/")[0]), F.col("known_file"))
    link = F.when(F.col("known_anchor").isNotNull(), known) \
        .when(F.coalesce("__int", F.lit(False)), F.concat(F.translate("import_path", "/\\", "__"), F.lit(".adoc"))) \
        .otherwise(F.concat(F.lit(EXTERNAL_DOC_URL), F.regexp_replace("import_path", "^/", "")))
    return d.select("package", "import_path", cls.alias("class"), F.col("known_anchor").alias("anchor"),
                    link.alias("link"))


# --- J8 ---------------------------------------------------------------------
def link_type_refs(refs: DataFrame, key: Sequence[str], aliases: DataFrame, own_package: Column,
                   module_names: DataFrame, type_params: DataFrame | None = None) -> DataFrame:
    """Link every identifier of a type text (E14 rows: ``key, ref, qualifier, ident``).

    Builtins and the declaration's type parameters stay plain; an unqualified
    name links to its anchor in the own package; a qualified name is resolved
    through the file's alias map (J7): internal (boundary member of a module,
    J4) → anchor, external → documentation URL, unknown alias → plain.
    ``type_params``: ``key…, name`` rows (joined, so any number per declaration).
    """
    am = aliases.select(*key, F.col("alias_key").alias("qualifier"), "import_path")
    x = refs.join(am, [*key, "qualifier"], "left")
    names = module_names.select(F.col("name").alias("__pre")).distinct()
    mem = explode_slash_prefixes(x.select("import_path").filter(F.col("import_path").isNotNull()).distinct(),
                                 "import_path", "__pre") \
        .join(names, "__pre", "left_semi").select("import_path").distinct().withColumn("__int", F.lit(True))
    x = x.join(mem, "import_path", "left")
    if type_params is not None:
        tp = type_params.select(*key, F.col("name").alias("ref")).distinct().withColumn("__tp", F.lit(True))
        x = x.join(tp, [*key, "ref"], "left")
    else:
        x = x.withColumn("__tp", F.lit(None).cast("boolean"))
    plain = F.col("ref").isin(*BUILTIN_TYPES) | F.coalesce("__tp", F.lit(False))
    link = (F.when(plain, F.col("ref"))
            .when(F.col("qualifier").isNull(), F.format_string("<<%s,%s>>", anchor_id(own_package, F.col("ref")), F.col("ref")))
            .when(F.col("import_path").isNull(), F.col("ref"))
            .when(F.coalesce("__int", F.lit(False)),
                  F.format_string("<<%s,%s>>", anchor_id(F.col("import_path"), F.col("ident")), F.col("ref")))
            .otherwise(F.format_string("link:" + EXTERNAL_DOC_URL + "%s#%s[%s]", "import_path", "ident", "ref")))
    return x.withColumn("link", link).drop("__int", "__tp")
