"""Section layouts (R1–R5, P3) as Column expressions.

A layout is a function from the row's columns to a ``Column`` of text, so it
is evaluated by Catalyst inside the projection; callers replace a layout by
name (P3) without any per-row Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import anchor_id
from ..operators.aggregates import ordered_join

Layout = Callable[[], Column]


def _decl_section() -> Column:
    anchor = anchor_id(F.col("package"), F.col("name"))
    doc = F.when(F.col("doc") != "", F.concat(F.lit("\n\n"), F.col("doc"))).otherwise(F.lit(""))
    return F.concat(F.lit("[[") , anchor, F.lit("]]\n=== "), F.col("name"), F.lit("\n[source, go]\n----\n"),
                    F.col("decl"), F.lit("\n----"), doc)


def _const_section() -> Column:
    return F.concat(F.lit("[source, go]\n----\n"), F.col("decl"), F.lit("\n----"))


# Layout names.
DEFAULT_LAYOUTS: dict[str, Layout] = {
    "struct": _decl_section, "interface": _decl_section, "type": _decl_section, "functype": _decl_section,
    "func": _decl_section, "method": _decl_section, "var": _decl_section, "const": _const_section,
}

# Section headings.
SECTION_TITLES = {"imports": "Imports", "interfaces": "Interfaces", "structs": "Structs", "types": "Types",
                  "consts": "Constants", "functypes": "Function Types", "vars": "Variables",
                  "functions": "Functions"}

KIND_SECTION = {"struct": "structs", "interface": "interfaces", "type": "types", "functype": "functypes",
                "func": "functions", "method": "functions", "var": "vars", "const": "consts"}


def render_sections(decls: DataFrame, overrides: dict[str, Layout] | None = None) -> DataFrame:
    """R1 (+P3): one text row per declaration, layout chosen by kind."""
    layouts = {**DEFAULT_LAYOUTS, **(overrides or {})}
    text = None
    for kind, fn in layouts.items():
        text = F.when(F.col("kind") == kind, fn()) if text is None else text.when(F.col("kind") == kind, fn())
    sec = None
    for kind, s in KIND_SECTION.items():
        sec = F.when(F.col("kind") == kind, F.lit(s)) if sec is None else sec.when(F.col("kind") == kind, F.lit(s))
    return decls.withColumn("section", sec).withColumn("text", text)


def section_wrappers(sections: DataFrame, group: list[str]) -> DataFrame:
    """R2: heading + the section's items in declaration order, per (group…, section)."""
    title = None
    for s, t in SECTION_TITLES.items():
        title = F.when(F.col("section") == s, F.lit(t)) if title is None else title.when(F.col("section") == s, F.lit(t))
    body = sections.groupBy(*group, "section").agg(ordered_join(["path", "decl_line"], "text", "\n\n").alias("__b"))
    return body.select(*group, "section", F.concat(F.lit("== "), title, F.lit("\n\n"), "__b").alias("text"))


def package_index(info: DataFrame, include: bool = True) -> DataFrame:
    """Per package an include line, or heading + link, in ``idx`` order."""
    line = F.format_string("include::%s[leveloffset=+1]", "out_file") if include else \
        F.format_string("== %s\n\nlink:%s[%s]", "fq_package", "out_file", "fq_package")
    return info.select("idx", line.alias("text"))


def module_index(modules: DataFrame, title: str) -> DataFrame:
    """Header row, numbered overview list, one include per module (rank, pos, text)."""
    head = modules.sparkSession.range(1).select(F.lit(0).alias("rank"), F.lit(0).cast("long").alias("pos"),
                                                F.lit(f"= {title}\n:toc:\n").alias("text"))
    items = modules.select(F.lit(1).alias("rank"), F.col("module_order").cast("long").alias("pos"),
                           F.format_string(". <<%s,%s>>", F.concat(F.lit("module-"), F.col("module_order").cast("string")),
                                           "name").alias("text"))
    incl = modules.select(F.lit(2).alias("rank"), F.col("module_order").cast("long").alias("pos"),
                          F.format_string("include::%s[]", "out_file").alias("text"))
    return head.unionByName(items).unionByName(incl)


def reference_section(refs: DataFrame) -> DataFrame:
    """Per package, internal and external reference lists sorted by name."""
    internal = F.when(F.col("class") != "external", F.format_string("* link:%s[%s]", "link", "import_path"))
    external = F.when(F.col("class") == "external", F.format_string("* link:%s[%s]", "link", "import_path"))
    g = refs.groupBy("package").agg(ordered_join(["import_path"], internal, "\n").alias("__i"),
                                    ordered_join(["import_path"], external, "\n").alias("__e"))
    return g.select("package", F.concat(F.lit("=== Internal\n"), "__i", F.lit("\n\n=== External\n"), "__e").alias("text"))
