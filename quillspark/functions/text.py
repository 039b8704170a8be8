"""Scalar Column helpers (X1–X12).  All are built-in Spark expressions.

Java regex note: ``(?d)`` (UNIX_LINES) makes ``.``, ``^`` and ``$`` treat only
``\\n`` as a line end, which is the newline rule of the texts being processed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- X1 ---------------------------------------------------------------------
def anchor_id(pkg: ColumnOrName, name: ColumnOrName) -> Column:
    """``pkg.name`` with every character outside ``[A-Za-z0-9_-]`` turned into ``-``."""
    p, n = _c(pkg), _c(name)
    joined = F.when(F.coalesce(p, F.lit("")) == "", F.coalesce(n, F.lit(""))) \
        .otherwise(F.concat(p, F.lit("."), F.coalesce(n, F.lit(""))))
    return F.regexp_replace(joined, r"[^A-Za-z0-9_\-]", "-")


# --- X2 ---------------------------------------------------------------------
def module_short_name(name: ColumnOrName) -> Column:
    """Last ``/`` segment of a module name with ``.`` and ``_`` turned into ``-``."""
    return F.translate(F.substring_index(_c(name), "/", -1), "._", "--")


# --- X3 ---------------------------------------------------------------------
def path_dir(path: ColumnOrName) -> Column:
    """Directory part of a ``/`` path (``.`` when there is none)."""
    p = _c(path)
    stripped = F.regexp_replace(p, r"/+\z", "")
    d = F.regexp_extract(stripped, r"^(.*)/[^/]*$", 1)
    return F.when(stripped == "", F.when(p == "", ".").otherwise("/")) \
        .when(F.instr(stripped, "/") == 0, F.lit(".")) \
        .when(d == "", F.lit("/")).otherwise(d)


def path_base(path: ColumnOrName) -> Column:
    """Last element of a ``/`` path."""
    p = F.regexp_replace(_c(path), r"/+\z", "")
    return F.when(p == "", F.lit("/")).otherwise(F.substring_index(p, "/", -1))


def expand_macros(doc: ColumnOrName, fq: ColumnOrName) -> Column:
    """Replace the four path macros by the parts of the row's path ``fq``."""
    fq = _c(fq)
    fqdir = path_dir(fq)
    d = doc if isinstance(doc, Column) else F.col(doc)
    # Macro names.
    d = F.replace(d, F.lit("${gad:current:fq}"), fq)
    d = F.replace(d, F.lit("${gad:current:fqdir}"), fqdir)
    d = F.replace(d, F.lit("${gad:current:dir}"), path_base(fqdir))
    d = F.replace(d, F.lit("${gad:current:file}"), path_base(fq))
    return d


# --- X4 ---------------------------------------------------------------------
REGION_TAG_JAVA = r"(?d)\s*tag::.*\[\]"


def strip_region_tags(doc: ColumnOrName) -> Column:
    return F.regexp_replace(_c(doc), REGION_TAG_JAVA, "")


# --- X5 ---------------------------------------------------------------------
HEADING_JAVA = r"(?md)^[ \t]*#{1,6}(?:[ \t]+(.*?))?[ \t]*$"


def strip_headings(doc: ColumnOrName) -> Column:
    """Line-start ``#``..``######`` followed by blank or line end: keep the text."""
    return F.regexp_replace(_c(doc), HEADING_JAVA, "$1")


def process_doc(doc: ColumnOrName, fq: ColumnOrName, headings: bool = True) -> Column:
    """Macro pass (X3, X4, optional X5) as applied to every doc text."""
    out = strip_region_tags(expand_macros(doc, fq))
    return strip_headings(out) if headings else out


# --- X6 / X7 ----------------------------------------------------------------
def strip_markup(text: ColumnOrName) -> Column:
    """Drop ``<…>`` (an unclosed ``<`` drops to the end) and any lone ``>``."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"<[^>]*(?:>|\z)", ""), ">", "")


# Entity forms of the five escaped characters.
_ESCAPES = [("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")]


def escape_entities(text: ColumnOrName) -> Column:
    c = _c(text)
    for raw, ent in _ESCAPES:                       # '&' first
        c = F.replace(c, F.lit(raw), F.lit(ent))
    return c


def unescape_entities(text: ColumnOrName) -> Column:
    c = _c(text)
    for raw, ent in list(reversed(_ESCAPES)) + [('"', "&quot;"), ("'", "&apos;")]:
        if raw == "&":
            continue
        c = F.replace(c, F.lit(ent), F.lit(raw))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))    # '&' last


# --- X8 ---------------------------------------------------------------------
def tabify_first(text: ColumnOrName) -> Column:
    return F.regexp_replace(_c(text), r"^([^ ]*) ", "$1\t")


def tabify_last(text: ColumnOrName) -> Column:
    return F.regexp_replace(_c(text), r"(?s)^(.*) ([^ ]*)\z", "$1\t$2")


# --- X9 ---------------------------------------------------------------------
def canonical_version(v: ColumnOrName) -> Column:
    """Strip ``go``, cut at the first char that is not digit or dot, keep major.minor."""
    t = F.regexp_replace(_c(v), r"^\s+|\s+\z", "")
    digits = F.regexp_extract(t, r"^(?:go)?([0-9.]*)", 1)
    return F.regexp_extract(digits, r"^([^.]*(?:\.[^.]*)?)", 1)


# --- X10 --------------------------------------------------------------------
def format_type_params(params: ColumnOrName) -> Column:
    """``[T any, U ~string]`` from an ordered ``array<struct<name,type_text>>``."""
    arr = _c(params)
    kept = F.filter(arr, lambda p: F.trim(F.coalesce(p["name"], F.lit(""))) != "")
    parts = F.transform(kept, lambda p: F.when(F.trim(F.coalesce(p["type_text"], F.lit(""))) == "",
                                               F.trim(p["name"]))
                        .otherwise(F.concat(F.trim(p["name"]), F.lit(" "), F.trim(p["type_text"]))))
    return F.when(F.size(parts) > 0, F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))) \
        .otherwise(F.lit(""))


# --- X11 --------------------------------------------------------------------
def relative_path(base_dir: ColumnOrName, target: ColumnOrName) -> Column:
    """Relative path from directory ``base_dir`` to ``target`` (both absolute or both relative)."""
    b = F.filter(F.split(_c(base_dir), "/"), lambda s: (s != "") & (s != "."))
    t = F.filter(F.split(_c(target), "/"), lambda s: (s != "") & (s != "."))
    n = F.least(F.size(b), F.size(t))
    # length of the common leading run of segments
    common = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.struct(F.lit(0).alias("k"), F.lit(True).alias("run")),
        lambda acc, i: F.when(acc["run"] & (i <= n) & (F.element_at(b, i) == F.element_at(t, i)),
                              F.struct((acc["k"] + 1).alias("k"), F.lit(True).alias("run")))
        .otherwise(F.struct(acc["k"].alias("k"), F.lit(False).alias("run"))),
    )["k"]
    ups = F.array_repeat(F.lit(".."), F.size(b) - common)
    rest = F.slice(t, common + 1, F.greatest(F.size(t) - common, F.lit(0)))
    joined = F.array_join(F.concat(ups, rest), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


# --- X12 --------------------------------------------------------------------
def trim_newlines(text: ColumnOrName) -> Column:
    return F.regexp_replace(_c(text), r"\n+\z", "")


def indent_line(text: ColumnOrName) -> Column:
    c = _c(text)
    return F.when(c == "", c).otherwise(F.concat(F.lit("\t"), c))


def make_indent(level: ColumnOrName) -> Column:
    lv = _c(level)
    return F.when(lv <= 0, F.lit("")).otherwise(F.repeat(F.lit("  "), lv))


def strip_extension(name: ColumnOrName) -> Column:
    return F.regexp_replace(_c(name), r"\.[^.]*\z", "")
