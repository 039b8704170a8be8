"""Path filters and path-derived columns (F1–F5, F10 helpers, O1, A1).

Every filter is a Column predicate, so Catalyst pushes it below joins and,
for a Parquet corpus, prunes ``content`` for dropped rows.  Regexes are built
once on the driver; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.glob import glob_to_regex, pattern_to_regex


# --- F1 ---------------------------------------------------------------------
def glob_match(col: Column | str, pattern: str) -> Column:
    """Whole-string glob match of ``col`` against ``pattern``."""
    c = F.col(col) if isinstance(col, str) else col
    return c.rlike(glob_to_regex(pattern, "java"))


def glob_filter(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.filter(glob_match(col, pattern))


# --- F2 ---------------------------------------------------------------------
def compile_patterns(patterns: Sequence[str]) -> list[tuple[str, str]]:
    """``[(raw pattern, java regex)]`` in pattern order, blanks skipped."""
    out = []
    for raw in patterns:
        rx = pattern_to_regex(raw, "java")
        if rx is not None:
            out.append((raw, rx))
    return out


def excluded_by(patterns: Sequence[str], *cols: Column | str) -> Column:
    """First pattern (pattern order, then column order) that matches; else null.

    Patterns prefixed ``glb:`` are globs (whole match), others search regexes.
    """
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    branches = []
    for raw, rx in compile_patterns(patterns):
        hit = None
        for c in cs:
            h = F.coalesce(c.rlike(rx), F.lit(False))
            hit = h if hit is None else (hit | h)
        branches.append(F.when(hit, F.lit(raw)))
    return F.coalesce(*branches, F.lit(None).cast("string")) if branches else F.lit(None).cast("string")


def exclude_filter(df: DataFrame, patterns: Sequence[str], cols: Sequence[str],
                   reason_col: str = "excluded_by") -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into (kept, excluded-with-reason)."""
    tagged = df.withColumn(reason_col, excluded_by(patterns, *cols))
    return (tagged.filter(F.col(reason_col).isNull()).drop(reason_col),
            tagged.filter(F.col(reason_col).isNotNull()))


# --- S2 helpers: virtual paths ----------------------------------------------
def url_path(url: Column | str) -> Column:
    """Virtual path of a URL: scheme, query and fragment removed."""
    u = F.col(url) if isinstance(url, str) else url
    return F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[?#].*\z", "")


def dir_of(path: Column | str) -> Column:
    """Directory of a ``/`` path, ``.`` when it has none."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(F.instr(p, "/") == 0, F.lit(".")) \
        .otherwise(F.regexp_extract(p, r"^(.*)/[^/]*$", 1))


def relative_to(path: Column | str, root: str) -> Column:
    """``path`` relative to ``root`` (``.`` for the root itself)."""
    p = F.col(path) if isinstance(path, str) else path
    r = root.rstrip("/")
    if r == "":
        return F.when(p == "", F.lit(".")).otherwise(p)
    return F.when(p == F.lit(r), F.lit(".")) \
        .when(p.startswith(r + "/"), p.substr(F.lit(len(r) + 2), F.length(p))) \
        .otherwise(p)


# --- F3 ---------------------------------------------------------------------
def subtree_excluded_by(rel_path: Column | str, root: str, patterns: Sequence[str]) -> Column:
    """First exclude pattern hitting the root, any ancestor directory or the file.

    The walk is top-down, so the shallowest matching level decides and the
    reported pattern is the first one (pattern order) matching that level.
    Each level is tested on its absolute and its root-relative form.
    """
    rel = F.col(rel_path) if isinstance(rel_path, str) else rel_path
    segs = F.when(rel == ".", F.array().cast("array<string>")).otherwise(F.split(rel, "/"))
    r = root.rstrip("/")
    comp = compile_patterns(patterns)
    if not comp:
        return F.lit(None).cast("string")

    def level(k):
        rel_k = F.when(k == 0, F.lit(".")).otherwise(F.array_join(F.slice(segs, 1, k), "/"))
        if r:
            abs_k = F.when(k == 0, F.lit(r)).otherwise(F.concat(F.lit(r + "/"), rel_k))
        else:
            abs_k = rel_k
        branches = [F.when(abs_k.rlike(rx) | rel_k.rlike(rx), F.lit(raw)) for raw, rx in comp]
        return F.coalesce(*branches)

    hits = F.filter(F.transform(F.sequence(F.lit(0), F.size(segs)), level), lambda x: x.isNotNull())
    return F.get(hits, 0)


# --- F4 / F5 ----------------------------------------------------------------
def suffix_class(file_name: Column | str, suffix: str = ".go") -> Column:
    """``test`` / ``source`` / null (not a source file)."""
    f = F.col(file_name) if isinstance(file_name, str) else file_name
    stem = suffix.lstrip(".")
    return F.when(~f.endswith(suffix), F.lit(None).cast("string")) \
        .when(f.endswith("_test." + stem), F.lit("test")).otherwise(F.lit("source"))


def _dir_segments(rel_dir: Column | str) -> Column:
    d = F.col(rel_dir) if isinstance(rel_dir, str) else rel_dir
    return F.filter(F.split(d, "/"), lambda s: (s != "") & (s != ".") & (s != ".."))


def has_internal_segment(rel_dir: Column | str) -> Column:
    return F.exists(_dir_segments(rel_dir), lambda s: s == "internal")


def has_underscore_segment(rel_dir: Column | str) -> Column:
    return F.exists(_dir_segments(rel_dir), lambda s: s.startswith("_"))


def walk_filter(df: DataFrame, root: str = "", excludes: Sequence[str] = (),
                suffix: str = ".go", tests: bool = False, internal: bool = False,
                underscore: bool = False, path_col: str = "path") -> DataFrame:
    """The corpus walk rules as one projection: adds ``rel_path`` and ``drop_reason``.

    Order of the rules: exclude (subtree) → suffix → test → internal → underscore.
    Accepted test files skip the directory-segment checks.
    """
    rel = relative_to(path_col, root)
    rel_dir = dir_of(rel)
    ex = subtree_excluded_by(rel, root, excludes)
    kind = suffix_class(F.substring_index(F.col(path_col), "/", -1), suffix)
    reason = (F.when(ex.isNotNull(), F.concat(F.lit("excluded by "), ex))
              .when(kind.isNull(), F.lit("not a source file"))
              .when((kind == "test") & F.lit(not tests), F.lit("test file"))
              .when(kind == "test", F.lit(None).cast("string"))
              .when(has_internal_segment(rel_dir) & F.lit(not internal), F.lit("internal directory"))
              .when(has_underscore_segment(rel_dir) & F.lit(not underscore), F.lit("underscored directory")))
    return df.withColumn("rel_path", rel).withColumn("drop_reason", reason)


# --- A1 / O1 ----------------------------------------------------------------
def group_by_dir(files: DataFrame, dir_col: str = "dir", path_col: str = "path") -> DataFrame:
    """One row per directory: file count and first/last path in byte order."""
    return files.groupBy(dir_col).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.min(path_col).alias("first_path"),
        F.max(path_col).alias("last_path"),
    )
