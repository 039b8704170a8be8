"""Manifests and module ownership.

Prefix joins never use ``startswith`` as a join condition between two large
sides.  Rows are resolved by their distinct values (directories, import paths): a value is expanded
to the prefix lengths that the small side has and joined by equality on ``(length, prefix)``, or to its
ancestor directories, and the result is joined back to the rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_version, module_short_name
from .paths import dir_of



# --- S3 ---------------------------------------------------------------------
def parse_manifests(df: DataFrame, path_col: str = "path", content_col: str = "content",
                    order_col: str = "module_order") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Module and workspace manifests → (modules, workspace members, quarantine).

    A module manifest without a ``module`` line is rejected to the quarantine
    table.  Workspace members come from ``use`` lines (block or single form)
    in their written order.
    """
    p, c = F.col(path_col), F.col(content_col)
    base = dir_of(p)
    kind = F.when(F.substring_index(p, "/", -1) == "go.work", "workspace").otherwise("module")
    name = F.regexp_extract(c, r"(?m)^[ \t]*module[ \t]+\"?([^\s\"]+)\"?", 1)
    gover = F.regexp_extract(c, r"(?m)^[ \t]*go[ \t]+([^\s]+)", 1)
    m = df.select(F.col(order_col).alias("module_order"), p.alias("manifest_path"), base.alias("base"),
                  kind.alias("kind"), name.alias("name"), gover.alias("go_version"), c.alias("_content"))
    modules = m.filter((F.col("kind") == "module") & (F.col("name") != "")).select(
        "module_order", "name", "base", "manifest_path",
        F.lit("").alias("version"), "go_version",
        canonical_version("go_version").alias("go_version_short"),
        module_short_name("name").alias("short_name"))
    bad = m.filter((F.col("kind") == "module") & (F.col("name") == "")).select(
        F.lit("manifest").alias("stage"), F.col("manifest_path").alias("path"),
        F.concat(F.lit("no module line in "), F.col("manifest_path")).alias("message"))
    block = F.regexp_extract(F.col("_content"), r"(?s)(?:^|\n)[ \t]*use[ \t]*\((.*?)\)", 1)
    single = F.regexp_extract_all(F.col("_content"), F.lit(r"(?m)^[ \t]*use[ \t]+([^\s(][^\s]*)"), 1)
    members = F.concat(
        F.filter(F.transform(F.split(block, "\n"),
                             lambda x: F.regexp_replace(F.regexp_replace(x, r"//.*", ""), r"^\s+|\s+\z", "")),
                 lambda x: x != ""),
        single)
    ws = m.filter(F.col("kind") == "workspace").select(
        "module_order", "manifest_path", "base", F.posexplode(members).alias("pos", "use_path"))
    ws = ws.select("module_order", "manifest_path", "base", F.col("pos").cast("long").alias("pos"), "use_path",
                   F.regexp_replace(F.concat(F.col("base"), F.lit("/"), F.regexp_replace("use_path", r"^\./", "")),
                                    r"/+\z", "").alias("member_base"))
    return modules, ws, bad


def manifest_table(manifests: DataFrame, path_col: str = "path", content_col: str = "content",
                   order_col: str = "module_order") -> DataFrame:
    """All manifests with their load status: ``base, manifest_path, kind, ok, name``.

    A module manifest loads when it has a module line.  A workspace manifest
    loads when at least one ``use`` directory holds a module manifest and none
    of those fails to load (members without a manifest are skipped).
    """
    mods, ws, _bad = parse_manifests(manifests, path_col, content_col, order_col)
    all_m = manifests.select(dir_of(F.col(path_col)).alias("base"), F.col(path_col).alias("manifest_path"),
                             F.when(F.substring_index(F.col(path_col), "/", -1) == "go.work", "workspace")
                             .otherwise("module").alias("kind"))
    good = mods.select("manifest_path", F.lit(True).alias("__good"), "name")
    member_mf = all_m.filter(F.col("kind") == "module").join(good, "manifest_path", "left") \
        .select(F.col("base").alias("member_base"), F.coalesce("__good", F.lit(False)).alias("__member_ok"))
    ws_status = ws.join(member_mf, "member_base").groupBy("manifest_path").agg(
        F.count(F.lit(1)).alias("__n"), F.bool_and("__member_ok").alias("__all_ok"))
    out = all_m.join(good, "manifest_path", "left").join(ws_status, "manifest_path", "left")
    ok = F.when(F.col("kind") == "module", F.coalesce("__good", F.lit(False))) \
        .otherwise(F.coalesce((F.col("__n") > 0) & F.col("__all_ok"), F.lit(False)))
    return out.select("base", "manifest_path", "kind", ok.alias("ok"), "name")


# --- prefix index -------------------------------------------------------------
def prefix_candidates(big: DataFrame, path_col: str, small: DataFrame, key: str) -> DataFrame:
    """(big row, small row) pairs where ``small.key`` is a raw string prefix of ``big.path_col``.

    Equi-join on ``(len, prefix)``; each big row is expanded only to the
    distinct key lengths that exist, which the query itself gathers (as many numbers as the longest key has characters at most).
    """
    lens = small.agg(F.array_sort(F.collect_set(F.length(key))).alias("n"))
    exp = big.withColumn("__qs_lens", lens.scalar()) \
        .withColumn("__qs_len", F.explode(F.filter("__qs_lens", lambda n: n <= F.length(F.col(path_col))))) \
        .withColumn("__qs_pre", F.col(path_col).substr(F.lit(1), F.col("__qs_len")))
    s = small.withColumn("__qs_len", F.length(key)).withColumn("__qs_pre", F.col(key))
    # one module base may own a third of all paths: Spark broadcasts the small side
    # by its bytes, and AQE splits the hot key of a shuffle join
    return exp.join(s, ["__qs_len", "__qs_pre"]).drop("__qs_lens", "__qs_len", "__qs_pre")


def by_value(rows: DataFrame, value: Column, resolve) -> DataFrame:
    """``rows`` with what ``resolve(values)`` finds for ``value``, worked out once for each distinct value and joined back.

    ``resolve`` takes the distinct ``__qs_v`` and gives a row with more columns for those it can
    resolve.  Rows move once, to meet the resolved values (not at all where these are few enough for Spark to broadcast).
    """
    keyed = rows.withColumn("__qs_v", value)
    found = resolve(keyed.select("__qs_v").filter(F.col("__qs_v").isNotNull()).distinct())
    return keyed.join(found, "__qs_v", "left").drop("__qs_v")


def _least(candidate: Column) -> Column:
    """The least candidate of a value (it has one a prefix length at most); hashed, as ``min_by`` of text would sort."""
    return F.array_min(F.collect_list(candidate))


def _reach(path_col: str, small: DataFrame, key: str) -> tuple[Column, Column]:
    """The part of a path on which raw prefixes of ``small.key`` depend: its directory, and as much
    of the file's name as the longest key could reach.  Paths of a directory mostly share it."""
    longest = F.coalesce(small.agg(F.max(F.length(key)).alias("n")).scalar(), F.lit(0))
    up_to = F.length(F.regexp_extract(F.col(path_col), r"^.*/", 0))
    return longest, F.substring(F.col(path_col), F.lit(1), F.greatest(up_to, F.col("__qs_reach")))


# --- J2 ---------------------------------------------------------------------
def first_prefix_owner(paths: DataFrame, path_col: str, modules: DataFrame, default_module: str | None = None) -> DataFrame:
    """Module whose ``base`` is a raw prefix of the path; first in module order wins (``owner``, ``owner_base``)."""
    m = modules.select(F.col("base").alias("__qs_base"), F.col("name").alias("__qs_name"),
                       F.col("module_order").alias("__qs_order"))

    def resolve(values: DataFrame) -> DataFrame:
        return prefix_candidates(values, "__qs_v", m, "__qs_base").groupBy("__qs_v").agg(
            _least(F.struct(F.col("__qs_order"), F.col("__qs_name").alias("name"), F.col("__qs_base").alias("base"))).alias("__qs_m"))
    longest, reach = _reach(path_col, m, "__qs_base")
    out = by_value(paths.withColumn("__qs_reach", longest), reach, resolve).drop("__qs_reach")
    return out.withColumn("owner", F.coalesce(F.col("__qs_m.name"), F.lit(default_module))) \
        .withColumn("owner_base", F.col("__qs_m.base")).drop("__qs_m")


# --- J3 ---------------------------------------------------------------------
def longest_prefix_module(paths: DataFrame, path_col: str, modules: DataFrame) -> DataFrame:
    """Module with the longest name that is a raw prefix of ``path_col`` (ties: module order), as ``module``."""
    m = modules.select(F.col("name").alias("__qs_name"), F.col("module_order").alias("__qs_order"))

    def resolve(values: DataFrame) -> DataFrame:
        return prefix_candidates(values, "__qs_v", m, "__qs_name").groupBy("__qs_v").agg(
            _least(F.struct((-F.length("__qs_name")).alias("l"), F.col("__qs_order"), F.col("__qs_name").alias("name")))["name"].alias("module"))
    return by_value(paths, F.col(path_col), resolve)


# --- J4 ---------------------------------------------------------------------
def explode_slash_prefixes(df: DataFrame, col: str, out: str = "__qs_p") -> DataFrame:
    """One row per ``/``-boundary prefix of ``col`` (generator + codegen'd
    ``substring_index``; cheaper than building the prefix array)."""
    return df.select("*", F.posexplode(F.split(F.col(col), "/")).alias("__qs_k", "__qs_seg")) \
        .withColumn(out, F.expr(f"substring_index(`{col}`, '/', __qs_k + 1)")).drop("__qs_k", "__qs_seg")


def module_membership(paths: DataFrame, path_col: str, modules: DataFrame) -> DataFrame:
    """Two flags per row: raw prefix of any module name, boundary-aware prefix of any."""
    names = modules.select(F.col("name").alias("__qs_name")).filter(F.col("name") != "").distinct()

    def resolve(values: DataFrame) -> DataFrame:
        raw = prefix_candidates(values, "__qs_v", names, "__qs_name")
        bounded = (F.col("__qs_v") == F.col("__qs_name")) | F.substr(F.col("__qs_v"), F.length("__qs_name") + 1, F.lit(1)).eqNullSafe(F.lit("/"))
        return raw.groupBy("__qs_v").agg(F.bool_or(bounded).alias("boundary_member")).withColumn("raw_member", F.lit(True))
    out = by_value(paths, F.col(path_col), resolve)
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("raw_member", "boundary_member")})


# --- J5 ---------------------------------------------------------------------
def explode_ancestors(df: DataFrame, dir_col: str) -> DataFrame:
    """One row per ancestor of ``dir_col`` (itself included): ``depth`` 0 = itself, ``base`` = ancestor.

    A generator over the path segments plus codegen'd ``substring_index``;
    the root of an absolute path is ``/``.
    """
    x = df.select("*", F.posexplode(F.split(F.col(dir_col), "/")).alias("__qs_k", "__qs_seg"))
    anc = F.expr(f"substring_index(`{dir_col}`, '/', __qs_k + 1)")
    n = F.size(F.split(F.col(dir_col), "/"))
    return x.withColumn("base", F.when(anc == "", F.lit("/")).otherwise(anc)) \
        .withColumn("depth", n - 1 - F.col("__qs_k")).drop("__qs_k", "__qs_seg")


def nearest_manifest(paths: DataFrame, dir_col: str, manifests: DataFrame) -> DataFrame:
    """Nearest ancestor directory holding a manifest; workspace beats module at one level.

    ``manifests``: (base, kind in {workspace, module}, manifest_path, ok BOOLEAN, name).
    Adds ``manifest_path``, ``manifest_kind``, ``manifest_name``, ``status`` (ok /
    failed to load / none found).  Only the distinct directories are expanded to their ancestors.
    """
    m = manifests.select("base", F.col("kind").alias("__qs_kind"), F.struct(
        F.col("manifest_path").alias("p"), F.col("kind").alias("k"), F.col("name").alias("n"), F.col("ok").alias("ok")).alias("__qs_m"))

    def resolve(values: DataFrame) -> DataFrame:
        rank = F.struct(F.col("depth"), F.when(F.col("__qs_kind") == "workspace", 0).otherwise(1).alias("k"), F.col("__qs_m.p").alias("p"))
        return explode_ancestors(values, "__qs_v").join(m, "base").groupBy("__qs_v").agg(_least(F.struct(rank.alias("r"), F.col("__qs_m").alias("m")))["m"].alias("__qs_b"))
    out = by_value(paths, F.col(dir_col), resolve)
    status = F.when(F.col("__qs_b").isNull(), F.lit("no manifest found")) \
        .when(F.col("__qs_b.ok"), F.lit("ok")).otherwise(F.concat(F.lit("unusable "), F.substring_index(F.col("__qs_b.p"), "/", -1)))
    return out.select(*paths.columns, F.col("__qs_b.p").alias("manifest_path"), F.col("__qs_b.k").alias("manifest_kind"),
                      F.col("__qs_b.n").alias("manifest_name"), status.alias("status"))


# --- J6 ---------------------------------------------------------------------
def resolve_package(file_path: Column | str, base: Column | str, name: Column | str) -> Column:
    """Import path of a file's package: module name + directory relative to the base.

    Null when the file lies outside the module (caller routes it to quarantine).
    """
    fp = F.col(file_path) if isinstance(file_path, str) else file_path
    b = F.regexp_replace(F.col(base) if isinstance(base, str) else base, r"/+\z", "")
    nm = F.col(name) if isinstance(name, str) else name
    d = dir_of(fp)
    rel = F.when(d == b, F.lit("")).when(d.startswith(F.concat(b, F.lit("/"))),
                                        d.substr(F.length(b) + 2, F.length(d)))
    return F.when(rel.isNull(), F.lit(None).cast("string")) \
        .when(rel == "", nm).otherwise(F.concat(F.regexp_replace(nm, r"/\z", ""), F.lit("/"),
                                                 F.regexp_replace(rel, r"^/+|/+\z", "")))


def package_path(*candidates: Column) -> Column:
    """First candidate that names a package (neither null nor empty), else the empty string.

    The usual chain: the file's own qualified name, the name resolved in the file's
    module, then in the caller's module, the plain package name, and the qualified
    names of the caller's package and file.
    """
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def resolve_rejects(rows: DataFrame, path_col: str, base_col: str, name_col: str) -> DataFrame:
    """Q1 rows of the files that :func:`resolve_package` can't name: ``stage, path, message``; with the named ones they are all rows."""
    why = F.when(F.col(base_col).isNull(), F.lit("no module for the file")) \
        .otherwise(F.concat(F.lit("not inside module "), F.coalesce(F.col(name_col), F.lit("")), F.lit(" at "), F.col(base_col)))
    return rows.filter(resolve_package(path_col, base_col, name_col).isNull()).select(
        F.lit("package name").alias("stage"), F.col(path_col).alias("path"), why.alias("message"))


# --- J12 --------------------------------------------------------------------
# Default overview file names in priority order.
DEFAULT_OVERVIEW_PATHS = ["overview.adoc", "_design/overview.adoc"]


def first_existing(packages: DataFrame, dir_col: str, files: DataFrame, file_col: str,
                   candidates=DEFAULT_OVERVIEW_PATHS) -> DataFrame:
    """Per package the first candidate (priority order) that exists among ``files``."""
    arr = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(c).alias("cand")) for i, c in enumerate(candidates)])
    exp = packages.select(dir_col, F.explode(arr).alias("c")) \
        .select(dir_col, "c.prio", F.concat(F.col(dir_col), F.lit("/"), F.col("c.cand")).alias("__qs_fp"))
    ex = files.select(F.col(file_col).alias("__qs_fp")).distinct()
    best = exp.join(ex, "__qs_fp").groupBy(dir_col).agg(F.min_by("__qs_fp", "prio").alias("overview"))
    return packages.join(best, dir_col, "left")
