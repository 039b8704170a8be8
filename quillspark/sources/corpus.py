"""Corpus sources (S1, S2) and output path assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paths import dir_of, walk_filter

CORPUS_COLUMNS = ["path", "dir", "file_name", "content"]


def _normalise_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n", "\n")


def _file_path() -> Column:
    """Path of the file being read: the URI's, decoded; local ones without their scheme."""
    uri = F.regexp_replace("_metadata.file_path", r"\+", "%2B")  # a plus sign is itself, not a blank
    return F.regexp_replace(F.url_decode(uri), r"^file:(//)?(?=/)", "").alias("path")


def corpus_from_table(df: DataFrame, path_col: str, text_col: str,
                      keep: Sequence[str] = ()) -> DataFrame:
    """A table with text in a column becomes a corpus with a virtual path.

    Output columns: ``keep..., path, dir, file_name, content`` (CRLF → LF).
    """
    p = F.col(path_col)
    return df.select(
        *keep,
        p.alias("path"),
        dir_of(p).alias("dir"),
        F.substring_index(p, "/", -1).alias("file_name"),
        _normalise_newlines(F.col(text_col)).alias("content"),
    )


def read_corpus(spark: SparkSession, roots: Sequence[str], files: Sequence[str] = (),
                suffix: str = ".go", excludes: Sequence[str] = (), tests: bool = False,
                internal: bool = False, underscore: bool = False,
                with_dropped: bool = False) -> DataFrame:
    """Recursive listing of directory roots plus explicit files.

    Directory roots go through the walk rules (exclude/suffix/test/segment);
    explicit files are accepted as given, in one scan.  One scan per root.
    Paths are the files' own (blanks and other characters decoded).
    The listing and the read are Spark's file source (``wholetext``), so the
    files are split across tasks; nothing is read on the driver.
    """
    import re
    parts = []
    for root in roots:
        # local paths are compared without their file: scheme (as listed by the source)
        r = re.sub(r"^file:(//)?", "", root).rstrip("/")
        if root.startswith("file:") and not r.startswith("/"):
            r = "/" + r
        df = (spark.read.option("recursiveFileLookup", "true").option("wholetext", "true")
              .text(root).select(_file_path(), F.col("value").alias("content")))
        df = walk_filter(df, root=r, excludes=excludes, suffix=suffix, tests=tests,
                         internal=internal, underscore=underscore)
        if not with_dropped:
            df = df.filter(F.col("drop_reason").isNull())
        parts.append(df.withColumn("root", F.lit(r)))
    if files:
        df = (spark.read.option("wholetext", "true").text(list(files))
              .select(_file_path(), F.col("value").alias("content"), F.lit(None).cast("string").alias("drop_reason"),
                      F.lit(None).cast("string").alias("root")))
        parts.append(df.withColumn("rel_path", F.col("path")))
    if not parts:
        raise ValueError("no roots or files given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.withColumn("content", _normalise_newlines(F.col("content")))
    return out.select("path", "rel_path", dir_of("path").alias("dir"),
                      F.substring_index("path", "/", -1).alias("file_name"),
                      "content", "root", "drop_reason")


def package_output_file(fq_package: Column | str, file_path: Column | str,
                        outfile: str | None = None) -> Column:
    """Output document of a package.

    No ``outfile``: next to the package directory, ``<dir(file_path)>/<fq with / → _>.adoc``.
    With ``outfile``: ``<dir(outfile)>/packages/<fq with / → _>.adoc``.
    """
    fq = F.col(fq_package) if isinstance(fq_package, str) else fq_package
    fp = F.col(file_path) if isinstance(file_path, str) else file_path
    name = F.concat(F.translate(fq, "/\\", "__"), F.lit(".adoc"))
    if outfile:
        base = outfile.rsplit("/", 1)[0] if "/" in outfile else "."
        prefix = "packages/" if base == "." else base.rstrip("/") + "/packages/"
        return F.concat(F.lit(prefix), name)
    parent = dir_of(fp)
    return F.when(F.coalesce(fp, F.lit("")) == "", name) \
        .when(parent == ".", name).otherwise(F.concat(parent, F.lit("/"), name))


def module_output_file(base: Column | str, short_name: Column | str, outfile: str | None = None) -> Column:
    """Output document of a module (``<base>/<short>.adoc`` or ``<outfile stem>-<short><ext>``)."""
    b = F.col(base) if isinstance(base, str) else base
    s = F.col(short_name) if isinstance(short_name, str) else short_name
    if outfile:
        d, _, fname = outfile.rpartition("/")
        stem, dot, ext = fname.rpartition(".")
        if not dot:
            stem, ext = fname, ""
        pre = (d + "/" if d else "") + stem + "-"
        return F.concat(F.lit(pre), s, F.lit(("." + ext) if ext else ""))
    return F.concat(F.regexp_replace(b, "/+$", ""), F.lit("/"), s, F.lit(".adoc"))
