"""Lines, doc blocks and build tags.

The lines table is the one explosion of the corpus; everything else is
windows over ``(file, line_no)`` partitions, so the only shuffle is the one on
the file key.  A file with very many lines is still one window partition, but
the windows are running sums/lags (constant memory per row), not collects.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: One token of a source text: comment, raw string, string, character, other text.  Possessive
#: repetitions, so that long literals take no stack.
TOKEN = (r"(?s)//[^\n]*+|/\*.*?(?:\*/|\z)|`[^`]*+`?|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"?"
          r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?|[^/`\"']++|/")


# --- E1 ---------------------------------------------------------------------
def lines(df: DataFrame, key: Sequence[str], content_col: str = "content", partition: bool | int = True,
          head: int | None = None) -> DataFrame:
    """One row per line: ``key..., line_no (1-based), text``.

    With ``partition`` the files are hash-partitioned by ``key`` *before* the
    explosion: the shuffle moves whole texts (cheaper than moving lines) and
    every later per-file window, aggregate and (key, line) join reuses that
    partitioning instead of shuffling the lines again.  Without it no text moves:
    for plain explosions, and where few lines are left before the next shuffle.
    A number says how many partitions: the planner else joins them by the size of the
    texts, of which the lines and their sorts take many times as much.
    ``head`` keeps that many lines of each file.
    """
    src = df.select(*key, content_col)
    if partition:
        src = src.repartition(*([] if partition is True else [partition]), *key)
    text = F.split(F.col(content_col), "\n", -1)
    if head is not None:
        text = F.slice(text, 1, head)
    return src.select(*key, F.posexplode(text).alias("pos", "text")) \
        .select(*key, (F.col("pos") + 1).cast("long").alias("line_no"), "text")


def strip_ws(c: Column | str) -> Column:
    """Trim all white space (``F.trim`` only removes blanks, not tabs)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def mark_comments(ln: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add ``is_comment`` and ``ctext`` (comment text, null for directives) to a lines table.

    ``//`` lines, one-line ``/* … */`` and every line of a multi-line block
    comment (opened at the start of a line) are comment lines.  Whether a
    line lies inside an open block is the last open/close event before it —
    one running window over the file's lines.  ``ctext`` strips the markers
    (``//`` and one blank after it; ``/*``, ``*/``) and trailing white space.
    """
    t = F.col("text")
    lt = F.regexp_replace(t, r"^\s+", "")
    opens = lt.startswith("/*") & ~F.substring_index(lt, "/*", -1).contains("*/")
    closes = t.contains("*/")
    before = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    x = ln.withColumn("__qs_in", F.coalesce(F.last(F.when(opens, F.lit(True)).when(closes, F.lit(False)),
                                                   ignorenulls=True).over(before), F.lit(False)))
    line_comment = lt.startswith("//")
    single_block = lt.startswith("/*") & ~opens
    inside = F.col("__qs_in")
    body = (F.when(inside & closes, F.regexp_replace(t, r"\*/.*\z", ""))
            .when(inside, t)
            .when(line_comment, F.regexp_replace(F.regexp_replace(t, r"^\s*//", ""), r"^ ", ""))
            .when(single_block, F.regexp_replace(F.regexp_replace(t, r"^\s*/\*", ""), r"\*/\s*\z", ""))
            .when(opens, F.regexp_replace(t, r"^\s*/\*", "")))
    is_c = inside | line_comment | lt.startswith("/*")
    directive = ~inside & t.rlike(r"^\s*//(?:line |extern |export |[a-z0-9]+:[a-z0-9])")
    return x.withColumn("is_comment", is_c) \
        .withColumn("ctext", F.when(is_c & ~directive, F.regexp_replace(body, r"\s+\z", ""))).drop("__qs_in")


# --- E2 / E3 ----------------------------------------------------------------
def comment_blocks(ln: DataFrame, key: Sequence[str]) -> DataFrame:
    """Islands of consecutive comment lines: ``key, block_start, block_end, doc, lead``.

    ``doc`` is the block text (markers stripped, directives dropped, outer
    blank lines trimmed); ``lead`` is the block's first-line indentation.
    """
    w = Window.partitionBy(*key).orderBy("line_no")
    c = mark_comments(ln, key).withColumn("__c", F.col("is_comment"))
    c = c.withColumn("__grp", F.col("line_no") - F.row_number().over(w.partitionBy(*key, "__c")))
    blocks = c.filter("__c").groupBy(*key, "__grp").agg(
        F.min("line_no").alias("block_start"), F.max("line_no").alias("block_end"),
        F.array_sort(F.collect_list(F.struct("line_no", F.col("ctext").alias("t")))).alias("__ls"),
        F.min_by(F.regexp_extract("text", r"^(\s*)", 1), "line_no").alias("lead"))
    body = F.array_join(F.transform(F.filter("__ls", lambda x: x["t"].isNotNull()), lambda x: x["t"]), "\n")
    # collapse blank-line runs and trim leading/trailing blank lines
    body = F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"^\n+|\n+\z", "")
    return blocks.select(*key, "block_start", "block_end", body.alias("doc"), "lead")


def attach_docs(targets: DataFrame, blocks: DataFrame, key: Sequence[str], line_col: str = "line_no",
                doc_col: str = "doc") -> DataFrame:
    """A block belongs to the target starting on the line right after it."""
    b = blocks.select(*key, (F.col("block_end") + 1).alias(line_col), F.col("doc").alias(doc_col))
    return targets.join(b.hint("merge"), [*key, line_col], "left").withColumn(doc_col, F.coalesce(F.col(doc_col), F.lit("")))


def full_docs(ln: DataFrame, targets: DataFrame, key: Sequence[str], line_col: str = "line_no") -> DataFrame:
    """The attached block plus preceding blocks separated only by blank lines.

    The blank text between blocks is kept.  Sessionization over the lines: a
    new session starts at every non-blank, non-comment line; the blocks of the
    session that ends right before a target form its full doc.
    """
    w = Window.partitionBy(*key).orderBy("line_no")
    comment = F.col("is_comment")
    blank = strip_ws("text") == ""
    s = mark_comments(ln, key).withColumn("__code", ~comment & ~blank) \
        .withColumn("__sess", F.sum(F.col("__code").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # piece of text each line contributes: comment text, or its blank text
    piece = F.when(comment, F.col("ctext")).otherwise(F.col("text"))
    s = s.withColumn("__piece", piece).withColumn("__cm", comment)
    # the session's lines between its first and last comment line, i.e. up to the target
    sess = s.filter(~F.col("__code")).groupBy(*key, "__sess").agg(
        F.max(F.when(F.col("__cm"), F.col("line_no"))).alias("__last"),
        F.array_sort(F.collect_list(F.struct("line_no", "__piece", "__cm"))).alias("__ls"))
    kept = F.filter("__ls", lambda x: x["line_no"] <= F.col("__last"))
    first_cm = F.aggregate(kept, F.lit(None).cast("long"),
                           lambda acc, x: F.when(acc.isNull() & x["__cm"] & x["__piece"].isNotNull(), x["line_no"])
                           .otherwise(acc))
    body = F.filter(kept, lambda x: (x["line_no"] >= first_cm) & x["__piece"].isNotNull())
    text = F.array_join(F.transform(body, lambda x: x["__piece"]), "\n")
    docs = sess.filter(F.col("__last").isNotNull()).select(
        *key, (F.col("__last") + 1).alias(line_col), text.alias("full_doc"))
    return targets.join(docs, [*key, line_col], "left") \
        .withColumn("full_doc", F.coalesce(F.col("full_doc"), F.lit("")))


# --- E4 ---------------------------------------------------------------------
def build_tags(ln: DataFrame, key: Sequence[str]) -> DataFrame:
    """Constraint text of ``//go:build`` / ``// +build`` lines, first-seen order, de-duplicated.

    ``old_style`` tells a ``+build`` line's grammar from the other.
    """
    t = F.trim(F.col("text"))
    tag = F.when(t.startswith("//go:build "), F.trim(F.substr(t, F.lit(12)))) \
        .when(t.startswith("// +build "), F.trim(F.substr(t, F.lit(11))))
    tags = ln.select(*key, "line_no", t.startswith("// +build ").alias("old_style"), tag.alias("tag")) \
        .filter(F.col("tag").isNotNull() & (F.col("tag") != ""))
    first = tags.groupBy(*key, "tag").agg(F.min("line_no").alias("first_line"),
                                          F.min_by("old_style", "line_no").alias("old_style"))
    w = Window.partitionBy(*key).orderBy("first_line")
    return first.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


# --- E5 ---------------------------------------------------------------------
# Platform and tool tags that discovery leaves out.
BUILTIN_TAGS = [
    "linux", "darwin", "windows", "freebsd", "openbsd", "netbsd", "dragonfly", "solaris", "plan9", "aix", "js",
    "amd64", "386", "arm", "arm64", "ppc64", "ppc64le", "mips", "mipsle", "mips64", "mips64le", "s390x", "riscv64",
    "wasm", "cgo", "race", "msan", "asan",
]


#: Tags are looked for in so many lines of a file.
HEADER_LINES = 20


def discover_tags(ln: DataFrame, key: Sequence[str], rel_dir_col: str) -> DataFrame:
    """Distinct custom tags named in the header lines (first 20, before ``package``).

    Files below a ``vendor`` or dot-directory are skipped; negated and
    builtin tags are dropped.  The builtin list is a literal array (fixed size).
    """
    t = F.trim(F.col("text"))
    pkg_line = F.min(F.when(t.startswith("package "), F.col("line_no"))).over(Window.partitionBy(*key))
    segs = F.split(F.col(rel_dir_col), "/")
    hidden = F.exists(segs, lambda s: (s == "vendor") | (s == ".git") | (s.startswith(".") & (s != ".") & (s != "")))
    expr = F.coalesce(F.regexp_extract(t, r"^//go:build\s+(.+)$", 1), F.lit(""))
    old = F.regexp_extract(t, r"^//\s*\+build\s+(.+)$", 1)
    h = ln.withColumn("__pkg", pkg_line).filter(
        (F.col("line_no") <= HEADER_LINES) & (F.col("__pkg").isNull() | (F.col("line_no") < F.col("__pkg"))) & ~hidden)
    exprs = h.select(F.explode(F.array(expr, old)).alias("e")).filter(F.col("e") != "")
    fields = exprs.select(F.explode(F.split(F.trim(F.regexp_replace("e", r"[()]|&&|\|\||,", " ")), r"\s+")).alias("tag"))
    builtins = F.array(*[F.lit(b) for b in BUILTIN_TAGS])
    return fields.filter((F.col("tag") != "") & ~F.col("tag").startswith("!") &
                         ~F.array_contains(builtins, F.col("tag"))).distinct()


# --- F8 ---------------------------------------------------------------------
def constraint_holds(expr: Column | str, tags: Sequence[str]) -> Column:
    """Evaluate a ``//go:build`` expression for the given tag set, in one pass over its tokens.

    ``!`` binds closer than ``&&``, that closer than ``||``.  A level of parens is what its alternatives and
    its present conjunction come to so far, and whether a ``!`` stands open; outer levels
    wait on a stack, a character each.  A malformed expression is null (caller quarantines it).
    """
    e = F.col(expr) if isinstance(expr, str) else expr
    names = ("any", "all", "no", "want", "bad", "stack")
    active = F.array(*[F.lit(t) for t in sorted(set(tags))]).cast("array<string>")

    def state(**v: Column) -> Column:
        return F.struct(*[v[n].alias(n) for n in names])

    def put(s: Column, **v: Column) -> Column:
        return state(**{n: v.get(n, s[n]) for n in names})

    yes, no = F.lit(True), F.lit(False)
    zero = state(any=no, all=yes, no=no, want=yes, bad=no, stack=F.lit(""))

    def closed(s: Column) -> Column:
        level = F.ascii(F.right(s["stack"], F.lit(1))) - F.lit(ord("0"))
        was = lambda bit: level.bitwiseAND(F.lit(bit)) > 0
        value = (s["any"] | s["all"]) != was(1)
        return state(any=was(4), all=was(2) & value, no=no, want=no, bad=s["stack"] == "",
                     stack=F.substring(s["stack"], F.lit(1), F.greatest(F.length(s["stack"]) - 1, F.lit(0))))

    def step(s: Column, t: Column) -> Column:
        bits = F.lit(ord("0")) + F.when(s["any"], 4).otherwise(0) + F.when(s["all"], 2).otherwise(0) + F.when(s["no"], 1).otherwise(0)
        operand = F.when(t == "!", put(s, no=~s["no"])) \
            .when(t == "(", state(any=no, all=yes, no=no, want=yes, bad=no, stack=F.concat(s["stack"], F.char(bits)))) \
            .when(t.rlike(r"^[\p{L}\p{N}_.]"), put(s, all=s["all"] & (F.array_contains(active, t) != s["no"]), no=no, want=no)) \
            .otherwise(put(s, bad=yes))
        operator = F.when(t == "&&", put(s, want=yes)).when(t == "||", put(s, any=s["any"] | s["all"], all=yes, want=yes)) \
            .when(t == ")", closed(s)).otherwise(put(s, bad=yes))
        return F.when(s["bad"], s).when(s["want"], operand).otherwise(operator)

    tokens = F.regexp_extract_all(e, F.lit(r"&&|\|\||[\p{L}\p{N}_.]++|[^\s]"), F.lit(0))
    return F.aggregate(tokens, zero, step, lambda s: F.when(~s["bad"] & ~s["want"] & (s["stack"] == ""), s["any"] | s["all"]))


def constraint_rejects(constraints: DataFrame, key: Sequence[str], expr_col: str, tags: Sequence[str]) -> DataFrame:
    """Quarantine rows of the constraints that can't be read."""
    return constraints.filter(F.col(expr_col).isNotNull() & constraint_holds(expr_col, tags).isNull()).select(
        *key, F.lit("build constraint").alias("stage"), F.concat(F.lit("malformed constraint "), F.substring(expr_col, 1, 200)).alias("message"))


def plus_build_to_expr(line: Column | str) -> Column:
    """Old form ``a,b c`` (space = or, comma = and) → ``(a&&b)||(c)``."""
    c = F.col(line) if isinstance(line, str) else line
    terms = F.split(F.trim(c), r"\s+")
    return F.array_join(F.transform(terms, lambda x: F.concat(F.lit("("), F.regexp_replace(x, ",", "&&"), F.lit(")"))), "||")
