"""Declarations and their members from the node table of :mod:`tree`.

Input assumption: top-level declarations start in column 0.  Rows that do
not delimit cleanly (block never closed) are returned as quarantine rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import comment_blocks
from .tree import IDENT, NAMES, choose, let, reveal, scan

# ordered classification of a declaration's first line: (kind, regex, name group); type
# parameters are taken out before (see _without_type_params)
_KINDS = [
    ("struct", rf"^type\s+({IDENT})\s+struct\s*\{{", 1),
    ("interface", rf"^type\s+({IDENT})\s+interface\s*\{{", 1),
    ("functype", rf"^type\s+({IDENT})\s+func\s*\(", 1),
    ("type", rf"^type\s+({IDENT})\s*=?\s*\S", 1),
    ("method", rf"^func\s*\([^)]*\)\s*({IDENT})", 1),
    ("func", rf"^func\s+({IDENT})", 1),
    ("var", r"^var\s*\(|^var\s+(" + IDENT + ")", 1),
    ("const", r"^const\s*\(|^const\s+(" + IDENT + ")", 1),
]
_OPEN, _CLOSE = "([{", ")]}"


# --- brackets of any depth ----------------------------------------------------
def even(depth: int, other: str = "") -> str:
    """Pattern of brackets that close, with others in them up to ``depth`` and no sign of ``other``: most need no fold.

    Repeats are counted, as a pattern's stack grows with them.
    """
    plain = rf"[^()\[\]{{}}{other}]"
    return rf"[(\[{{](?:{plain}++|{even(depth - 1, other)}){{0,60}}+[)\]}}]" if depth else rf"[(\[{{]{plain}*+[)\]}}]"


def _ends(piece: Column, signs: str) -> Column:
    return reduce(or_, [piece.endswith(sign) for sign in signs])


def balanced(s: Column) -> Column:
    """The bracketed beginning of ``s`` up to its matching bracket; empty if it begins with none or never closes."""
    short = F.regexp_extract(s, rf"^{even(2)}", 0)
    pieces = F.regexp_extract_all(s, F.lit(r"[^()\[\]{}]*[()\[\]{}]"), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(False).alias("done"))

    def step(a: Column, piece: Column) -> Column:
        depth = a["depth"] + F.when(_ends(piece, _OPEN), 1).otherwise(-1)
        return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (a["at"] + F.length(piece)).alias("at"),
                                                       (depth <= 0).alias("done")))

    return F.when(short != "", short).when(s.rlike(r"^[(\[{]"), F.aggregate(
        pieces, state, step, lambda a: F.when(a["done"], F.substr(s, F.lit(1), a["at"])).otherwise(""))).otherwise("")


def split_top(s: Column) -> Column:
    """Split a list on the commas outside all brackets, of any depth, in one pass; empty items are left out."""
    pieces = F.regexp_extract_all(s, F.lit(r"[^()\[\]{},]*+[()\[\]{},]|[^()\[\]{},]++"), F.lit(0))

    def step(depth: Column, piece: Column) -> tuple[Column, Column]:
        return (depth + F.when(_ends(piece, _OPEN), 1).when(_ends(piece, _CLOSE), -1).otherwise(0),
                F.when((depth == 0) & piece.endswith(","), F.concat(F.substr(piece, F.lit(1), F.length(piece) - 1), F.lit("\x01"))).otherwise(piece))

    marked = F.array_join(scan(pieces, F.lit(0), step, "string"), "")
    within = even(2, r"\x01")
    items = F.when(s.rlike(rf"\A(?:[^()\[\]{{}}\x01]++|{within}){{0,60}}+\z"), F.regexp_extract_all(s, F.lit(rf"(?:[^()\[\]{{}},\x01]++|{within}){{1,60}}+"), F.lit(0))) \
        .otherwise(F.split(marked, "\x01"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def _without_type_params(t: Column) -> Column:
    """``type G[T []int] struct`` → ``type G struct``; an array type (blank before its bracket) stays."""
    name = F.regexp_extract(t, rf"^(type\s+{IDENT})\[", 1)
    rest = F.substr(t, F.length(name) + 1)
    return F.when(name != "", F.concat(name, F.substr(rest, F.length(balanced(rest)) + 1))).otherwise(t)


def _kind_expr(t: Column) -> Column:
    # one cheap test first: only lines starting with a declaration keyword are classified
    e = None
    for kind, rx, _ in _KINDS:
        e = F.when(t.rlike(rx), F.lit(kind)) if e is None else e.when(t.rlike(rx), F.lit(kind))
    return F.when(t.rlike(r"^(?:type|func|var|const)\b"), e)


def _name_expr(t: Column, kind: Column) -> Column:
    e = None
    for k, rx, g in _KINDS:
        e = F.when(kind == k, F.regexp_extract(t, rx, g)) if e is None else e.when(kind == k, F.regexp_extract(t, rx, g))
    return e


# --- F6 ---------------------------------------------------------------------
_PREFIX = r"^(?:\s|\.\.\.|\*|&|\[\]|<-chan|chan<-|chan\s|chan|map\[[^\[\]]*\]|\()+"


def export_name(name: Column | str) -> Column:
    """Name without pointer/slice/chan/map/paren prefixes, type args and qualifier.

    Brackets inside brackets go first, a pass for each, so map keys may nest to
    any depth.  One anchored repetition then strips every leading prefix and
    opening paren; closing parens, type arguments and the package qualifier are
    cut after it.
    """
    n = F.trim(F.col(name) if isinstance(name, str) else name)
    count = F.length(n) - F.length(F.replace(n, F.lit("["), F.lit("")))
    n = F.when(count > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), n, lambda x, _: F.regexp_replace(
        x, r"(\[[^\[\]]*)\[[^\[\]]*\]", "$1"))).otherwise(n)
    s = F.regexp_replace(n, _PREFIX, "")
    s = F.regexp_replace(s, r"[\[)].*\z", "")
    s = F.regexp_replace(s, r"^.*\.", "")
    return F.trim(s)


def is_exported(name: Column | str) -> Column:
    return F.coalesce(export_name(name).rlike(r"^\p{Lu}"), F.lit(False))


# --- J1 key -----------------------------------------------------------------
def receiver_key(recv: Column | str) -> Column:
    """``*pkg.Foo[T]`` → ``Foo``; ``pkg.`` stays ``pkg.``."""
    r = F.col(recv) if isinstance(recv, str) else recv
    s = F.regexp_replace(F.trim(r), r"^[*&]+", "")
    s = F.regexp_replace(s, r"\[.*\z", "")
    s = F.when(s.rlike(r"\.[^.]"), F.regexp_replace(s, r"^.*\.", "")).otherwise(s)
    return F.trim(s)


# --- E6 ---------------------------------------------------------------------
def _clean_doc(body: Column) -> Column:
    """Collapse blank-line runs and trim leading/trailing blank lines of a doc."""
    return F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"^\n+|\n+\z", "")


def _one_line(text: Column) -> Column:
    """Text over several lines as one, without blanks and commas that only the line ends called for."""
    s = F.regexp_replace(F.regexp_replace(text, r"[^\S\n]*+\n\s*+", "\n"), r"^\s+|\s+\z", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "\n", " "), r"([(\[])\s+", "$1"), r",?\s+([)\]])", "$1")


def _classified(nodes: DataFrame) -> DataFrame:
    """The nodes that are declarations, with ``kind``, ``name``, ``__code`` and ``__bad``: what makes one a quarantine row, else null."""
    first = F.col("first") & F.col("word").isin("type", "func", "var", "const")
    own = nodes.filter((first & ~((F.col("word") == "type") & F.coalesce(F.col("lists") == "types", F.lit(False)) & ~F.col("left_open")))
                       | (F.col("inside") == "types"))
    # computed once for each row, behind a generator that later filters aren't moved below
    code = _one_line(F.when(F.col("inside") == "types", F.concat(F.lit("type "), F.ltrim(F.regexp_replace("head", r"^\s+", "")))).otherwise(F.col("head")))
    opens = F.when(F.col("lists").isin("struct", "interface"), "{").when(F.col("lists") == "values", "(").otherwise("")

    def known(c: Column) -> Column:
        return let(_without_type_params(F.concat(c, opens)), lambda t: let(_kind_expr(t), lambda kind: F.array(F.struct(
            c.alias("__code"), kind.alias("kind"), _name_expr(t, kind).alias("name")))))
    bad = F.when(F.col("left_open"), "block not closed before the next declaration").when(F.col("kind").isNull(), "declaration not recognised")
    return own.select("*", F.inline(let(code, known))).withColumn("__bad", bad)


def declaration_rejects(nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The quarantine rows of :func:`declarations`; the nodes need no ``text``."""
    return _rejects(_classified(nodes), key)


def _rejects(own: DataFrame, key: Sequence[str]) -> DataFrame:
    return own.filter(F.col("__bad").isNotNull()).select(*key, F.col("line").alias("decl_line"), F.lit("declarations").alias("stage"), F.col("__bad").alias("message"))


def declarations(nodes: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One row per top-level declaration and the quarantine rows, from :func:`tree.nodes` with ``text``.

    Columns: ``key, node, decl_line, end_line, kind, name, decl, full_decl, doc, exported,
    receiver, receiver_key``.  Declarations begin at a keyword in column 0, or are the specs of a
    ``type ( … )`` group.  One whose brackets don't close before the next keyword, or whose head is
    none of the known forms, is a quarantine row; each keyword gives one or the other.
    """
    own = _classified(nodes)
    rejects = _rejects(own, key)
    good = own.filter(F.col("__bad").isNull())
    # variables, constants and other types show their first line
    shown = F.substring_index(F.regexp_replace("text", r"^\s+", ""), "\n", 1)
    shown = F.when(F.col("lists") == "values", F.col("word")).otherwise(shown)
    shown = F.regexp_replace(F.when(F.col("inside") == "types", F.concat(F.lit("type "), shown)).otherwise(shown), r"\s+\z", "")
    head = F.when(F.col("kind").isin("func", "method", "functype"), F.col("__code")) \
        .when(F.col("kind").isin("struct", "interface"), F.concat("__code", F.when(F.col("hollow"), F.concat(F.regexp_extract("head", r"(\s?)\s*\z", 1), F.lit("{}"))).otherwise(""))) \
        .otherwise(shown)
    h = reveal(head)
    recv = F.when(F.col("kind") == "method", F.regexp_extract("__code", r"^func\s*\(([^)]*)\)", 1))
    decls = good.select(*key, "node", F.col("line").alias("decl_line"), "end_line", "kind", "name",
                        F.trim(F.regexp_replace(h, r"\s*[{(]\s*$", "")).alias("decl"), F.trim(F.regexp_replace(recv, r"^\s*" + IDENT + r"\s+", "")).alias("receiver"),
                        F.col("text").alias("full_decl"), _clean_doc(F.col("doc")).alias("doc"))
    decls = decls.withColumn("receiver_key", F.when(F.col("receiver").isNotNull(), receiver_key("receiver"))) \
        .withColumn("exported", F.when(F.col("name") == "", F.lit(False)).otherwise(is_exported("name")))
    return decls, rejects


def _member(head: Column) -> Column:
    """A member's text without its tag."""
    return F.regexp_replace(F.regexp_replace(head, r"\s*+\x04[^\x05]*+\x05\s*\z", ""), r"^\s+|\s+\z", "")


def _is_field(body: Column) -> Column:
    return body.rlike(rf"^{NAMES}\s+\S") | body.rlike(rf"^\*?{IDENT}(?:\.{IDENT})?\s*(?:\[(?s:.*)\])?$")


# --- E8 ---------------------------------------------------------------------
def fields(nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per field name from :func:`tree.nodes`; embedded fields have an empty name and the type as text.

    Members of a nested anonymous struct have ``depth`` + 1 and ``struct_path`` = the chain of enclosing
    field names (``Profile`` or ``Outer.Inner``); the field that opens it is ``anonymous``
    and has the tag after its ``}``.  A type over several lines is kept as written.
    """
    x = nodes.filter((F.col("inside") == "struct") & ~F.col("left_open") & _is_field(_member(F.col("head"))))
    opens = F.coalesce(F.col("lists") == "struct", F.lit(False))
    quoted = F.regexp_extract(F.when(opens, F.col("tail")).otherwise(F.col("head")), r"\x04([^\x05]*+)\x05\s*\z", 1)
    body = _member(F.col("head"))
    named = body.rlike(rf"^{NAMES}\s+\S")
    x = x.select(*key, "owner_line", "owner", F.col("line").alias("line_no"), F.col("depth").cast("long").alias("depth"), "struct_path",
                 F.col("doc").alias("member_doc"), F.when(named, F.regexp_extract(body, rf"^({NAMES})\s+", 1)).alias("names"),
                 reveal(F.when(named, F.trim(F.regexp_replace(body, rf"^{NAMES}\s+", ""))).otherwise(body)).alias("type_text"),
                 F.regexp_extract(reveal(quoted), r"(?s)^`(.*)`$", 1).alias("tag"), opens.alias("anonymous"), F.col("node").alias("__node"))
    ex = x.select(*[c for c in x.columns if c != "names"], F.posexplode_outer(F.split(F.coalesce("names", F.lit("")), r"\s*,\s*")).alias("name_pos", "name"))
    # fields of one line keep their order: positions go on from item to item
    return ex.withColumn("name_pos", F.shiftleft(F.col("__node").cast("long"), 20) + F.col("name_pos")).drop("__node") \
        .withColumn("exported", F.when(F.col("name") == "", is_exported("type_text")).otherwise(is_exported("name"))) \
        .withColumn("embedded", F.col("name") == "")


def member_rejects(nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Members of structs and interfaces that have none of the known forms: quarantine rows."""
    body = _member(F.col("head"))
    field, member = _is_field(body), body.rlike(rf"^(?:{IDENT}|[~(*\[])")
    bad = ((F.col("inside") == "struct") & ~field) | ((F.col("inside") == "interface") & ~member)
    return nodes.filter(bad & ~F.col("left_open")).select(
        *key, F.col("line").alias("decl_line"), F.lit("members").alias("stage"), F.lit("member not recognised").alias("message"))


# --- E9 / E10 ----------------------------------------------------------------
def spec_names(spec_text: Column | str) -> Column:
    """Left side of ``a, b T = 1, 2`` → ``array(a, b)``."""
    s = F.col(spec_text) if isinstance(spec_text, str) else spec_text
    lhs = F.regexp_extract(s, rf"^\s*({IDENT}(?:\s*,\s*{IDENT})*)", 1)
    return F.split(lhs, r"\s*,\s*")


def value_specs(nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per var / const name: ``key, line_no, kind, name, doc, exported``, from :func:`tree.nodes`.

    Specs are the items of a ``( … )`` group; any other var or const is one spec, over however
    many lines.  A spec's own doc comes before that of its group.
    """
    own = nodes.filter(F.col("word").isin("var", "const") & ~F.col("left_open"))
    top = F.col("first")
    group = top & F.coalesce(F.col("lists") == "values", F.lit(False))
    chunk = [*key, "chunk_line"]
    docs = own.filter(group).select(*chunk, F.col("doc").alias("group_doc"))
    inner = own.filter(F.col("inside") == "values").join(docs.hint("merge"), chunk, "left") \
        .select(*key, F.col("line").alias("line_no"), F.col("word").alias("kind"), "head", "doc", "group_doc")
    single = own.filter(top & ~group).select(*key, F.col("line").alias("line_no"), F.col("word").alias("kind"),
                                             F.regexp_replace("head", r"^(?:var|const)\s+", "").alias("head"), F.lit("").alias("doc"), F.col("doc").alias("group_doc"))
    names = inner.unionByName(single).select(*key, "line_no", "kind", "doc", "group_doc", F.explode(spec_names("head")).alias("name"))
    doc = F.when(F.col("doc") != "", F.col("doc")).otherwise(_clean_doc(F.col("group_doc")))
    return names.filter(F.col("name") != "").select(*key, "line_no", "kind", "name", doc.alias("doc"), is_exported("name").alias("exported"))


def const_values(specs: DataFrame, group_cols: Sequence[str], pos_col: str, expr_col: str) -> DataFrame:
    """Repeat the last expression for specs without one; counter = position from 0.

    Evaluated forms: ``k``, ``iota``, ``iota + k``, ``iota - k``, ``k << iota``,
    ``iota * k``; others keep the text and a null ``value``.
    """
    w = Window.partitionBy(*group_cols).orderBy(pos_col)
    x = specs.withColumn("iota", (F.row_number().over(w) - 1).cast("long")) \
        .withColumn("eff_expr", F.last(F.col(expr_col), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = F.regexp_replace(F.col("eff_expr"), r"\s+", "")
    iota = F.col("iota")
    x = x.withColumn("__k", F.regexp_extract(e, r"^(\d+)<<iota$", 1).cast("long"))
    num = lambda rx: F.regexp_extract(e, rx, 1).cast("long")
    value = (F.when(e.rlike(r"^-?\d+$"), e.cast("long"))
             .when(e == "iota", iota)
             .when(e.rlike(r"^iota\+\d+$"), iota + num(r"^iota\+(\d+)$"))
             .when(e.rlike(r"^iota-\d+$"), iota - num(r"^iota-(\d+)$"))
             .when(e.rlike(r"^\d+<<iota$"), F.col("__k") * F.pow(F.lit(2), iota).cast("long"))
             .when(e.rlike(r"^iota\*\d+$"), iota * num(r"^iota\*(\d+)$")))
    return x.withColumn("value", value).drop("__k")


def const_specs(nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Specs of ``const ( … )`` groups: one row per spec with ``names`` (left side), ``type_text`` and ``expr``
    (null when the spec repeats the previous one); ``pos`` = spec position in the group."""
    body = F.regexp_replace("head", r"^\s+|\s+\z", "")
    rest = F.trim(F.regexp_replace(body, rf"^{NAMES}", ""))
    typ = F.trim(F.regexp_extract(rest, r"^([^=]*)", 1))
    expr = F.when(rest.contains("="), reveal(F.trim(F.regexp_extract(rest, r"(?s)=(.*)$", 1))))
    w = Window.partitionBy(*key, "owner_line").orderBy("node")
    specs = nodes.filter((F.col("inside") == "values") & (F.col("word") == "const") & ~F.col("left_open") & body.rlike(rf"^{IDENT}")) \
        .select(*key, "owner_line", F.col("line").alias("line_no"), F.col("doc").alias("member_doc"), F.regexp_extract(body, rf"^({NAMES})", 1).alias("names"),
                F.when(typ != "", typ).alias("type_text"), expr.alias("expr"), "node")
    return specs.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


def const_decls(specs: DataFrame, key: Sequence[str]) -> DataFrame:
    """E10 rendered: ``name [type] = value`` per constant, the last expression and
    type repeated for specs without their own; unevaluated forms keep the text."""
    grp = [*key, "owner_line"]
    w = Window.partitionBy(*grp).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = const_values(specs, grp, "pos", "expr") \
        .withColumn("eff_type", F.last(F.when(F.col("expr").isNotNull(), F.coalesce("type_text", F.lit(""))),
                                       ignorenulls=True).over(w))
    x = x.select(*grp, "line_no", "node", "member_doc", "pos", "eff_type", "eff_expr", "value",
                 F.posexplode(F.split("names", r"\s*,\s*")).alias("name_pos", "name"))
    val = F.coalesce(F.col("value").cast("string"), F.col("eff_expr"))
    typ = F.when(F.coalesce("eff_type", F.lit("")) != "", F.concat(F.lit(" "), "eff_type")).otherwise(F.lit(""))
    return x.withColumn("decl", F.concat("name", typ, F.lit(" = "), val))


# --- E11 --------------------------------------------------------------------
def interface_members(nodes: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(methods, type-set terms) of interface bodies; terms de-duplicated first wins.

    A member that isn't a method is an element of the type set: a union, a
    single term or an embedded interface.
    """
    top = nodes.filter((F.col("inside") == "interface") & ~F.col("left_open") & F.col("head").rlike(rf"^\s*(?:{IDENT}|[~(*\[])")).select(
        *key, "owner_line", "owner", F.col("line").alias("line_no"), "node", F.col("doc").alias("member_doc"), reveal(_one_line(F.col("head"))).alias("__t"))
    method = F.col("__t").rlike(rf"^{IDENT}\s*\(")
    meth = top.filter(method).select(
        *key, "owner_line", "owner", "line_no", "node", "member_doc",
        F.regexp_extract("__t", rf"^({IDENT})", 1).alias("name"),
        F.regexp_extract("__t", rf"^{IDENT}\s*(\(.*)$", 1).alias("signature"))
    sets = top.filter(~method).select(
        *key, "owner_line", "owner", "node", F.posexplode(F.split("__t", r"\s*\|\s*")).alias("term_pos", "term"))
    sets = sets.withColumn("term", F.trim(F.regexp_replace("term", r"[()]", ""))).filter(F.col("term") != "")
    first = sets.groupBy(*key, "owner_line", "owner", "term").agg(
        F.min(F.struct("node", "term_pos")).alias("__f"))
    wt = Window.partitionBy(*key, "owner_line").orderBy("__f")
    terms = first.withColumn("pos", (F.row_number().over(wt) - 1).cast("long")).drop("__f")
    return meth, terms


def owner_methods(owners: DataFrame, methods: DataFrame, how: str = "left") -> DataFrame:
    """Methods met with their types by ``(package, owner)``; a method's ``owner`` is its receiver key.

    ``left`` keeps types without methods, ``inner`` drops them, and ``left_semi``
    / ``left_anti`` give the types that have any / none.
    """
    # neither side is broadcast: both grow with the corpus, and a table made from compressed rows looks small to the planner
    return owners.join(methods.hint("merge"), ["package", "owner"], how)


def method_heads(meth: DataFrame) -> DataFrame:
    """Interface methods in the shape of declarations, for :func:`signature_parts`."""
    return meth.select("*", F.col("line_no").alias("decl_line"), F.lit("interface_method").alias("kind"),
                       F.concat(F.lit("func "), "name", "signature").alias("decl"))


# --- E12 --------------------------------------------------------------------
def param_rows(lists: DataFrame, key: Sequence[str], list_col: str = "list_text",
               group: Sequence[str] = ("decl_line", "role"), carry: Sequence[str] = ()) -> DataFrame:
    """One row per parameter of ``list_col`` with name and type; ``a, b T`` gives two.

    ``lists`` has one row per (key, decl_line, role) list; all roles are
    handled in one pass, each list inside its row.  An
    empty list keeps one row with a null ``pos`` so every declaration stays
    present downstream (``carry`` columns ride along).
    """
    grp = [*key, *group]

    def pairs(items: Column) -> Column:
        def of(named: Column) -> Column:
            return F.transform(items, lambda x: F.struct(
                F.when(named, F.regexp_extract(x, rf"^({IDENT})", 1)).otherwise("").alias("name"),
                F.when(named, F.nullif(F.trim(F.regexp_replace(x, rf"^{IDENT}\s*", "")), F.lit(""))).otherwise(x).alias("type_text")))
        return let(F.exists(items, lambda x: x.rlike(rf"^(?!(?:chan|func|struct|interface|map)\b){IDENT}\s+\S")), of)

    def filled(all_pairs: Column) -> Column:
        """A name without a type has that of the next one with a type."""
        def step(after: Column, p: Column) -> tuple[Column, Column]:
            kind = F.coalesce(p["type_text"], after)
            return kind, F.struct(p["name"].alias("name"), kind.alias("type_text"))
        last = F.lit(None).cast("string")
        return choose((F.forall(all_pairs, lambda p: p["type_text"].isNotNull()), all_pairs),
                      otherwise=F.reverse(scan(F.reverse(all_pairs), last, step, "struct<name:string,type_text:string>")))
    return lists.select(*grp, *carry, F.posexplode_outer(let(let(split_top(F.col(list_col)), pairs), filled)).alias("pos", "p")) \
        .select(*grp, *carry, F.col("pos").cast("long").alias("pos"), "p.name", "p.type_text")


def signature_lists(sig: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, decl_line, kind, decl_name, role, list_text) for receiver / param / result / type_param lists."""
    roles = F.array(
        F.struct(F.lit("receiver").alias("role"), F.col("recv_text").alias("list_text")),
        F.struct(F.lit("param").alias("role"), F.col("params_text").alias("list_text")),
        F.struct(F.lit("result").alias("role"), F.col("results_text").alias("list_text")),
        F.struct(F.lit("type_param").alias("role"), F.col("type_params_text").alias("list_text")))
    return sig.select(*key, "decl_line", "kind", F.col("name").alias("decl_name"), F.explode(roles).alias("r")) \
        .select(*key, "decl_line", "kind", "decl_name", "r.role", F.coalesce("r.list_text", F.lit("")).alias("list_text"))


def signature_parts(decls: DataFrame) -> DataFrame:
    """Receiver, type params, params and results text of func / method / functype declarations, by matching brackets of any depth."""
    def inside(c: str) -> Column:
        return F.substr(F.col(c), F.lit(2), F.length(c) - 2)

    def after(text: str, part: str) -> Column:
        return F.ltrim(F.substr(F.col(text), F.length(part) + 1))

    x = decls.withColumn("__s", F.regexp_replace("decl", r"^(?:func|type)\s*", "")) \
        .withColumn("__r", F.when(F.col("kind") == "method", balanced(F.col("__s"))).otherwise("")) \
        .withColumn("__s", F.regexp_replace(after("__s", "__r"), rf"^{IDENT}", "")) \
        .withColumn("__t", F.when(F.col("__s").startswith("["), balanced(F.col("__s"))).otherwise("")) \
        .withColumn("__s", F.regexp_replace(after("__s", "__t"), r"^(?:=\s*)?func\s*(?=\()", "")) \
        .withColumn("__p", balanced(F.col("__s"))).withColumn("__s", F.trim(after("__s", "__p"))) \
        .withColumn("__q", balanced(F.col("__s")))
    results = F.when(F.col("__s").startswith("(") & (F.length("__q") == F.length("__s")), inside("__q")).otherwise(F.col("__s"))
    return x.withColumns({"recv_text": F.when(F.col("kind") == "method", inside("__r")), "type_params_text": inside("__t"),
                          "params_text": inside("__p"), "results_text": results}).drop("__s", "__r", "__t", "__p", "__q")


# --- E13 --------------------------------------------------------------------
# Type kinds.
def type_kind(type_text: Column | str) -> Column:
    t = F.trim(F.col(type_text) if isinstance(type_text, str) else type_text)
    return (F.when(t == "", "unknown")
            .when(t.startswith("*"), "pointer")
            .when(t.startswith("..."), "ellipsis")
            .when(t.startswith("[]"), "slice")
            .when(t.rlike(r"^\[[^\]]+\]"), "array")
            .when(t.startswith("map["), "map")
            .when(t.rlike(r"^(<-\s*)?chan\b"), "chan")
            .when(t.rlike(r"^func\s*\("), "func")
            .when(t.rlike(r"^struct\s*\{"), "struct")
            .when(t.rlike(r"^interface\s*\{"), "interface")
            .when(t.startswith("("), "paren")
            .when(t.rlike(r"[|]"), "binary")
            .when(t.rlike(r"^[\w.]+\[[^\]]*,[^\]]*\]$"), "index-list")
            .when(t.rlike(r"^[\w.]+\[[^\]]*\]$"), "index")
            .when(t.rlike(rf"^{IDENT}\.{IDENT}$"), "selector")
            .when(t.rlike(rf"^{IDENT}$"), "ident")
            .otherwise("unknown"))


def type_element(type_text: Column | str) -> Column:
    """Element text: after ``*``, ``[]``, ``[N]``, ``...``, ``chan``; value of a map."""
    t = F.trim(F.col(type_text) if isinstance(type_text, str) else type_text)
    return (F.when(t.startswith("*"), F.substr(t, F.lit(2)))
            .when(t.startswith("..."), F.substr(t, F.lit(4)))
            .when(t.rlike(r"^\[[^\]]*\]"), F.regexp_replace(t, r"^\[[^\]]*\]", ""))
            .when(t.startswith("map["), F.regexp_replace(t, r"^map\[(?:[^\[\]]|\[[^\[\]]*\])*\]", ""))
            .when(t.rlike(r"^(<-\s*)?chan\b"), F.trim(F.regexp_replace(t, r"^(?:<-\s*)?chan(?:\s*<-)?\s*", ""))))


def type_key(type_text: Column | str) -> Column:
    t = F.trim(F.col(type_text) if isinstance(type_text, str) else type_text)
    return F.when(t.startswith("map["), F.regexp_extract(t, r"^map\[((?:[^\[\]]|\[[^\[\]]*\])*)\]", 1))


# --- E14 --------------------------------------------------------------------
_KEYWORDS = ["map", "chan", "func", "struct", "interface"]


def type_refs(df: DataFrame, key: Sequence[str], type_col: str) -> DataFrame:
    """Every (optionally qualified) identifier in a type text with its position."""
    ids = F.regexp_extract_all(F.col(type_col), F.lit(rf"({IDENT}(?:\.{IDENT})?)"), 1)
    ids = F.filter(ids, lambda s: ~s.isin(*_KEYWORDS))
    return df.select(*key, type_col, F.posexplode(ids).alias("ref_pos", "ref")) \
        .withColumn("ref_pos", F.col("ref_pos").cast("long")) \
        .withColumn("qualifier", F.when(F.col("ref").contains("."), F.substring_index("ref", ".", 1))) \
        .withColumn("ident", F.substring_index("ref", ".", -1))


# --- E15 --------------------------------------------------------------------
def tag_value(tag: Column | str, key: str) -> Column:
    """Value of ``key`` in a ``key:"value"`` list (back-ticks ignored), '' when absent."""
    import re
    t = F.regexp_replace(F.col(tag) if isinstance(tag, str) else tag, "`", "")
    rx = r'(?:^|\s)' + re.escape(key) + r':"((?:[^"\\]|\\.)*)"'
    return F.regexp_extract(t, rx, 1)


# --- E7 ---------------------------------------------------------------------
def import_part(files: DataFrame, content_col: str = "content") -> DataFrame:
    """``files`` with texts up to the end of the last import, for :func:`imports`: nothing behind it says anything about imports.

    That is the last line that begins with ``import``, and the lines from there to before the first closing paren in column 0.
    """
    text = F.col(content_col)
    last = F.regexp_extract(text, r"(?s)\A(?:.*\n)?import[^\n]*+", 0)
    block = F.regexp_extract(F.substr(text, F.length(last) + 1), r"\A(?:\n(?!\))[^\n]*+)*+", 0)
    return files.withColumn(content_col, F.when(last != "", F.concat(last, block)).otherwise(F.when(text.isNotNull(), "")))


def imports(ln: DataFrame, key: Sequence[str], docs: bool = True) -> DataFrame:
    """Import specs (block or single-line form): ``key, line_no, pos, alias, import_path, doc``; without ``docs`` no ``doc``, and no comment is looked at."""
    w = Window.partitionBy(*key).orderBy("line_no")
    t = F.col("text")
    start = F.when(t.rlike(r"^import\s*\(\s*$"), F.lit(1)).when(t.rlike(r"^\)"), F.lit(0))
    x = ln.withColumn("__st", F.last(start, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spec_rx = r'^\s*(?:import\s+)?(?:([A-Za-z_][A-Za-z0-9_]*|\.)\s+)?"([^"]*)"'
    in_block = (F.col("__st") == 1) & ~t.rlike(r"^\)")
    single = t.rlike(r'^import\s+(?:[A-Za-z_.][A-Za-z0-9_]*\s+)?"')
    specs = x.filter((in_block & t.rlike(spec_rx)) | single)
    out = specs.select(*key, "line_no", F.regexp_extract(t, spec_rx, 1).alias("alias"),
                       F.regexp_extract(t, spec_rx, 2).alias("import_path"))
    if docs:
        blocks = comment_blocks(ln, key).select(*key, (F.col("block_end") + 1).alias("line_no"), "doc")
        out = out.join(blocks.hint("merge"), [*key, "line_no"], "left").withColumn("doc", F.coalesce("doc", F.lit("")))
    return out.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


def import_prefix(alias: Column | str, import_path: Column | str) -> Column:
    """Alias if given, else the last path segment."""
    a = F.col(alias) if isinstance(alias, str) else alias
    p = F.col(import_path) if isinstance(import_path, str) else import_path
    return F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(F.substring_index(p, "/", -1))
