"""Linked type texts and signatures (J8, J13, W2): identifiers are linked by joins and put back in place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anchor_id, escape_entities, module_short_name
from .decls import balanced, interface_members, method_heads, param_rows, signature_lists, signature_parts, split_top
from .modules import explode_slash_prefixes
from .refs import BUILTIN_TYPES, EXTERNAL_DOC_URL
from .tree import IDENT, choose, let, one_of, scan
from ..sources.sinks import kept

#: Link modes: none, anchors of known modules, and these with documentation URLs of other packages.
MODES = ("off", "internal", "external")
#: Tasks that the files importing one path are spread over.
SPREAD = 16


#: Texts without ``func``, ``struct``, ``interface``, numbers and braces whose square brackets are empty or right behind a name; repeats are counted, as a pattern's stack grows with them.
_NAME = r"[A-Za-z_][A-Za-z0-9_]*+"
_ALL_NAMES = rf"\A(?:[^A-Za-z0-9_\[{{}}]++|\[\]|(?!(?:func|struct|interface)\b|chan\[){_NAME}(?:\.{_NAME})?+\[?+){{0,60}}+\z"


# --- positions ----------------------------------------------------------------
def type_pieces(text: Column) -> Column:
    """A type text cut into ``(piece, ident)``; together the pieces are the text.

    Identifiers (qualified ones whole) are apart from the rest.  ``ident`` is false for
    keywords, for the length of an array, and inside function, struct and interface types,
    which are not looked into.
    """
    name = rf"{IDENT}(?:\.{IDENT})?"
    pieces = F.regexp_extract_all(text, F.lit(rf"({name}|[0-9][A-Za-z0-9_.]*|[()\[\]{{}},]|[^A-Za-z0-9_()\[\]{{}},]+)"), 1)
    # depth; depth in which a function type goes on (-1: none); depth of brackets that are not looked into (-1: none); an identifier came just before
    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("func"), F.lit(-1).alias("shut"), F.lit(False).alias("named"), F.lit("").alias("last"))

    def step(s: Column, p: Column) -> tuple[Column, Column]:
        word, opens, closes = p.rlike(rf"^{IDENT}"), one_of(p, "(", "[", "{"), one_of(p, ")", "]", "}")
        plain = (s["func"] >= 0) | (s["shut"] >= 0)
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        func = F.when((s["func"] < 0) & (p == "func"), s["depth"]).when((closes & (depth < s["func"])) | ((p == ",") & (s["depth"] == s["func"])), -1).otherwise(s["func"])
        body = (p == "{") & one_of(s["last"], "struct", "interface")
        length = (p == "[") & ~s["named"]
        shut = F.when((s["shut"] < 0) & (body | length), s["depth"]).when(closes & (depth <= s["shut"]), -1).otherwise(s["shut"])
        after = F.struct(depth.alias("depth"), func.alias("func"), shut.alias("shut"), (word & ~one_of(p, "chan", "struct", "interface", "func")).alias("named"),
                         F.when(F.trim(p) == "", s["last"]).otherwise(p).alias("last"))
        ident = word & ~plain & ~one_of(p, "map", "chan", "func", "struct", "interface")
        return after, F.struct(p.alias("piece"), ident.alias("ident"))
    # a name alone, or with signs before it, needs no fold
    signs, word = F.regexp_extract(text, rf"\A([^A-Za-z0-9_()\[\]{{}},]*+){name}\z", 1), F.regexp_extract(text, rf"({name})\z", 1)
    own = F.struct(word.alias("piece"), (~one_of(word, "map", "chan", "func", "struct", "interface")).alias("ident"))
    short = F.when(signs == "", F.array(own)).otherwise(F.array(F.struct(signs.alias("piece"), F.lit(False).alias("ident")), own))
    # nor does a text without function, struct and interface types and array lengths: all its names count
    every = F.transform(pieces, lambda p: F.struct(p.alias("piece"), (p.rlike(rf"^{IDENT}") & ~one_of(p, "map", "chan")).alias("ident")))
    return F.when(text.rlike(rf"\A[^A-Za-z0-9_()\[\]{{}},]*+{name}\z"), short).when(text.rlike(_ALL_NAMES), every) \
        .otherwise(scan(pieces, start, step, "struct<piece:string,ident:boolean>"))


# --- J8 -----------------------------------------------------------------------
def _targets(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """``paths(import_path)``, distinct -> the longest module name that is the path or a part of it up to a ``/``."""
    names = modules.select(F.col("name").alias("__pre")).filter(F.col("name") != "").distinct()
    return explode_slash_prefixes(paths, "import_path", "__pre").join(names, "__pre").groupBy("import_path") \
        .agg(F.max_by("__pre", F.length("__pre")).alias("__module"))


def linked_texts(rows: DataFrame, key: Sequence[str], text_col: str, file: Sequence[str], aliases: DataFrame, modules: DataFrame, own_package: Column,
                 scope: DataFrame | None = None, scope_key: Sequence[str] = (), mode: str = "external", separate: bool = False, html: bool = False) -> DataFrame:
    """``rows`` with ``linked``: ``text_col`` with its identifiers linked, the rest in place.

    ``key`` identifies a row, ``file`` are the columns by which ``aliases(file…, alias_key, import_path)``, one row for each key, belong to it, and
    ``scope(scope_key…, name)`` are the type parameters in force (the declaration's own and its owner's).
    Type parameters, builtin types and unknown aliases stay plain.  Own names link to their anchor in ``own_package``; names of a
    package in one of ``modules(name)`` to an anchor, with ``separate`` documents to that module's
    file; all others to their documentation if ``mode`` is ``external``.  ``html`` gives
    markup instead of document links.  With ``mode`` ``off`` nothing is joined.
    """
    if mode not in MODES:
        raise ValueError(f"link mode {mode!r} is none of {MODES}")
    escape = escape_entities if html else (lambda c: c)
    if mode == "off":
        return rows.withColumn("linked", escape(F.col(text_col)))
    # the imports of a file with their modules are a map, the names in force a set, and both meet the rows: a text is cut, linked and put together
    # in its row.  A path that very many files import is spread over SPREAD tasks.  Nothing that grows with the corpus is broadcast.
    targets = _targets(aliases.select("import_path").distinct(), modules).withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    known = aliases.select(*file, "alias_key", "import_path").withColumn("__turn", F.pmod(F.xxhash64(*file), F.lit(SPREAD)).cast("int")) \
        .join(targets.hint("merge"), ["import_path", "__turn"], "left") \
        .groupBy(*file).agg(F.map_from_entries(F.collect_list(F.struct("alias_key", F.struct("import_path", "__module")))).alias("__known"))
    x = rows.withColumn("__own", own_package)
    if scope is not None:
        x = x.join(scope.groupBy(*scope_key).agg(F.collect_set("name").alias("__params")).hint("merge"), list(scope_key), "left")
    else:
        x = x.withColumn("__params", F.lit(None).cast("array<string>"))
    x = x.join(known.hint("merge"), list(file), "left")

    def link(to: Column, name: Column) -> Column:
        return F.concat(F.lit('<a href="'), to, F.lit('">'), escape(name), F.lit("</a>"))

    def other(piece: Column, path: Column, module: Column) -> Column:
        """A qualified name, of a package in a module or another one."""
        name = F.substring_index(piece, ".", -1)
        there, url = anchor_id(path, name), F.concat(F.lit(EXTERNAL_DOC_URL), path, F.lit("#"), name)
        if html:
            dotted = F.concat(escape(F.substring_index(piece, ".", 1)), F.lit("."))
            inner, outer = F.concat(dotted, link(F.concat(F.lit("#"), there), name)), F.concat(dotted, link(url, name))
        else:
            file_link = F.format_string("link:%s.adoc#%s[%s]", module_short_name(module), there, piece)
            inner = file_link if separate else F.format_string("<<%s,%s>>", there, piece)
            outer = F.concat(F.lit("link:"), url, F.lit("["), piece, F.lit("]"))
        return choose((module.isNotNull(), inner), (path.isNotNull() & F.lit(mode == "external"), outer), otherwise=escape(piece))

    def own(piece: Column) -> Column:
        here = anchor_id(F.col("__own"), piece)
        return link(F.concat(F.lit("#"), here), piece) if html else F.format_string("<<%s,%s>>", here, piece)

    def text(p: Column) -> Column:
        return let(p["piece"], lambda piece: choose(
            (~p["ident"] | piece.isin(*BUILTIN_TYPES) | F.coalesce(F.array_contains("__params", piece), F.lit(False)), escape(piece)),
            (~piece.contains("."), own(piece)),
            otherwise=let(F.col("__known")[F.substring_index(piece, ".", 1)], lambda t: other(piece, t["import_path"], t["__module"]))))
    x = x.withColumn("__texts", F.transform(type_pieces(F.col(text_col)), text)).drop("__own", "__params", "__known")
    # where a key stands more than once, the pieces of all its texts are one text
    same = Window.partitionBy(*key)
    x = x.withColumn("__n", F.count(F.lit(1)).over(same)).withColumn("__all", F.collect_list(F.when(F.col("__n") > 1, F.struct("__texts"))).over(same))
    placed = F.flatten(F.transform("__all", lambda a: F.transform(a["__texts"], lambda t, i: F.struct(i.alias("k"), F.coalesce(t, F.lit("")).alias("v")))))
    whole = F.coalesce(F.array_join(F.when(F.col("__n") == 1, F.col("__texts")).otherwise(F.sort_array(placed)["v"]), ""), F.lit(""))
    keyed = reduce(and_, [F.col(c).isNotNull() for c in key])
    return x.withColumn("linked", F.when(keyed, whole)).select(*rows.columns, "linked")


# --- J13 ----------------------------------------------------------------------
def owner_type_params(methods: DataFrame, types: DataFrame, package: Sequence[str]) -> DataFrame:
    """``methods(package…, receiver_key, …)`` with ``owner_kind`` and ``owner_params``: those of the struct of that name in the package, else of the named type.

    ``types(package…, kind, name, type_params)``; where a package declares a name twice the
    first by text counts.  Methods without a known owner keep nulls.
    """
    def of(kind: str, prefix: str) -> DataFrame:
        return types.filter(F.col("kind") == kind).groupBy(*package, F.col("name").alias("receiver_key")) \
            .agg(F.min(F.struct(F.col("type_params"))).alias(prefix))
    x = methods.join(of("struct", "__s").hint("merge"), [*package, "receiver_key"], "left").join(of("type", "__t").hint("merge"), [*package, "receiver_key"], "left")
    return x.withColumn("owner_kind", F.when(F.col("__s").isNotNull(), "struct").when(F.col("__t").isNotNull(), "type")) \
        .withColumn("owner_params", F.coalesce(F.col("__s.type_params"), F.col("__t.type_params"))).drop("__s", "__t")


def type_params(decls: DataFrame) -> DataFrame:
    """Struct and named type declarations with ``type_params``, the text between their brackets."""
    rest = F.regexp_replace("decl", rf"^type\s+{IDENT}", "")
    own = F.when(rest.startswith("["), balanced(rest)).otherwise("")
    return decls.filter(F.col("kind").isin("struct", "type", "interface")).withColumn("type_params", F.substr(own, F.lit(2), F.length(own) - 2))


def names_of(df: DataFrame, text: str) -> DataFrame:
    """A row for each ``name`` in a type parameter list."""
    return df.withColumn("name", F.explode(F.transform(split_top(F.col(text)), lambda p: F.regexp_extract(p, rf"^({IDENT})", 1))))


def signature_params(nodes: DataFrame, decls: DataFrame, key: Sequence[str], package: Sequence[str], aliases: DataFrame, modules: DataFrame, own_package: Column,
                     mode: str = "external", separate: bool = False, html: bool = False) -> DataFrame:
    """E12 rows of all signatures of a node table (functions, methods, function types, interface methods) with linked types.

    A declaration's scope holds its own type parameters, its owner's (by ``package`` and receiver) and, for
    an interface's method, the interface's.
    """
    one = [*key, "node"]
    heads = [*one, "decl_line", "kind", "name", "decl"]
    members = interface_members(nodes, key)[0]
    funcs = decls.filter(F.col("kind").isin("func", "method", "functype"))
    parts = signature_parts(funcs.select(heads).unionByName(method_heads(members).select(heads)))
    rows = kept(param_rows(signature_lists(parts, one), one, carry=["kind", "decl_name"]))  # read twice below
    generic = type_params(decls)
    owners = owner_type_params(decls.filter(F.col("kind") == "method"), generic, package)
    of_interface = members.join(generic.filter("kind = 'interface'").select(*key, F.col("name").alias("owner"), F.col("decl_line").alias("owner_line"), "type_params").hint("merge"),
                                [*key, "owner", "owner_line"])
    scope = names_of(owners.filter("owner_params != ''"), "owner_params").select(*one, "name") \
        .unionByName(names_of(of_interface.filter("type_params != ''").drop("name"), "type_params").select(*one, "name")) \
        .unionByName(rows.filter("role = 'type_param' and name is not null").select(*one, "name"))
    typed = (F.col("role") != "type_param") & F.col("pos").isNotNull()
    linked = linked_texts(rows.withColumn("__text", F.when(typed, F.col("type_text"))), [*one, "role", "pos"], "__text", key, aliases, modules, own_package, scope, one, mode, separate, html)
    return linked.withColumn("type_text", F.when(typed, F.col("linked")).otherwise(F.col("type_text"))).drop("__text", "linked")


# --- W2 -----------------------------------------------------------------------
_TOKEN = "struct<kind:string,content:string>"


def signature_tokens(signatures: DataFrame) -> DataFrame:
    """``signatures(kind, name, recv, tparams, params, results, n_res)`` with ``tokens``, an array of ``(kind, content)``.

    Parameter, receiver and result texts come as markup (linked); name and keywords are escaped here.
    """
    def token(kind: str, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), content.alias("content"))
    name = escape_entities(F.concat("name", F.when(F.col("tparams") != "", F.concat(F.lit("["), "tparams", F.lit("]"))).otherwise("")))
    params = token("params", F.concat(F.lit("("), "params", F.lit(")")))
    results = F.when(F.col("n_res") == 1, F.col("results")).otherwise(F.concat(F.lit("("), "results", F.lit(")")))
    after = F.when(F.col("n_res") > 0, F.array(token("gap", F.lit(" ")), token("result", results))).otherwise(F.array().cast(f"array<{_TOKEN}>"))
    recv = F.when(F.col("recv") != "", F.array(token("receiver", F.concat(F.lit("("), "recv", F.lit(") "))))).otherwise(F.array().cast(f"array<{_TOKEN}>"))
    blank, func = token("text", F.lit(" ")), token("keyword", F.lit("func"))
    functype = F.array(token("keyword", F.lit("type")), blank, token("typename", name), blank, func, params)
    tokens = F.when(F.col("kind") == "functype", F.concat(functype, after)) \
        .when(F.col("kind") == "interface_method", F.concat(F.array(token("name", name), params), after)) \
        .otherwise(F.concat(F.array(func, blank), recv, F.array(token("name", name), params), after))
    return signatures.withColumn("tokens", F.filter(tokens, lambda t: t["content"] != ""))


# Classes of the tokens.
_CLASSES = {"keyword": "hljs-keyword", "name": "hljs-title", "typename": "hljs-title", "receiver": "hljs-params", "params": "hljs-params", "result": "hljs-type"}


def highlight_blocks(tokens: Column, kind: Column) -> Column:
    """Array of ``(block, wrapper, class, content)``: neighbours with the same wrapper are one block.

    Being inside a function carries from token to token: the keyword ``func`` (in an interface's method its name, in
    a function type also the parameters) begins it, the result ends it.
    """
    like = one_of(kind, "func", "method", "interface_method")
    function = F.lit("hljs-function")
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("block"), F.lit(None).cast("string").alias("wrapper"))
    out = "struct<block:int,wrapper:string,class:string,content:string>"

    def begins_at(t: Column) -> Column:
        k = t["kind"]
        return ((k == "keyword") & (t["content"] == "func")) | ((k == "name") & (kind == "interface_method")) | ((k == "params") & (kind == "functype"))

    def wraps_at(k: Column, inside: Column) -> Column:
        return choose((one_of(k, "keyword", "text"), inside), (one_of(k, "name", "params"), inside | like), (k == "receiver", inside | one_of(kind, "func", "method")), otherwise=F.lit(False))

    def class_of(k: Column) -> Column:
        return choose(*[(k == name, F.lit(value)) for name, value in _CLASSES.items()], otherwise=F.lit(""))

    def step(s: Column, t: Column) -> tuple[Column, Column]:
        k = t["kind"]
        inside = ~one_of(k, "gap", "result") & (s["inside"] | begins_at(t))
        wrapper = F.when(wraps_at(k, inside), function).otherwise("")
        block = s["block"] + F.when(s["wrapper"].eqNullSafe(wrapper), 0).otherwise(1)
        return (F.struct(inside.alias("inside"), block.alias("block"), wrapper.alias("wrapper")),
                F.struct(block.alias("block"), wrapper.alias("wrapper"), class_of(k).alias("class"), t["content"].alias("content")))

    # where nothing begins a function after a result, it is the tokens from the first that begins one to before the first that ends one: no fold
    def at_once(first: Column, stop: Column) -> Column:
        wraps = F.transform(tokens["kind"], lambda k, i: wraps_at(k, (first > 0) & (i + 1 >= first) & ((stop == 0) | (i + 1 < stop))))

        def cut(w: Column) -> Column:
            turns = F.filter(F.transform(w, lambda x, i: F.when((i > 0) & (x != F.get(w, i - 1)), i)), lambda i: i.isNotNull())
            return let(turns, lambda at: F.transform(tokens, lambda t, i: F.struct(
                (F.size(F.filter(at, lambda k: k <= i)) + 1).alias("block"), F.when(F.get(w, i), function).otherwise("").alias("wrapper"),
                class_of(t["kind"]).alias("class"), t["content"].alias("content"))))
        return let(wraps, cut)

    def by_form(b: Column, e: Column) -> Column:
        first, stop = F.array_position(b, True), F.array_position(e, True)
        last = F.when(first > 0, F.size(b) + 1 - F.array_position(F.reverse(b), True)).otherwise(0)
        return choose(((F.size(tokens) <= 64) & ((stop == 0) | (last < stop)), at_once(first, stop).cast(f"array<{out}>")), otherwise=scan(tokens, start, step, out))
    return let(F.transform(tokens, begins_at), lambda b: let(F.transform(tokens["kind"], lambda k: one_of(k, "gap", "result")), lambda e: by_form(b, e)))


def block_markup(blocks: Column) -> Column:
    """The blocks as nested spans."""
    def span(css: Column, text: Column) -> Column:
        return F.when(css == "", text).otherwise(F.concat(F.lit('<span class="'), css, F.lit('">'), text, F.lit("</span>")))
    ids = F.array_distinct(blocks["block"])

    def block(i: Column) -> Column:
        return let(F.filter(blocks, lambda b: b["block"] == i),
                   lambda own: span(F.get(own, F.lit(0))["wrapper"], F.array_join(F.transform(own, lambda b: span(b["class"], b["content"])), "")))
    return F.array_join(F.transform(ids, block), "")
