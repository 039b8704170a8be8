"""Package documents: every section with its members, as ordered rows of text.

A document is never one string.  Each heading, block, table and doc is a row, and rows are sorted by
``ORDER``; the sinks write them as lines.  Layouts end a block with one blank line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import anchor_id, tabify_first, tabify_last, trim_newlines
from ..operators import aggregates as A
from ..operators import decls as D
from ..operators import examples as EX
from ..operators import lines as L
from ..operators import links as LK
from ..operators import refs as R
from ..operators.tree import nodes
from ..operators.windows import SECTION_ORDER_DEFAULT
from ..sources.sinks import kept

#: Order of a document's rows: section, then item (file and place), part of the item, and place in the part.
ORDER = ["section", "path", "node", "part", "sub_path", "pos"]

# Headings of the sections.
HEADINGS = {"imports": "Imports", "interfaces": "Interfaces", "structs": "Structs", "types": "Variable Typedefinitions", "consts": "Constants",
            "functypes": "Function Definitions", "vars": "Variables", "functions": "Functions"}
_SECTION = {s: i for i, s in enumerate(SECTION_ORDER_DEFAULT)}
_KINDS = {"interface": "interfaces", "struct": "structs", "type": "types", "functype": "functypes", "func": "functions"}


def _source(text: Column) -> Column:
    return F.concat(F.lit("[source, go]\n----\n"), text, F.lit("\n----"))


def _section_of(kind: Column) -> Column:
    out = None
    for k, s in _KINDS.items():
        out = F.when(kind == k, _SECTION[s]) if out is None else out.when(kind == k, _SECTION[s])
    return out


def _rows(df: DataFrame, section: Column, part: int, text: Column, path: str | Column = "path", node: str | Column = "node",
          sub: str | Column = "", pos: Column | None = None, tight: Column | None = None) -> DataFrame:
    """Rows of a document; an empty text is none.  A ``tight`` row follows without a blank line."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    out = df.select("package", section.cast("int").alias("section"), col(path).alias("path"), col(node).cast("long").alias("node"), F.lit(part).alias("part"),
                    (F.lit("") if isinstance(sub, str) and not sub else col(sub)).alias("sub_path"), (F.lit(0) if pos is None else pos).cast("long").alias("pos"),
                    F.coalesce(tight, F.lit(False)).alias("tight") if tight is not None else F.lit(False).alias("tight"), text.alias("text"))
    return out.filter(F.coalesce("text", F.lit("")) != "")


def document_lines(rows: DataFrame) -> DataFrame:
    """The rows of a document as its lines: ``package``, ``ORDER``, ``line`` (in the row) and ``text``."""
    text = F.concat(F.when(F.col("tight"), F.array().cast("array<string>")).otherwise(F.array(F.lit(""))), F.split("text", "\n"))
    return rows.select("package", *ORDER, F.posexplode(text).alias("line", "text"))


def _named(name: Column, params: Column) -> Column:
    return F.concat(name, F.when(F.coalesce(params, F.lit("")) != "", F.concat(F.lit("["), params, F.lit("]"))).otherwise(""))


def linked_docs(docs: DataFrame, key: Sequence[str], file: Sequence[str], aliases: DataFrame, modules: DataFrame) -> DataFrame:
    """``docs(key…, doc)`` with the back-ticked references of ``doc`` linked and its last line ends cut; ``file`` holds ``package``."""
    found = R.resolve_refs(R.doc_tokens(docs, file, "doc", [c for c in key if c not in file]), file, aliases, "package", modules)
    return R.rewrite_docs(docs, list(key), found).withColumn("doc", trim_newlines("doc_linked")).drop("doc_linked")


def package_documents(files: DataFrame, modules: DataFrame, private: bool = False, mode: str = "internal", examples: Sequence[str] = ("json", "yaml")) -> DataFrame:
    """``files(package, path, content)`` -> ``package``, the columns of ``ORDER`` and ``text``: the rows of each package's document.

    ``private`` shows unexported declarations and members too (F7); ``mode`` is the link mode of types (docs
    are linked unless it is ``off``).  Example documents are made for structs with a tag of that key.
    """
    key = ["package", "path"]
    # read many times below: written once each, as are the tables that follow from them
    n = kept(nodes(files, key, text=True, words=("package", "type", "func", "var", "const")))
    header = D.import_part(files)
    aliases = kept(R.alias_map(D.imports(L.lines(header, key, partition=False), key, docs=False), key))
    if mode != "off":
        told = linked_docs(n.filter("doc != ''").select(*key, "node", "doc"), [*key, "node"], key, aliases, modules)
        n = kept(n.drop("doc").join(told, [*key, "node"], "left").withColumn("doc", F.coalesce("doc", F.lit(""))))
    shown = F.col("exported") | F.lit(private)
    decls = kept(D.declarations(n, key)[0])
    own = F.col("package")
    out = []

    # package: heading, build tags, docs in path order; imports
    packages = files.select("package").distinct()
    top = F.lit(0)
    out.append(_rows(packages, top, 0, F.concat(F.lit("== Package "), "package"), F.lit(""), F.lit(0), tight=F.lit(True)))
    tags = L.build_tags(L.lines(files, key, partition=False), key).select("package", "tag").distinct().groupBy("package").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    note = F.concat(F.lit("[NOTE]\n====\n*Build Tags:* "), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", "), F.lit("\n===="))
    out.append(_rows(tags, top, 1, note, F.lit(""), F.lit(0)))
    out.append(_rows(n.filter("word = 'package' and first"), top, 2, F.col("doc")))
    block = A.import_block(D.imports(L.lines(header, key, partition=False), key).withColumn("pos", F.struct("path", "pos")), ["package"])
    out.append(_rows(block, F.lit(_SECTION["imports"]), 1, _source(F.col("import_block")), F.lit(""), F.lit(0)))

    # declarations
    pieces = A.signature_pieces(LK.signature_params(n, decls, key, ["package"], aliases, modules, own, mode), [*key, "node"]).withColumn("signature", A.signature_text())
    plain = A.signature_pieces(LK.signature_params(n, decls, key, ["package"], aliases, modules, own, "off"), [*key, "node"]).withColumn("plain", A.signature_text())
    signature = kept(pieces.select(*key, "node", "signature", "tparams").join(plain.select(*key, "node", "plain"), [*key, "node"]))
    params = LK.type_params(decls).select(*key, "node", "type_params")
    items = kept(decls.filter(shown & F.col("kind").isin(*_KINDS)).join(params, [*key, "node"], "left").join(signature, [*key, "node"], "left") \
        .withColumn("section", _section_of(F.col("kind"))))
    anchor = F.concat(F.lit("[["), anchor_id(own, F.col("name")), F.lit("]]\n\n"))
    head = F.concat(F.when(F.col("kind") != "func", anchor).otherwise(""), F.lit("=== "), _named(F.col("name"), F.coalesce("type_params", "tparams")), F.lit("\n"))
    fields = kept(D.fields(n, key))
    own_fields = fields.filter(shown & (F.col("depth") == 0))
    members = D.interface_members(n, key)[0].withColumn("exported", D.is_exported("name")).filter(shown)
    decl = F.regexp_replace("decl", r"\s*\{\}$", "")
    body = own_fields.withColumn("line", tabify_first(F.when(F.col("anonymous"), F.concat("name", F.lit(" struct")))
                                                      .otherwise(F.when(F.col("name") == "", F.col("type_text")).otherwise(F.concat_ws(" ", "name", "type_text"))))) \
        .select(*key, "owner_line", "owner", F.col("name_pos").alias("at"), "line")
    terms = n.filter("inside = 'interface'").withColumn("line", F.trim(F.regexp_replace("text", r"\s+", " "))).filter(~F.col("line").rlike(r"^[A-Za-z_]\w*\s*\(")) \
        .select(*key, "owner_line", "owner", F.struct(F.lit(0).alias("k"), "node").alias("at"), "line")
    calls = members.select(*key, "owner_line", "owner", F.struct(F.lit(1).alias("k"), "node").alias("at"), tabify_last(F.concat("name", "signature")).alias("line"))

    def lines(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key, F.col("owner_line").alias("decl_line"), F.col("owner").alias("name")).agg(A.ordered_join(["at"], F.concat(F.lit("\n\t"), "line"), "").alias("body"))
    at = [*key, "decl_line", "name"]
    for kind, inner in (("struct", lines(body)), ("interface", lines(terms.unionByName(calls)))):
        x = items.filter(F.col("kind") == kind).join(inner, at, "left")
        out.append(_rows(x, F.col("section"), 0, F.concat(head, _source(F.concat(decl, F.lit(" {"), F.coalesce("body", F.lit("")), F.lit("\n}"))))))
    out.append(_rows(items.filter("kind = 'type'"), F.col("section"), 0, F.concat(head, _source(F.col("decl")))))
    out.append(_rows(items.filter("kind in ('functype', 'func')"), F.col("section"), 0, F.concat(head, _source(F.col("plain")))))
    out.append(_rows(items, F.col("section"), 1, F.col("doc")))

    # structs: examples, undocumented and documented fields
    structs = items.filter("kind = 'struct'").select(*at, "node", "section")
    for part, (tag, make) in enumerate((("json", EX.example_json), ("yaml", EX.example_yaml)), 2):
        if tag in examples:
            has = A.tag_presence(fields, [*key, "owner_line"], [tag]).filter("has_tags").select(*key, F.col("owner_line").alias("decl_line"), F.col("owner").alias("name"))
            text = make(fields.withColumn("decl_line", F.col("owner_line")), [*key, "decl_line"]) \
                .select(*key, "decl_line", F.col("owner").alias("name"), F.col(f"example_{tag}").alias("example"))
            x = structs.join(has, at).join(text, at)
            out.append(_rows(x, F.col("section"), part, F.concat(F.lit(f"==== {tag.upper()} Example\n[source, {tag}]\n----\n"), "example", F.lit("\n----"))))
    of = own_fields.filter(~F.col("anonymous")).select(*key, F.col("owner_line").alias("decl_line"), F.col("owner").alias("name"), F.col("name").alias("field"), "type_text", "tag", "member_doc", "name_pos") \
        .join(structs, at)
    bare = of.filter("member_doc = ''")
    cell = lambda c: F.concat(F.lit("|`"), c, F.lit("`"))
    row = F.concat(cell(F.when(F.col("field") == "", F.col("type_text")).otherwise(F.col("field"))), cell(F.col("type_text")), F.lit("|"),
                   F.when(F.col("tag") != "", F.concat(F.lit("`"), "tag", F.lit("`"))).otherwise(""))
    table = lambda columns, names: F.lit(f'==== Undocumented\n\n[cols="{columns}",options="header"]\n|===\n{names}\n')
    out.append(_rows(bare.groupBy(*key, "node", "section").agg(A.ordered_join(["name_pos"], row, "\n").alias("t")), F.col("section"), 4,
                     F.concat(table("1,1,1", "|Field |Type |Tag"), "t", F.lit("\n|==="))))
    scope = LK.names_of(LK.type_params(decls).filter("type_params != ''").select(*key, F.col("name").alias("owner"), "type_params"), "type_params") \
        .select(*key, F.col("owner").alias("struct"), "name")
    told = LK.linked_texts(of.filter("member_doc != ''").withColumnRenamed("name", "struct"), [*key, "node", "name_pos"], "type_text",
                           key, aliases, modules, own, scope, [*key, "struct"], mode)
    heading = F.when(F.col("field") == "", F.col("linked")).otherwise(F.concat_ws(" ", "field", "linked"))
    out.append(_rows(told, F.col("section"), 5, F.concat(F.lit("==== "), heading, F.lit("\n\n"), "member_doc"), pos=F.col("name_pos")))

    # interfaces: undocumented and documented methods, type set
    faces = items.filter("kind = 'interface'").select(*key, F.col("decl_line").alias("owner_line"), F.col("name").alias("owner"), F.col("node").alias("face"), "section")
    calls = members.join(faces, [*key, "owner_line", "owner"])
    row = F.concat(cell(F.col("name")), cell(F.concat("name", "signature")))
    out.append(_rows(calls.filter("member_doc = ''").groupBy(*key, "face", "section").agg(A.ordered_join(["node"], row, "\n").alias("t")), F.col("section"), 4,
                     F.concat(table("1,1", "|Name |Signature"), "t", F.lit("\n|===")), node="face"))
    told = calls.filter("member_doc != ''").drop("signature").join(signature, [*key, "node"])
    out.append(_rows(told, F.col("section"), 5, F.concat(F.lit("==== "), "signature", F.lit("\n\n"), "member_doc", F.lit("\n\n"), _source(F.col("plain"))), node="face", pos=F.col("node")))
    sets = LK.linked_texts(D.interface_members(n, key)[1].join(faces, [*key, "owner_line", "owner"]), [*key, "face", "pos"], "term", key, aliases, modules, own, mode=mode)
    out.append(_rows(sets.select("package", "path", "face", "section").distinct(), F.col("section"), 6, F.lit("==== Type Set"), node="face"))
    out.append(_rows(sets, F.col("section"), 7, F.concat(F.lit("* `"), "linked", F.lit("`")), node="face", pos=F.col("pos"), tight=F.col("pos") > 0))

    # receivers of structs and named types
    owners = items.filter("kind in ('struct', 'type')").select("package", F.col("path").alias("owner_path"), F.col("node").alias("owner_node"), "section", F.col("name").alias("receiver_key"))
    methods = decls.filter(shown & (F.col("kind") == "method")).join(signature, [*key, "node"]).join(owners, ["package", "receiver_key"])
    out.append(_rows(methods.select("package", "owner_path", "owner_node", "section").distinct(), F.col("section"), 8, F.lit("==== Receivers"), path="owner_path", node="owner_node"))
    text = F.concat(F.lit("===== "), _named(F.col("name"), F.col("tparams")), F.lit("\n"), _source(F.col("plain")), F.when(F.col("doc") != "", F.concat(F.lit("\n"), "doc")).otherwise(""))
    out.append(_rows(methods, F.col("section"), 9, text, path="owner_path", node="owner_node", sub="path", pos=F.col("node")))

    # constants (a block of all, then each) and variables
    consts = D.const_decls(D.const_specs(n, key), key).withColumn("exported", D.is_exported("name")).filter(shown) \
        .select(*key, "node", F.col("name_pos").cast("long").alias("name_pos"), "name", "decl", F.col("member_doc").alias("doc")) \
        .unionByName(_values(n, key, "const").withColumn("exported", D.is_exported("name")).filter(shown).drop("exported"))
    s = F.lit(_SECTION["consts"])
    any_const = consts.select("package").distinct()
    out.append(_rows(any_const, s, 1, F.lit("[source, go]\n----\nconst ("), F.lit(""), F.lit(0)))
    out.append(_rows(consts, s, 2, F.concat(F.lit("\t"), tabify_first("decl")), F.lit(""), F.lit(0), "path", F.shiftleft("node", 8) + F.col("name_pos"), F.lit(True)))
    out.append(_rows(any_const, s, 3, F.lit(")\n----"), F.lit(""), F.lit(0), tight=F.lit(True)))
    out.append(_rows(consts, s, 4, F.concat(F.lit("=== "), "name", F.lit("\n"), _source(F.col("decl")), F.when(F.col("doc") != "", F.concat(F.lit("\n"), "doc")).otherwise("")), pos=F.col("name_pos")))
    variables = _values(n, key, "var").withColumn("exported", D.is_exported("name")).filter(shown)
    s = F.lit(_SECTION["vars"])
    out.append(_rows(variables, s, 4, F.concat(F.lit("=== "), "name", F.lit("\n"), _source(F.col("decl")), F.when(F.col("doc") != "", F.concat(F.lit("\n"), "doc")).otherwise("")), pos=F.col("name_pos")))

    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    present = rows.select("package", "section").filter("section > 0").distinct()
    title = None
    for name, heading in HEADINGS.items():
        title = F.when(F.col("section") == _SECTION[name], heading) if title is None else title.when(F.col("section") == _SECTION[name], heading)
    headings = _rows(present, F.col("section"), 0, F.concat(F.lit("== "), title), F.lit(""), F.lit(-1))
    return rows.unionByName(headings)


def _values(n: DataFrame, key: Sequence[str], word: str) -> DataFrame:
    """``key, node, name_pos, name, decl, doc`` of each variable, or of each constant outside a group; several of one spec share its text."""
    own = n.filter((F.col("word") == word) & ~F.col("left_open"))
    group = F.col("first") & F.coalesce(F.col("lists") == "values", F.lit(False))
    specs = own.filter(((F.col("inside") == "values") & F.lit(word == "var")) | (F.col("first") & ~group))
    bare = F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+\z", ""), rf"^{word}\s+", "")
    decl = F.substring_index(F.concat(F.lit("var "), bare) if word == "var" else bare, "\n", 1)
    names = D.spec_names(F.regexp_replace("head", rf"^{word}\s+", ""))
    return specs.select(*key, "node", F.trim(F.regexp_replace(decl, r"\s*[{(]\s*$", "")).alias("decl"), "doc", F.posexplode(names).alias("name_pos", "name")) \
        .withColumn("name_pos", F.col("name_pos").cast("long")).filter("name != ''")
