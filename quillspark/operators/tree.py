"""One token pass over a source text: a table of declarations and their members.

A text is encoded once (literals and comments become single tokens), cut into
chunks at the declaration keywords in column 0, and each chunk is folded over its
tokens with a stack of brackets.  Line ends and semicolons end an item only where
a list of items is open, so one-line and many-line forms of a declaration give
the same rows.  Everything happens inside a file's row: no shuffle, no window, and
work in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import TOKEN

IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
NAMES = rf"{IDENT}(?:\s*+,\s*+{IDENT})*+"

# Literals and comments stand between marks, and their signs and blanks are moved to a private
# code area, so that patterns for code can't match inside them.  Such code points of the text itself come back as signs.
_PLAIN = "\x02\x03\x04\x05\n\t ()[]{};,\"'`/|=*.:<>&~!+-%^#@$?\\"
_HIDDEN = "".join(chr(0xE000 + ord(c)) for c in _PLAIN)
_MARKS = "\x02\x03\x04\x05"
_COMMENT, _LITERAL = r"\x02[^\x03]*+\x03", r"\x04[^\x05]*+\x05"
#: Tokens of an encoded chunk.  Outside type declarations a block of indented lines up to a brace in column 0 is one token.
_PIECE = rf"{_COMMENT}|{_LITERAL}|[()\[\]{{}};]|[ \t]*+\n|[^\x02\x04()\[\]{{}};\n]++"
_BODY = r"\{[^\n{}]*+\n(?:(?:[ \t][^\n]*+)?+\n)*+\}"


def _even(depth: int) -> str:
    """Round and square brackets that close on their line, with others in them up to ``depth``; repeats are counted, as a pattern's stack grows with them."""
    inner = r"[^\x02\x04()\[\]{};\n]"
    return rf"[(\[](?:{inner}++|{_even(depth - 1)}){{0,60}}+[)\]]" if depth else rf"[(\[]{inner}*+[)\]]"


#: Code with such brackets in it is one token: they open no list where no keyword of a group stands before one, and all else that they hold is only counted.
_RUN = rf"(?=[ \t\r\f\x0b]*+[^ \t\r\f\x0b\x02\x04()\[\]{{}};\n])(?:(?![ \t]*+\n)[^\x02\x04()\[\]{{}};\n]++|{_even(2)}){{1,60}}+"
_LONG_PIECE = _PIECE.replace(r"|[ \t]*+\n|", rf"|[ \t]*+\n|{_RUN}|")
_GROUP_OPENS = rf"\b(?:type|var|const|import)(?:\s|{_COMMENT})*+\("
_GO_ON = r"[-+*/%&|^<>=!,.:~]\s*\z"
_WORDS = "type|func|var|const|import|package"
_LINE_END = chr(0xE000 + ord("\n"))

_ITEM_TYPE = ("struct<id:int,parent:int,inside:string,owner:string,owner_line:int,depth:int,path:string,"
              "a:int,b:int,open:int,close:int,line:int,last:int,doc:int>")
_LEVEL = ("id", "parent", "inside", "owner", "owner_line", "depth", "path", "a", "open", "close", "line", "doc")
_STATE = ("line", "mark", "ended", "doc", "n", "opaque", "top", "around", "out")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, use)


def one_of(value: Column, *options: str) -> Column:
    """``value.isin(*options)`` for a few options; the evaluation of ``isin`` inside a fold costs more than that of all the rest of a step."""
    return reduce(or_, [value == o for o in options])


def choose(*cases: tuple[Column, Column], otherwise: Column) -> Column:
    """The value of the first case that holds, as ``when``; as conditions inside each other, which a fold evaluates faster than a list of cases."""
    for holds, value in reversed(cases):
        otherwise = F.call_function("if", holds, value, otherwise)
    return otherwise


def encode(text: Column) -> Column:
    """The text with literals and comments between marks and hidden; :func:`reveal` gives it back."""
    def one(t: Column) -> Column:
        hidden = F.translate(t, _PLAIN, _HIDDEN)
        return F.when(t.startswith("//") | t.startswith("/*"), F.concat(F.lit("\x02"), hidden, F.lit("\x03"))) \
            .when(t.rlike("^[`\"']"), F.concat(F.lit("\x04"), hidden, F.lit("\x05"))).otherwise(t)
    safe = F.when(text.rlike(f"[{_MARKS}]"), F.translate(text, _MARKS, _HIDDEN[:4])).otherwise(text)
    return F.array_join(F.transform(F.regexp_extract_all(safe, F.lit(TOKEN), F.lit(0)), one), "")


def reveal(text: Column) -> Column:
    # most texts have nothing hidden in them, and to look is cheaper than to translate
    return let(text, lambda t: F.when(t.rlike(rf"[{_MARKS}\ue000-\ue07f]"), F.translate(t, _HIDDEN + _MARKS, _PLAIN)).otherwise(t))


def _line_ends(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(F.replace(text, F.lit("\n")), F.lit(_LINE_END)))


def _comment_text(token: Column) -> Column:
    """Text of a comment without its marks; null for a directive."""
    t = reveal(token)
    line = F.regexp_replace(F.regexp_replace(t, r"^//", ""), r"^ ", "")
    block = F.regexp_replace(F.regexp_replace(t, r"^/\*", ""), r"\*/\z", "")
    text = F.regexp_replace(F.when(t.startswith("//"), line).otherwise(block), r"[ \t\r]++(?=\n|\z)", "")
    return F.when(~t.rlike(r"^//(?:line |extern |export |[a-z0-9]+:[a-z0-9])"), text)


def _doc(tokens: Column) -> Column:
    return F.array_join(F.transform(F.filter(tokens, lambda t: t.startswith("\x02")), _comment_text), "\n")


def _doc_above(chunk: Column) -> Column:
    """Text of the comment lines that end a chunk, with no blank line among them (read backwards)."""
    lines = F.regexp_extract(F.reverse(chunk), r"\A(?:[^\n\x02]*+\x02[ \t]*+\n)++", 0)
    return F.when(lines == "", "").otherwise(_doc(F.regexp_extract_all(F.reverse(lines), F.lit(_COMMENT), F.lit(0))))


def fold(n: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """``step(state, i)`` for i from 1 to ``n``, as ``struct(s, out)``: the last state, and all that the steps added to its array ``out``.

    A state is copied at each step, so long outputs are taken out of it after every
    square root of ``n`` steps: ``n ** 1.5`` copies in all, not the square.
    """
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(n)).cast("int"))
    names = _STATE if kind == _ITEM_TYPE else ("s", "out")
    none = F.array().cast(f"array<{kind}>")

    def block(a: Column, first: Column) -> Column:
        run = F.aggregate(F.sequence(first, F.least(first + size - 1, n)), a["s"], step)
        return let(run, lambda r: F.struct(_put(r, names, out=none).alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out")))
    start = F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), n, size), start, block, lambda a: F.struct(a["s"].alias("s"), F.flatten(a["out"]).alias("out")))


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step(state, item) -> (next state, output of SQL type kind)`` puts out for each item."""
    def over(all_items: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            after, item = step(a["s"], F.get(all_items, i - 1))
            return F.struct(after.alias("s"), F.concat(a["out"], F.array(item)).alias("out"))
        none = F.array().cast(f"array<{kind}>")
        zero = F.struct(start.alias("s"), none.alias("out"))
        return F.when(F.size(all_items) > 0, fold(F.size(all_items), zero, one, kind)["out"]).otherwise(none)
    return let(items, over)


def chunks(files: DataFrame, key: Sequence[str], content_col: str = "content", words: Sequence[str] = tuple(_WORDS.split("|"))) -> DataFrame:
    """``key, word, line, chunk, doc``: the encoded text from each keyword in column 0 to the next, and the comment right above; of those that begin with one of ``words``."""
    parts = F.split(F.concat(F.lit("\n"), encode(F.col(content_col))), rf"\n(?=(?:{_WORDS})\b)")

    def rows(p: Column) -> Column:
        starts = scan(p, F.lit(0), lambda at, c: ((at + _line_ends(c) + 1).cast("int"), at), "int")
        def row(at: Column) -> Column:
            return F.transform(p, lambda c, i: F.when(c.rlike(rf"^(?:{'|'.join(words)})\b"), F.struct(
                F.regexp_extract(c, rf"^({_WORDS})\b", 1).alias("word"), F.get(at, i).cast("long").alias("line"), c.alias("chunk"),
                F.when(i > 0, _doc_above(F.get(p, i - 1))).otherwise("").alias("doc"))))
        return let(starts, row)
    return files.select(*key, F.inline(F.array_compact(let(parts, rows))))


def _put(s: Column, names: Sequence[str], **changes: Column) -> Column:
    return F.struct(*[(changes[n] if n in changes else s[n]).alias(n) for n in names])


def _part(tokens: Column, start: Column, stop: Column) -> Column:
    """Tokens from ``start`` to before ``stop``, without a look at the others (``slice`` reads the whole array)."""
    return F.when(stop > start, F.transform(F.sequence(start, stop - 1), lambda k: F.get(tokens, k - 1))).otherwise(F.array().cast("array<string>"))


def _text(tokens: Column, start: Column, stop: Column) -> Column:
    return F.array_join(F.filter(_part(tokens, start, stop), lambda t: ~t.startswith("\x02")), "")


# Heads before a brace that opens a list of members, by what it then lists.
_STRUCT = rf"(?s)^\s*(?:type\s+)?{NAMES}(?:\[.*\])?\s+struct\s*$"
_INTERFACE = rf"(?s)^\s*(?:type\s+)?{IDENT}(?:\[.*\])?\s+interface\s*$"
_GROUP = r"^(type|var|const|import)\s*$"


def _tokens(word: Column, chunk: Column) -> Column:
    def even(t: Column) -> Column:
        return F.length(F.translate(t, "([{", "")) == F.length(F.translate(t, ")]}", ""))

    def cut(piece: str) -> Column:
        plain = F.regexp_extract_all(chunk, F.lit(piece), F.lit(0))
        coarse = let(F.regexp_extract_all(chunk, F.lit(rf"{_BODY}|{piece}"), F.lit(0)),
                     lambda p: F.when(F.forall(p, lambda t: ~t.startswith("{\n") | even(t)), p).otherwise(plain))
        return F.when(word == "type", plain).otherwise(coarse)
    return F.concat(F.when(chunk.rlike(_GROUP_OPENS), cut(_PIECE)).otherwise(cut(_LONG_PIECE)), F.array(F.lit("\n")))


def _fold(tokens: Column, first_line: Column) -> Column:
    """``struct(items, left)``: the items in order of their end, and whether brackets are left open.

    A level of the stack is a list of items with at most one item open, the innermost apart as ``top`` as nearly all steps
    change only that one; brackets that don't open a list are only counted (``opaque``).  ``mark`` tells what stands on a line so far (nothing, a
    comment, code), ``ended`` whether the last line of code was a whole one.
    """
    none, empty = F.lit(0), F.lit("")
    kinds = {"id": none, "parent": none, "inside": empty, "owner": empty, "owner_line": none, "depth": none, "path": empty, "a": none,
             "open": none, "close": none, "line": none, "doc": none}
    ground = F.struct(*[v.alias(k) for k, v in kinds.items()])
    zero = F.struct(first_line.cast("int").alias("line"), none.alias("mark"), F.lit(False).alias("ended"), none.alias("doc"), none.alias("n"), none.alias("opaque"),
                    ground.alias("top"), F.slice(F.array(ground), 1, 0).alias("around"), F.array().cast(f"array<{_ITEM_TYPE}>").alias("out"))

    def item(top: Column, stop: Column, line: Column) -> Column:
        return F.struct(*[top[c].alias(c) for c in ("id", "parent", "inside", "owner", "owner_line", "depth", "path", "a")], stop.alias("b"),
                        top["open"].alias("open"), top["close"].alias("close"), top["line"].alias("line"), line.alias("last"), top["doc"].alias("doc"))

    def closed(s: Column, i: Column) -> Column:
        """The open item, if any, ends before token ``i``."""
        top = s["top"]
        return choose((top["a"] > 0, _put(s, _STATE, top=_put(top, _LEVEL, a=none, open=none, close=none),
                                          out=F.concat(s["out"], F.array(item(top, i, s["line"]))))), otherwise=s)

    def begun(s: Column, i: Column) -> Column:
        """Token ``i`` is code in a list: it begins an item if none is open."""
        new = _put(s["top"], _LEVEL, id=s["n"] + 1, a=i, line=s["line"], doc=s["doc"])
        return choose((s["top"]["a"] == 0, _put(s, _STATE, n=s["n"] + 1, top=new, mark=F.lit(2), doc=none)),
                      (s["mark"] == 2, s), otherwise=_put(s, _STATE, mark=F.lit(2), doc=none))

    def opened(s: Column, t: Column, i: Column) -> Column:
        """An opening bracket, or a whole block, in a list: does it open a list of members?"""
        def decide(top: Column, head: Column) -> Column:
            types = one_of(top["inside"], "", "types")
            what = F.when((t == "{") & (types | (top["inside"] == "struct")) & head.rlike(_STRUCT), "struct") \
                .when((t == "{") & types & head.rlike(_INTERFACE), "interface") \
                .when((t == "(") & (top["inside"] == "") & head.rlike(_GROUP),
                      F.when(head.startswith("type"), "types").when(head.startswith("import"), "imports").otherwise("values"))
            body = t.startswith("{") & (top["inside"] == "") & (top["open"] == 0) & head.rlike(r"^func\b") & ~head.rlike(r"\b(?:struct|interface)\s*$")
            name = F.regexp_extract(head, rf"^\s*(?:type\s+)?({NAMES})", 1)
            inner = top["inside"] == "struct"

            def move(w: Column) -> Column:
                level = _put(top, _LEVEL, parent=top["id"], inside=w, owner=F.when(inner, top["owner"]).otherwise(name),
                             owner_line=F.when(inner, top["owner_line"]).otherwise(top["line"]), depth=F.when(inner, top["depth"] + 1).otherwise(none),
                             path=F.when(inner, F.when(top["path"] == "", name).otherwise(F.concat(top["path"], F.lit("."), name))).otherwise(empty),
                             a=none, open=none, close=none)
                listed = _put(s, _STATE, top=level, around=F.concat(s["around"], F.array(_put(top, _LEVEL, open=i))))
                plain = _put(s, _STATE, opaque=F.when(F.length(t) == 1, 1).otherwise(none),
                             line=F.when(F.length(t) == 1, s["line"]).otherwise((s["line"] + _line_ends(t)).cast("int")),
                             top=F.when(body, _put(top, _LEVEL, open=i)).otherwise(top))
                return choose((w.isNotNull(), listed), otherwise=plain)
            return let(what, move)
        return let(_text(tokens, s["top"]["a"], i), lambda head: decide(s["top"], head))

    def shut(s: Column, i: Column) -> Column:
        """A closing bracket: of a counted one, or of the list; one too many is left out."""
        def popped(c: Column) -> Column:
            below = _put(F.element_at(c["around"], -1), _LEVEL, close=i)
            return _put(c, _STATE, mark=F.lit(2), doc=none, top=below, around=F.slice(c["around"], 1, F.size(c["around"]) - 1))
        return choose((s["opaque"] > 0, _put(s, _STATE, mark=F.lit(2), doc=none, opaque=s["opaque"] - 1)),
                      (F.size(s["around"]) > 0, let(closed(s, i), popped)), otherwise=s)

    def newline(s: Column, i: Column) -> Column:
        """Ends an item unless the line's code goes on; a line without code leaves that as it was."""
        def ended(last: Column) -> Column:
            whole = choose((s["mark"] < 2, s["ended"]), otherwise=~last.rlike(_GO_ON))

            def on(x: Column) -> Column:
                return _put(x, _STATE, line=x["line"] + 1, mark=none, ended=whole, doc=choose((x["mark"] == 1, x["doc"]), otherwise=none))
            return let(choose((whole & (s["mark"] == 2), closed(s, i)), otherwise=s), on)
        before = F.get(tokens, i - 2)
        return let(choose((before.startswith("\x02"), F.get(tokens, i - 3)), otherwise=before), ended)

    def step(s: Column, i: Column) -> Column:
        def by_token(t: Column) -> Column:
            after = choose((t.contains(_LINE_END), (s["line"] + _line_ends(t)).cast("int")), otherwise=s["line"])
            said = _put(s, _STATE, line=after, mark=F.greatest(s["mark"], F.lit(1)), doc=choose(((s["mark"] == 0) & (s["doc"] == 0), i), otherwise=s["doc"]))
            counted = choose((t.endswith("\n"), _put(s, _STATE, line=s["line"] + 1)), (t.contains(_LINE_END), _put(s, _STATE, line=after)), otherwise=s)
            return choose(
                (one_of(t, ")", "]", "}"), shut(s, i)),
                (s["opaque"] > 0, choose((one_of(t, "(", "[", "{"), _put(s, _STATE, opaque=s["opaque"] + 1)), otherwise=counted)),
                (t.endswith("\n"), newline(s, i)),
                (t.startswith("\x02"), said),
                (t == ";", let(closed(s, i), lambda x: _put(x, _STATE, mark=F.lit(2), doc=none))),
                (t.startswith("(") | t.startswith("[") | t.startswith("{"), let(begun(s, i), lambda x: opened(x, t, i))),
                (F.btrim(t, F.lit(" \t\r\f\x0b")) == "", s),
                otherwise=let(begun(s, i), lambda x: choose((t.contains(_LINE_END), _put(x, _STATE, line=after)), otherwise=x)))
        return let(F.get(tokens, i - 1), by_token)

    # a chunk that leaves brackets open is one item
    first = _put(ground, _LEVEL, id=F.lit(1), a=F.lit(1), line=first_line.cast("int"))
    whole = item(first, F.size(tokens), first_line.cast("int"))
    # a chunk of one line, or of a function's head and its body as one token, needs no fold: its one item ends at the first line end
    head, block = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))

    def ends_after(k: int) -> Column:
        return F.forall(F.slice(tokens, k + 1, F.size(tokens)), lambda t: t.endswith("\n"))

    def only(x: Column) -> Column:
        return F.struct(F.array(x).alias("items"), F.lit(False).alias("left"))
    bodied = block.startswith("{") & (F.length(block) > 1) & head.rlike(r"^func\b") & ~head.rlike(r"\b(?:struct|interface)\s*$") & ends_after(2)
    line = only(item(first, F.lit(2), first_line.cast("int")))
    body = only(item(_put(first, _LEVEL, open=F.lit(2)), F.lit(3), (first_line + _line_ends(block)).cast("int")))
    return choose((block.endswith("\n") & ends_after(1) & ~head.rlike(_GO_ON), line), (bodied, body), otherwise=let(fold(F.size(tokens), zero, step, _ITEM_TYPE), lambda r: let((r["s"]["opaque"] > 0) | (F.size(r["s"]["around"]) > 0), lambda left: F.struct(
        F.when(left, F.array(whole)).otherwise(r["out"]).alias("items"), left.alias("left")))))


def nodes(files: DataFrame, key: Sequence[str], content_col: str = "content", text: bool = False,
          words: Sequence[str] = ("type", "func", "var", "const", "import")) -> DataFrame:
    """The node table of each file: a row for each declaration, spec and member of the chunks that begin with one of ``words``.

    Columns: ``key``; ``word`` (keyword of the chunk), ``chunk_line``; ``node`` (number of the item in the file,
    in order of beginnings) and ``parent`` (null at the top); ``inside`` (``""``, ``types``, ``values``, ``imports``, ``struct``, ``interface``: what list it is
    in) and ``lists`` (the same of its members, else null);
    ``first`` (it begins at the chunk's keyword); ``line``, ``end_line``; ``owner``, ``owner_line``, ``depth``, ``struct_path`` (of members: the
    declaration and the names of the nested structs around them); ``doc`` (comment lines right above); ``head`` (encoded
    text up to its list of members or body), ``tail`` (what follows the list), ``hollow`` (its list is ``{}``), with ``text`` its whole
    text as written; ``left_open``: the chunk leaves brackets open (it is one row then).
    """
    def rows(tokens: Column) -> Column:
        def build(r: Column) -> Column:
            def node(x: Column) -> Column:
                child = F.when(x["open"] == 0, None).when(x["close"] > 0, F.get(tokens, x["open"] - 1))
                inner = F.when(x["doc"] > 0, _doc(_part(tokens, x["doc"], x["a"]))).otherwise("")
                return F.struct(
                    x["id"].alias("node"), x["parent"].alias("parent"), x["inside"].alias("inside"), child.alias("bracket"), x["owner"].alias("owner"),
                    x["owner_line"].cast("long").alias("owner_line"), x["depth"].alias("depth"), x["path"].alias("struct_path"), x["line"].cast("long").alias("line"),
                    x["last"].cast("long").alias("end_line"), inner.alias("member_doc"),
                    _text(tokens, x["a"], F.when(x["open"] > 0, x["open"]).otherwise(x["b"])).alias("head"),
                    F.when(x["close"] > 0, _text(tokens, x["close"] + 1, x["b"])).otherwise("").alias("tail"),
                    ((x["close"] > 0) & (x["close"] == x["open"] + 1)).alias("hollow"),
                    *([reveal(F.array_join(_part(tokens, x["a"], x["b"]), "")).alias("text")] if text else []), r["left"].alias("left_open"))
            return F.transform(r["items"], node)
        return let(_fold(tokens, F.col("line")), build)

    c = chunks(files, key, content_col, words)
    x = c.select(*key, "word", F.col("line").alias("chunk_line"), F.col("doc").alias("__doc"), F.inline(let(_tokens(F.col("word"), F.col("chunk")), rows)))
    lists = F.when(F.col("bracket") == "(", F.when(F.col("word") == "type", "types").when(F.col("word") == "import", "imports").otherwise("values")) \
        .when(F.col("bracket") == "{", F.when(F.col("head").rlike(r"\binterface\s*$"), "interface").otherwise("struct"))
    number = lambda c: F.shiftleft(F.col("chunk_line"), 32) + F.col(c)
    x = x.withColumn("first", (F.col("inside") == "") & (F.col("node") == 1)) \
        .withColumn("parent", F.when(F.col("parent") > 0, number("parent"))).withColumn("node", number("node"))
    doc = F.when(F.col("first"), F.col("__doc")).otherwise(F.col("member_doc"))
    return x.withColumn("lists", lists).withColumn("doc", doc).drop("__doc", "bracket", "member_doc")
