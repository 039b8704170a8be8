"""The node table: one-line and many-line forms, accounting, and long inputs in linear time."""
import time

from pyspark.sql import functions as F

from quillspark.fixtures import fx
from quillspark.operators import decls as D
from quillspark.operators.tree import _line_ends, encode, nodes, reveal

SF = "/root/testdata/sf0.001"
KEY = ["file_id"]
DECLS = ("type", "func", "var", "const")


def _nodes(spark, src, **more):
    return nodes(spark.createDataFrame([(1, src)], "file_id long, content string"), KEY, text=True, **more)


def _fields(spark, src):
    f = D.fields(_nodes(spark, src), KEY).orderBy("name_pos").collect()
    return [(r.owner, r.struct_path, r.depth, r.name, " ".join(r.type_text.split()), r.tag, r.anonymous) for r in f]


def test_encoding_is_reversible(spark):
    texts = ["", "a // b\n/* c\n d */ \"e\\\"f\" 'g' `h\ni` / j", "x \x02 \x05 `unclosed", "é // ü\r\n你 \"好\""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(reveal(encode(F.col("t")))).collect()] == texts


def test_one_line_and_split_forms_agree(spark):
    one = "package p\ntype T struct { A int; B, c []string `json:\"b\"`; N struct { X int; io.Reader } `yaml:\"n\"`; *E }\n"
    many = ("package p\ntype T struct {\n\tA int\n\tB, c []string `json:\"b\"`\n\tN struct {\n\t\tX int\n\n\t\t// embedded\n\t\tio.Reader\n\t} `yaml:\"n\"`\n\t*E\n}\n")
    want = [("T", "", 0, "A", "int", "", False), ("T", "", 0, "B", "[]string", 'json:"b"', False), ("T", "", 0, "c", "[]string", 'json:"b"', False),
            ("T", "", 0, "N", "struct", 'yaml:"n"', True), ("T", "N", 1, "X", "int", "", False), ("T", "N", 1, "", "io.Reader", "", False), ("T", "", 0, "", "*E", "", False)]
    assert _fields(spark, one) == want and _fields(spark, many) == want


def test_names_over_lines_and_operators_go_on(spark):
    assert [f[3] for f in _fields(spark, "type T struct {\n\tA,\n\tB int\n\n\tC int; D int\n}")] == ["A", "B", "C", "D"]
    out = D.value_specs(_nodes(spark, "var a = 1 + // why\n\n\t2\nvar (\n\tb = f(\n\t\t1,\n\t)\n\tc, d = `x\n)`, 2\n)\n"), KEY)
    assert [r.name for r in out.orderBy("line_no", "name").collect()] == ["a", "b", "c", "d"]


def test_every_keyword_is_a_declaration_or_a_reject(spark):
    f = fx(spark, SF, "fx12_files")
    good, bad = D.declarations(nodes(f, KEY, text=True, words=DECLS), KEY)
    n = nodes(f, KEY, words=DECLS)
    groups = n.filter("first and lists = 'types'").count()
    keywords = f.select(F.explode(F.split("content", "\n")).alias("l")).filter(F.col("l").rlike(r"^(?:type|func|var|const)\b"))
    fake = keywords.filter(F.col("l").rlike("Fake")).count()  # a line inside a raw string
    assert n.filter("first").count() == keywords.count() - fake
    assert good.count() + bad.count() == n.filter("first or inside = 'types'").count() - groups
    members = n.filter("inside in ('struct', 'interface')")
    meth, _ = D.interface_members(n, KEY)
    fields = D.fields(n, KEY).select(*KEY, F.shiftright("name_pos", 20).alias("node")).distinct().count()
    terms = members.filter("inside = 'interface'").count() - meth.count()
    assert fields + meth.count() + terms + D.member_rejects(n, KEY).count() == members.count()


def test_long_inputs(spark):
    many = 10_000
    src = ("package p\n\ntype T struct {\n" + "".join(f"\tF{i} map[string][]int `json:\"f{i}\"`\n" for i in range(many)) + "}\n\n"
           + "func f(" + "(" * 5000 + ")" * 5000 + ") {\n" + "\tx(1)\n" * many + "}\n\nvar v = []int{" + "1, " * many + "}\n"
           + "const (\n" + "".join(f"\tc{i} = {i}\n" for i in range(many)) + ")\n" + "// a\n" * many + "func last() {}\n")
    start = time.time()
    n = _nodes(spark, src).select("word", "first", "inside", "line", "end_line", "doc").collect()
    assert time.time() - start < 60
    assert [r.line for r in n if r.first] == [3, many + 6, 2 * many + 9, 2 * many + 10, 4 * many + 12]
    assert sum(r.inside == "struct" for r in n) == many and sum(r.inside == "values" for r in n) == many
    assert n[-1].doc.count("a") == many


def test_split_top_is_linear(spark):
    text = "a int, " + "(" * 5000 + "x, y" + ")" * 5000 + ", " + "b int, " * 20_000
    start = time.time()
    out = spark.createDataFrame([(text,)], "t string").select(D.split_top(F.col("t")).alias("p")).first().p
    assert len(out) == 20_002 and out[0] == "a int" and out[1].count(",") == 1 and time.time() - start < 30


def test_folds_test_signs_one_by_one(spark):
    """``isin`` inside a fold took a quarter of the node table's time."""
    from quillspark.operators import links as LK
    df = spark.createDataFrame([(1, "x", [("name", "F")])], "file_id long, content string, tokens array<struct<kind:string,content:string>>")
    text = F.col("content")
    for out in (nodes(df, KEY, text=True), df.select(D.split_top(text), D.balanced(text)), df.select(LK.type_pieces(text)),
                df.select(LK.highlight_blocks(F.col("tokens"), text))):
        plan = out._jdf.queryExecution().analyzed().numberedTreeString() + " ".join(e.sql() for e in _expressions(out))
        assert "lambda" in plan and " IN (" not in plan


def _expressions(df):
    found = df._jdf.queryExecution().analyzed().expressions()
    return [found.apply(i) for i in range(found.size())]


def test_signs_and_line_ends_of_encoded_texts(spark):
    texts = ["", None, "plain", "a // b ( c\n`{\n}` 'x' \"y\"", "\x02\x03 \n\x04\x05", "/* a\n\nb */ c\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(reveal(encode(F.col("t"))).alias("r"), _line_ends(encode(F.col("t"))).alias("n")).collect()
    assert [(r.r, r.n) for r in rows] == [(t, None if t is None else t.count("\n")) for t in texts]
    assert spark.range(1).select(reveal(F.lit("\ue028x\ue00a\ue0ff"))).first()[0] == "(x\n\ue0ff"


def _rows(df):
    return sorted(map(str, df.collect()))


def test_short_cuts_give_the_rows_of_the_fold(spark, monkeypatch):
    """Even brackets in one token, and chunks of one item without a fold: the same rows as token by token."""
    from quillspark.operators import tree
    src = ["func (o *O[T]) Get(k U, w map[string]*W) (T, *a.I) \n\nfunc x() {\n\treturn f(a[1])\n}\n", "type (A = int; B struct { P *A })\nvar (a = f(g(h(i(1))))\n\tb = 2)\n", "type H func(a, chan<- l.E) error // c\n",
           "type A int;var (x = 1)\n/*c*/var (y)\nvar q = f(1) +\n\t2\nvar r =\n\tf(3)\n", "func a(\n\tb int,\n) (c int) \n{\n}\nfunc d() (\nfunc e)\n", "type I interface { Do(a int) error; ~[]int }\nconst c = d(1) \r\n"]
    files = spark.createDataFrame(list(enumerate(src)), "file_id long, content string")
    found = _rows(nodes(files, KEY, text=True))
    monkeypatch.setattr(tree, "_LONG_PIECE", tree._PIECE)
    assert _rows(nodes(files, KEY, text=True)) == found and len(found) > 20


def test_simple_texts_need_no_fold(spark):
    """A text of even brackets gives what the same text gives in brackets too deep for the pattern."""
    from quillspark.operators import links as LK
    df = spark.createDataFrame([("a, b int, f func(x, y [2]int) (z), g",), (" , ",), ("*a.B",), ("chan",), ("a.b.c",), ("[T any](x)",), ("(a]b",), (None,)], "t string")
    t = F.col("t")
    rows = {r.t: r for r in df.select(t, D.split_top(t).alias("s"), D.balanced(t).alias("b"), LK.type_pieces(t).alias("p")).collect()}
    assert rows["a, b int, f func(x, y [2]int) (z), g"].s == ["a", "b int", "f func(x, y [2]int) (z)", "g"] and rows[" , "].s == [] and rows[None].s == []
    assert [rows[x].b for x in ("[T any](x)", "(a]b", "chan", None)] == ["[T any]", "(a]", "", ""]
    assert [[tuple(p) for p in rows[x].p] for x in ("*a.B", "chan", "a.b.c")] == [[("*", False), ("a.B", True)], [("chan", False)], [("a.b", True), (".", False), ("c", True)]]
    deep = "a, " + "(" * 9 + "b, c" + ")" * 9 + ", " + "[x], " * 90
    out = spark.createDataFrame([(deep,)], "t string").select(D.split_top(F.col("t")).alias("s"), D.balanced(F.substr(F.col("t"), F.lit(4))).alias("b")).first()
    assert out.s == ["a", "(" * 9 + "b, c" + ")" * 9, *["[x]"] * 90] and out.b == "(" * 9 + "b, c" + ")" * 9


def test_most_chunks_are_one_token_a_line(spark):
    """A signature was some twenty tokens, each a step of the fold."""
    from quillspark.operators.tree import _tokens
    c = spark.createDataFrame([("func", "func (o *O[T]) Get(k U, w map[string]*W, v ...T) (T, *a.I)\n")], "word string, chunk string")
    assert len(c.select(_tokens(F.col("word"), F.col("chunk"))).first()[0]) == 3


def test_texts_of_names_need_no_fold(spark, monkeypatch):
    from quillspark.operators import links as LK
    texts = ["map[a.K][]*b.V", "Box[T, []al.Item]", "chan<- lib.Event", "...T", "[N]int", "chan[3]x", "func(a) b", "(A, x.B) | ~C", "T2[U]", "3x[y]", "a[b][c]", "[][]T", "map [K]V", "functor[func]", "struct{ A B }", "", "é[x]", "a.b.c[d]", "x" + ", y" * 80]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = _rows(df.select("t", LK.type_pieces(F.col("t")).alias("p")))
    assert df.filter(F.col("t").rlike(LK._ALL_NAMES)).count() >= 7
    monkeypatch.setattr(LK, "_ALL_NAMES", "(?!)")
    assert _rows(df.select("t", LK.type_pieces(F.col("t")).alias("p"))) == found


def test_blocks_of_any_tokens(spark):
    """With and without the fold, against the rule token by token."""
    import random
    from quillspark.operators import links as LK
    rng = random.Random(3)
    kinds, forms = ["keyword", "text", "name", "typename", "receiver", "params", "gap", "result", "other"], ["func", "method", "functype", "interface_method"]
    data = [(i, rng.choice(forms), [(rng.choice(kinds), rng.choice(["func", "x"])) for _ in range(rng.choice([0, 1, 3, 6, 9, 70]))]) for i in range(120)]
    df = spark.createDataFrame(data, "i int, kind string, tokens array<struct<kind:string,content:string>>")
    got = {r.i: r for r in df.select("i", LK.highlight_blocks(F.col("tokens"), F.col("kind")).alias("b")).withColumn("m", LK.block_markup(F.col("b"))).collect()}
    for i, form, tokens in data:
        inside, block, was, want = False, 0, None, []
        for k, content in tokens:
            begins = (k == "keyword" and content == "func") or (k == "name" and form == "interface_method") or (k == "params" and form == "functype")
            inside = k not in ("gap", "result") and (inside or begins)
            like = form != "functype" and (k in ("name", "params") or (k == "receiver" and form != "interface_method"))
            wrapper = "hljs-function" if k in ("keyword", "text", "name", "params", "receiver") and (inside or like) else ""
            block, was = block + (wrapper != was), wrapper
            want.append((block, wrapper, LK._CLASSES.get(k, ""), content))
        assert [tuple(b) for b in got[i].b] == want, i
        assert got[i].m.count("hljs-function") == len({b[0] for b in want if b[1]})
