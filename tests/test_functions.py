"""Table-driven cases re-typed from the reference's unit tests."""
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import decls as D
from quillspark.operators.paths import excluded_by


def _one(spark, col, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.orderBy("i").select(col(F.col("v")).alias("o")).collect()]


def test_export_names(spark):
    cases = {"Foo": True, "*Foo": True, "[]*Foo": True, "map[string]*pkg.Foo": True, "chan<- Foo": True,
             "<-chan Foo": True, "(...Foo)": True, "pkg.Bar": True, "[]string": False,
             "map[int]*pkg.unexported": False, "func()": False}
    got = _one(spark, D.is_exported, list(cases))
    assert got == list(cases.values())


def test_receiver_keys(spark):
    cases = {"Foo": "Foo", "*Foo": "Foo", "**Foo": "Foo", "&Foo": "Foo", "pkg.Foo": "Foo", "*pkg.Foo": "Foo",
             "Foo[T]": "Foo", "*Foo[T, U]": "Foo", "pkg.Foo[T]": "Foo", "pkg.": "pkg.", "*": "", "": "",
             "  Foo  ": "Foo", "*pkg.Foo[T, U]": "Foo", "github.com/user/pkg.Foo": "Foo"}
    assert _one(spark, D.receiver_key, list(cases)) == list(cases.values())


def test_module_short_names(spark):
    cases = {"github.com/user/my_module": "my-module", "example.com/a.b": "a-b", "single": "single",
             "github.com/x/y/v2": "v2", "": ""}
    assert _one(spark, X.module_short_name, list(cases)) == list(cases.values())


def test_heading_strip(spark):
    cases = {"# Title": "Title", "## Sub title  ": "Sub title", "###": "", "####### seven": "####### seven",
             "#nospace": "#nospace", "text # not": "text # not", "  ## indented": "indented",
             "a\n# b\nc": "a\nb\nc"}
    assert _one(spark, X.strip_headings, list(cases)) == list(cases.values())


def test_strip_markup_and_entities(spark):
    assert _one(spark, X.strip_markup, ["<b>x</b>", "a<b", "a>b", "<a<b>c"]) == ["x", "a", "ab", "c"]
    assert _one(spark, X.escape_entities, ["a&<b>'\""]) == ["a&amp;&lt;b&gt;&#39;&#34;"]
    assert _one(spark, X.unescape_entities, ["a&amp;lt;&lt;"]) == ["a&lt;<"]


def test_canonical_version(spark):
    cases = {"go1.21.3": "1.21", "1.22": "1.22", "1": "1", "": "", " 1.20rc1": "1.20"}
    assert _one(spark, X.canonical_version, list(cases)) == list(cases.values())


def test_exclude_reason(spark):
    df = spark.createDataFrame([("/home/user/.cache/output.txt",), ("/home/user/project/skip.go",),
                                ("/home/user/project/main.go",)], "p string")
    got = [r[0] for r in df.select(excluded_by(["glb:**/.cache/**", r"^.*/skip\.go$"], "p")).collect()]
    assert got == ["glb:**/.cache/**", r"^.*/skip\.go$", None]


def test_anchor_and_relative_path(spark):
    df = spark.createDataFrame([("example.com/m/p", "Type.Method", "a/b", "a/c/d.adoc")], "p string, n string, b string, t string")
    r = df.select(X.anchor_id("p", "n").alias("a"), X.relative_path("b", "t").alias("r")).first()
    assert r["a"] == "example-com-m-p-Type-Method"
    assert r["r"] == "../c/d.adoc"


NESTED_SRC = (
    "package p\n\ntype Outer struct {\n\tName string `json:\"name\" yaml:\"name\"`\n"
    "\tProfile struct {\n\t\tBio string `json:\"bio\" yaml:\"bio\"`\n\t\tinner int\n\t} `json:\"profile\" yaml:\"profile\"`\n"
    "\tTags []string `json:\"tags\"`\n}\n"
)


def _nested_fields(spark):
    from quillspark.operators import decls as D
    from quillspark.operators.tree import nodes
    df = spark.createDataFrame([(1, NESTED_SRC)], "file_id long, content string")
    return D.fields(nodes(df, ["file_id"]), ["file_id"])


def test_nested_struct_fields(spark):
    rows = {r["name"]: r for r in _nested_fields(spark).collect()}
    assert rows["Profile"]["anonymous"] and rows["Profile"]["tag"] == 'json:"profile" yaml:"profile"'
    assert rows["Bio"]["depth"] == 1 and rows["Bio"]["struct_path"] == "Profile"
    assert rows["Tags"]["depth"] == 0 and rows["Tags"]["struct_path"] == ""


def test_nested_examples(spark):
    from quillspark.operators.examples import example_json, example_yaml
    f = _nested_fields(spark)
    j = example_json(f, ["file_id"]).first()["example_json"]
    y = example_yaml(f, ["file_id"]).first()["example_yaml"]
    assert j == '{\n  "name": "example",\n  "profile": {\n    "bio": "example"\n  },\n  "tags": ["example"]\n}'
    assert y == 'name: "example"\nprofile:\n  bio: "example"\nTags:\n  - "example"'


def _func_doc(spark, src):
    from quillspark.operators import decls as D
    from quillspark.operators.tree import nodes
    df = spark.createDataFrame([(1, src)], "file_id long, content string")
    d, _ = D.declarations(nodes(df, ["file_id"], text=True), ["file_id"])
    return {r["name"]: r["doc"] for r in d.collect()}


def test_doc_line_comments(spark):
    src = ('package foo\nimport ( \n\t"fmt" \n\t"time" \n)\n\n'
           '// Bar is a private function that prints out current time\n//\n// This function is exported!\n'
           'func Bar() {\n\tfmt.Println(time.Now())\n}')
    assert _func_doc(spark, src)["Bar"] == "Bar is a private function that prints out current time\n\nThis function is exported!"


def test_doc_block_comments(spark):
    src = ('package foo\nimport ( \n\t"fmt" \n\t"time" \n)\n\n'
           '/* Bar is a private function that prints out current time\n   This function is exported!\n */\n'
           'func Bar() {\n\tfmt.Println(time.Now())\n}\n\n/*\nfunc Hidden() {\n}\n*/\nvar X = 1')
    docs = _func_doc(spark, src)
    assert docs["Bar"] == " Bar is a private function that prints out current time\n   This function is exported!"
    assert "Hidden" not in docs


def test_import_block_order(spark):
    from quillspark.operators.aggregates import import_block
    paths = ["bufio", "example.org/team/core/errs", "example.org/team/core/ctx", "encoding/json", "flag", "fmt",
             "example.net/lib/events", "os", "strings", "fmt"]
    df = spark.createDataFrame([(1, i, "", p) for i, p in enumerate(paths)] + [(2, 0, "al", "x/y")],
                               "file_id long, pos long, alias string, import_path string")
    got = {r["file_id"]: r["import_block"] for r in import_block(df, ["file_id"]).collect()}
    assert got[1] == ('import (\n\t"bufio"\n\t"flag"\n\t"fmt"\n\t"os"\n\t"strings"\n\t"encoding/json"\n'
                      '\t"example.net/lib/events"\n\t"example.org/team/core/ctx"\n\t"example.org/team/core/errs"\n)')
    assert got[2] == 'import al "x/y"'


def test_type_kinds(spark):
    from quillspark.operators import decls as D
    cases = {"": "unknown", "int": "ident", "pkg.T": "selector", "*T": "pointer", "[4]byte": "array",
             "[]T": "slice", "map[string]int": "map", "chan int": "chan", "<-chan T": "chan",
             "func(int) error": "func", "struct{ A int }": "struct", "interface{ M() }": "interface",
             "...T": "ellipsis", "List[T]": "index", "Pair[K, V]": "index-list", "~int | string": "binary",
             "(T)": "paren"}
    assert _one(spark, D.type_kind, list(cases)) == list(cases.values())
    elems = {"*T": "T", "[]pkg.T": "pkg.T", "[3]int": "int", "map[string][]int": "[]int", "chan<- T": "T", "...T": "T"}
    assert _one(spark, D.type_element, list(elems)) == list(elems.values())


def _const_decls(spark, src):
    from quillspark.operators import decls as D
    from quillspark.operators.tree import nodes
    df = spark.createDataFrame([(1, src)], "file_id long, content string")
    out = D.const_decls(D.const_specs(nodes(df, ["file_id"]), ["file_id"]), ["file_id"])
    return [r["decl"] for r in out.orderBy("line_no", "name_pos").collect()]


def test_const_iota_expansion(spark):
    src = "package foo\n\ntype Kind int\n\nconst (\n\tfirst Kind = iota + 1\n\tsecond\n\tthird\n)"
    assert _const_decls(spark, src) == ["first Kind = 1", "second Kind = 2", "third Kind = 3"]


def test_const_iota_mixed(spark):
    src = "package foo\n\nconst (\n\t_ = iota\n\tFlagA = 1 << iota\n\tFlagB\n\tFlagC\n\tOffset = iota + 100\n\tNext\n)"
    assert _const_decls(spark, src) == ["_ = 0", "FlagA = 2", "FlagB = 4", "FlagC = 8", "Offset = 104", "Next = 105"]


def test_build_constraints(spark):
    from quillspark.operators.lines import constraint_holds, plus_build_to_expr
    tags = ["linux", "amd64", "integration"]
    cases = {"linux": True, "!linux": False, "windows": False, "!windows": True, "linux && amd64": True,
             "linux && !amd64": False, "windows || integration": True, "windows || darwin": False,
             "(linux || windows) && !cgo": True, "!(linux && amd64)": False, "!!linux": True,
             "linux && (windows || (amd64 && integration))": True}
    got = _one(spark, lambda c: constraint_holds(c, tags), list(cases))
    assert got == list(cases.values())
    old = {"linux,amd64": True, "windows linux": True, "windows,linux darwin": False, "extra,linux": False}
    got_old = _one(spark, lambda c: constraint_holds(plus_build_to_expr(c), tags), list(old))
    assert got_old == list(old.values())


def test_long_constraints(spark):
    import time
    from quillspark.operators.lines import constraint_holds
    many = 10_000
    cases = {" && ".join(["linux"] * many): True, " || ".join(["x"] * many) + " || linux": True, "(" * many + "linux" + ")" * many: True,
             "!(" * many + "linux" + ")" * many: True, "!(" * (many + 1) + "linux" + ")" * (many + 1): False, "(" * many + "linux" + ")" * (many - 1): None,
             "x || linux && y || !z && linux": True, "": None, "linux & amd64": None, "linux amd64": None, "!": None, "()": None}
    start = time.time()
    assert _one(spark, lambda c: constraint_holds(c, ["linux", "amd64"]), list(cases)) == list(cases.values())
    assert time.time() - start < 30


HEADING_CASES = [
    ("# Main Title\nSome content", "Main Title\nSome content"),
    ("## Subsection\nMore content", "Subsection\nMore content"),
    ("### Sub-subsection\nEven more content", "Sub-subsection\nEven more content"),
    ("# Title\n\n## Section\n\n### Subsection\n\nContent here", "Title\n\nSection\n\nSubsection\n\nContent here"),
    ("## API Reference: GetUser()\nDescription here", "API Reference: GetUser()\nDescription here"),
    ("###### Deep heading\nContent", "Deep heading\nContent"),
    ("##    Multiple Spaces    \nContent", "Multiple Spaces\nContent"),
    ("## \nContent", "\nContent"),
    ("Some text\n## Heading\nMore text", "Some text\nHeading\nMore text"),
    ("Just regular text\nWith multiple lines\nNo headings here", "Just regular text\nWith multiple lines\nNo headings here"),
    ("This is # not a heading because it's mid-sentence", "This is # not a heading because it's mid-sentence"),
    ("First line\n## Second line is heading", "First line\nSecond line is heading"),
    ("# Introduction\n\nSome content\n\n## Details", "Introduction\n\nSome content\n\nDetails"),
    ("  ## Indented Heading\nContent", "Indented Heading\nContent"),
    ("\t### Tab Heading\nContent", "Tab Heading\nContent"),
    ("##\nContent", "\nContent"),
]


def test_heading_strip_table(spark):
    got = _one(spark, X.strip_headings, [i for i, _ in HEADING_CASES])
    assert got == [e for _, e in HEADING_CASES]
    # disabled: the macro pass without heading stripping leaves the text as is
    df = spark.createDataFrame([("# Title\n## Section\nContent", "/a/b.go")], "d string, p string")
    assert df.select(X.process_doc("d", "p", headings=False).alias("o")).first()["o"] == "# Title\n## Section\nContent"


def test_doc_reference_resolution(spark):
    """Token shapes: own-package type, alias package, alias member, receiver.method,
    fully qualified path (split at the first dot after the last slash), builtin."""
    from quillspark.operators import refs as R
    docs = spark.createDataFrame(
        [(1, "See `Item`, `al`, `al.Box`, `Part.Price`, `github.com/x/lib/v2.Box.Get`, `fmt`, `string`.",
          "example.com/m1/p")], "doc_id long, doc string, own string")
    imports = spark.createDataFrame([(1, 0, "al", "example.com/m2/box"), (1, 1, "", "fmt")],
                                    "doc_id long, pos long, alias string, import_path string")
    mods = spark.createDataFrame([("example.com/m1",), ("example.com/m2",)], "name string")
    toks = R.doc_tokens(docs, ["doc_id"], "doc", keep=["own"])
    res = R.resolve_refs(toks, ["doc_id"], R.alias_map(imports, ["doc_id"]), "own", mods)
    got = {r["original"]: r["link"] for r in res.collect()}
    assert got["Item"] == "<<example-com-m1-p-Item,Item>>"
    assert got["al"] == "<<example-com-m2-box-,al>>"
    assert got["al.Box"] == "<<example-com-m2-box-Box,al.Box>>"
    assert got["Part.Price"] == "<<example-com-m1-p-Part-Price,Part.Price>>"
    assert got["github.com/x/lib/v2.Box.Get"] == "link:https://pkg.go.dev/github.com/x/lib/v2#Box.Get[github.com/x/lib/v2.Box.Get]"
    assert got["fmt"] == "link:https://pkg.go.dev/fmt[fmt]"
    assert got["string"] is None
    out = R.rewrite_docs(docs, ["doc_id"], res).first()["doc_linked"]
    assert out.startswith("See <<example-com-m1-p-Item,Item>>, ") and out.endswith(", `string`.")


def test_package_name_chain_and_rejects(spark):
    from quillspark.operators import modules as M
    df = spark.createDataFrame([("/r/a/x.go", "/r", "m", "", "p"), ("/r10/x.go", "/r", "m", None, "p"), ("/r10/x.go", "/r", "m", "q/own", "p"),
                                ("/z/x.go", None, None, "", ""), (None, "/r", "m", "", None)], "path string, base string, name string, own string, clause string")
    named = M.package_path(F.col("own"), M.resolve_package("path", "base", "name"), F.col("clause"))
    assert [r.c for r in df.select(named.alias("c")).collect()] == ["m/a", "p", "q/own", "", ""]
    bad = [tuple(r) for r in M.resolve_rejects(df, "path", "base", "name").collect()]
    assert bad == [("package name", "/r10/x.go", "not inside module m at /r")] * 2 + [
        ("package name", "/z/x.go", "no module for the file"), ("package name", None, "not inside module m at /r")]
    assert len(bad) + df.filter(M.resolve_package("path", "base", "name").isNotNull()).count() == df.count()


def test_types_with_and_without_methods(spark):
    from quillspark.operators.decls import owner_methods
    types = spark.createDataFrame([("p", "A"), ("p", "B"), ("q", "A"), ("q", None)], "package string, owner string")
    methods = spark.createDataFrame([("p", "A", "f"), ("p", "A", "g"), ("q", "Z", "h"), ("q", None, "i")], "package string, owner string, method string")
    got = {how: sorted(map(str, (tuple(r) for r in owner_methods(types, methods, how).collect()))) for how in ("left", "inner", "left_semi", "left_anti")}
    assert got["inner"] == ["('p', 'A', 'f')", "('p', 'A', 'g')"] and got["left_semi"] == ["('p', 'A')"]
    assert got["left_anti"] == ["('p', 'B')", "('q', 'A')", "('q', None)"] and len(got["left"]) == 5
