"""Physical-plan discipline for every registered query (sf0.001):
no cartesian / nested-loop joins, Python only in the user-function operators,
column pruning at the scans of the flagship."""
import pytest
from pyspark.sql import functions as F

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
catalog.load_all()
QS = catalog.QUERIES
PYTHON_OK = {"p1_per_file_function", "p2_per_package_function", "p2_package_stream"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QS))
def test_plan_shape(spark, name):
    plan = _plan(QS[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    if name not in PYTHON_OK:
        for op in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
            assert op not in plan, op


def test_flagship_prunes_columns(spark):
    df = QS["flagship_page_links"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "page_id" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_declarations_without_shuffle(spark):
    """Nodes come from within a file's row: no text moves, apart from the spread of the small input table before texts are made."""
    for name in ("e6_declarations", "e6_declaration_shapes", "e8_fields", "e8_field_shapes", "e11_interface_methods"):
        plan = _plan(QS[name](spark, SF))
        assert "Exchange hashpartitioning" not in plan and "Window" not in plan and "Join" not in plan, name
        assert "RoundRobinPartitioning" in plan and "content" not in plan.split("RoundRobinPartitioning")[1], name


@pytest.mark.parametrize("name", ["j2_first_prefix_owner", "j3_longest_prefix", "j4_module_membership", "j5_nearest_manifest", "j6_resolve_package"])
def test_prefix_joins_resolve_distinct_values(spark, name):
    """Rows are neither regrouped nor multiplied: aggregates know the resolved value only, and rows meet it in one join."""
    plan = _plan(QS[name](spark, SF))
    assert "SortAggregate" not in plan and "first(" not in plan and "array_repeat" not in plan
    for line in plan.split("\n"):
        if "Aggregate(" in line or "Generate " in line:
            assert "l_orderkey" not in line, line


@pytest.mark.parametrize("name", ["a2_package_aggregate", "a4_kind_totals", "j1_types_and_methods", "j1_types_with_methods", "p3_layout_override", "r1_decl_sections", "r2_section_wrappers"])
def test_tables_that_grow_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in _plan(QS[name](spark, SF))


@pytest.mark.parametrize("name", ["j1_owner_methods", "j1_types_and_methods", "j1_types_with_methods"])
def test_owners_and_methods_are_parsed_once(spark, monkeypatch, name):
    """Both sides of the join read one table of declarations; no text is parsed for either, and nothing is broadcast for the table."""
    from quillspark.plans import queries_decls
    plans, keep = [], queries_decls.kept
    monkeypatch.setattr(queries_decls, "kept", lambda df: (plans.append(_plan(df)), keep(df))[1])
    plan = _plan(QS[name](spark, SF))
    assert "SortMergeJoin" in plan and "RoundRobinPartitioning" not in plan
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastExchange" not in plans[0] + plan


def test_rows_of_package_documents_are_not_broadcast(spark, monkeypatch):
    from quillspark.plans import queries_output
    plans, write = [], queries_output.write_per_group
    monkeypatch.setattr(queries_output, "write_per_group", lambda rows, *a: (plans.append(_plan(rows)), write(rows, *a)))
    QS["s4_per_package_documents"](spark, SF)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastExchange" not in plans[0]


@pytest.mark.parametrize("name", ["a8_example_shapes", "a9_example_shapes"])
def test_examples_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in _plan(QS[name](spark, SF))


def test_texts_come_in_tasks_of_bounded_size(spark, monkeypatch):
    from quillspark import fixtures
    monkeypatch.setattr(fixtures, "TASK_FILES", 20)
    assert "RoundRobinPartitioning(10)" in _plan(fixtures.fx(spark, SF, "fx1_files"))


def test_imports_need_the_import_part_only(spark):
    from quillspark.operators import decls as D, lines as L
    texts = ["", "package p", "import \"a\"\nvar x = (\n)\nimport (\n// b\n\tb \"b/c\"\n\n\"d\"\n)\nfunc f() {\n\"e\"\n}\n", "import (\n\"a\"\n\"b\"", "/* import\n*/\nimport . \"x\"\n// end\n\"no\"", "importer\n(\n"]
    files = spark.createDataFrame(list(enumerate([*texts, None])), "file_id long, content string")
    rows = lambda f: sorted(map(tuple, D.imports(L.lines(f, ["file_id"]), ["file_id"]).collect()))
    assert rows(D.import_part(files)) == rows(files) and len(rows(files)) >= 6
    assert D.import_part(files).filter("content like '%func%'").count() == 0


@pytest.mark.parametrize("name", ["w2_signature_markup", "w2_signature_blocks"])
def test_signatures_are_linked_in_their_rows(spark, name):
    """Texts are cut, linked, put together and highlighted inside their rows: their pieces are no rows, and blocks aren't regrouped."""
    plan = _plan(QS[name](spark, SF))
    assert plan.count("Exchange hashpartitioning") <= 13 and "inline(blocks" not in plan


def test_parameters_of_a_list_come_from_its_row(spark):
    from quillspark.operators import decls as D
    df = spark.createDataFrame([(1, "a, b int, c"), (1, ""), (2, "a, *b.C"), (3, "x, y, z []T, w map[K]V")], "decl_line int, list_text string").selectExpr("*", "'r' AS role", "0 AS file_id")
    out = D.param_rows(df, ["file_id"])
    assert "Exchange" not in _plan(out) and "Window" not in _plan(out)
    assert sorted((r.decl_line, -1 if r.pos is None else r.pos, r.name, r.type_text) for r in out.collect()) == [
        (1, -1, None, None), (1, 0, "a", "int"), (1, 1, "b", "int"), (1, 2, "c", None), (2, 0, "", "a"), (2, 1, "", "*b.C"),
        (3, 0, "x", "[]T"), (3, 1, "y", "[]T"), (3, 2, "z", "[]T"), (3, 3, "w", "map[K]V")]


def test_linked_texts_of_repeated_keys(spark):
    """A key that stands twice has the pieces of both texts; a null in it links nothing."""
    from quillspark.operators import links as LK
    rows = spark.createDataFrame([(1, 0, "[]T"), (1, 0, "[]T"), (1, 1, "map[a.B]x.Y"), (None, 2, "T"), (2, 0, "a.B"), (2, 1, None)], "file_id long, pos int, t string")
    aliases = spark.createDataFrame([(1, "a", "m/a"), (1, "x", "o/x")], "file_id long, alias_key string, import_path string")
    modules, scope = spark.createDataFrame([("m",)], "name string"), spark.createDataFrame([(1, "K")], "file_id long, name string")
    out = LK.linked_texts(rows, ["file_id", "pos"], "t", ["file_id"], aliases, modules, F.lit("p"), scope, ["file_id"])
    got = sorted(((str(r.file_id), r.pos, r.linked) for r in out.collect()), key=str)
    assert got == sorted([("1", 0, "[[]]<<p-T,T>><<p-T,T>>")] * 2 + [("1", 1, "map[<<m-a-B,a.B>>]link:https://pkg.go.dev/o/x#Y[x.Y]"), ("None", 2, None), ("2", 0, "a.B"), ("2", 1, "")], key=str)


def test_documents_are_written_and_read_a_folder_at_a_time(spark, tmp_path, monkeypatch):
    """The driver holds the paths of a folder's documents, not those of all, and what is read back names none of them."""
    from quillspark.sources import sinks
    monkeypatch.setattr(sinks, "FOLDER_DOCS", 8, raising=False)
    names = [f"d{i}.adoc" for i in range(20)] + ["0123", "a b=c", "2024-01-01"]
    lines = spark.createDataFrame([(n, i, t) for n in names for i, t in enumerate(["= " + n, "", "x", ""][:2 + len(n) % 3])], "doc string, line int, text string")
    out = str(tmp_path / "out")
    sinks.write_lines(lines, out, ["line"], "doc")
    folders = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert folders == ["docs-00000", "docs-00001", "docs-00002"] and sum(len(list(p.glob("doc=*"))) for p in (tmp_path / "out").iterdir()) == len(names)
    back = sinks.read_lines(spark, out, "doc")
    assert not any("doc=" in f for f in back.inputFiles())
    assert sorted(map(tuple, back.collect())) == sorted((r.doc, r.line + 1, r.text) for r in lines.collect())
    manifest = sinks.document_manifest(spark, out, "doc")
    assert manifest.groupBy().agg(F.sum("lines")).first()[0] == lines.count() and manifest.filter("first_line = 1").count() == len(names)
    sinks.write_lines(lines.limit(0), str(tmp_path / "none"), ["line"], "doc")
