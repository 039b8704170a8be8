"""Example JSON / YAML documents per struct from its field rows.

Values come from a ``when`` chain on the field type.  One aggregation gathers a struct's
fields in their order, nested ones after the field that opens them; a field's
depth and the next one's then tell where objects open and close, at any depth.  A
group is one struct's fields, so no group grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decls import tag_value
from .tree import let, scan

# Example literal per basic type.
_INTS = ["int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "byte", "rune"]


def example_value(type_text: Column) -> Column:
    t = F.trim(type_text)
    return (F.when(t == "string", F.lit('"example"'))
            .when(t.isin(*_INTS), F.lit("0"))
            .when(t.isin("float32", "float64"), F.lit("0.0"))
            .when(t == "bool", F.lit("false"))
            .when(t.contains("."), F.lit('"value"'))
            .otherwise(F.lit("{}")))


def _pad(n: Column) -> Column:
    return F.when(n <= 0, F.lit("")).otherwise(F.repeat(F.lit("  "), n))


def _shown(fields: DataFrame, key: Sequence[str], tag_key: str, value: Column) -> DataFrame:
    """``key, owner_line, owner, rows``: each struct's visible fields in order, ``(depth, name, value, opens)``.

    ``opens`` tells whether a nested struct has rows (0: it has none, 1: none that shows, 2: some that show); null for
    other fields.  A field shows if it is exported, named, not left out by its tag, and all around it show.
    """
    tv = tag_value("tag", tag_key)
    name = F.when(tv != "", F.substring_index(tv, ",", 1)).otherwise(F.col("name"))
    seen = F.col("exported") & (F.col("name") != "") & (tv != "-") & (name != "")
    row = F.struct("line_no", "name_pos", F.col("depth").cast("int").alias("depth"), name.alias("name"), value.alias("value"), F.coalesce("anonymous", F.lit(False)).alias("nests"),
                   F.coalesce(seen, F.lit(False)).alias("seen"))
    kind = "struct<depth:int,name:string,value:string,nests:boolean,shows:boolean>"

    def step(hidden: Column, r: Column) -> tuple[Column, Column]:
        """``hidden``: depth of the nearest field around that doesn't show, or null."""
        below = F.when(r["depth"] > hidden, hidden)
        shows = below.isNull() & r["seen"]
        return (F.when(below.isNotNull(), below).when(~r["seen"], r["depth"]),
                F.struct(r["depth"].alias("depth"), r["name"].alias("name"), r["value"].alias("value"), r["nests"].alias("nests"), shows.alias("shows")))

    def with_next(rows: Column) -> Column:
        more = F.transform(rows, lambda r, i: F.struct(r.alias("r"), F.coalesce(F.get(rows, i + 1)["depth"] > r["depth"], F.lit(False)).alias("has")))
        return let(F.filter(more, lambda m: m["r"]["shows"]), lambda own: F.transform(own, lambda m, i: F.struct(
            m["r"]["depth"].alias("depth"), m["r"]["name"].alias("name"), m["r"]["value"].alias("value"),
            F.when(m["r"]["nests"], F.when(~m["has"], 0).when(F.coalesce(F.get(own, i + 1)["r"]["depth"] > m["r"]["depth"], F.lit(False)), 2).otherwise(1)).alias("opens"))))

    rows = scan(F.array_sort(F.collect_list(row)), F.lit(None).cast("int"), step, kind)
    return fields.groupBy(*key, "owner_line", "owner").agg(let(rows, with_next).alias("rows"))


def _documents(shown: DataFrame, key: Sequence[str], text: Column, column: str, owners: DataFrame | None) -> DataFrame:
    k = [*key, "owner_line", "owner"]
    out = shown.select(*k, text.alias(column))
    if owners is not None:  # structs without fields
        out = owners.select(*k).join(out.hint("merge"), k, "left").withColumn(column, F.coalesce(column, F.lit("{}")))
    return out.select(*key, "owner", column)


def example_json(fields: DataFrame, key: Sequence[str], owners: DataFrame | None = None) -> DataFrame:
    """``owners(key, owner_line, owner)``: all structs, so that those without fields get a row too."""
    t = F.regexp_replace(F.trim(F.col("type_text")), r"^\*", "")
    value = F.when(t.startswith("[]"), F.concat(F.lit("["), example_value(F.substr(t, F.lit(3))), F.lit("]"))) \
        .when(t.startswith("map["), F.lit("{}")).otherwise(example_value(t))

    def line(rows: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            depth = r["depth"]
            then = F.coalesce(F.get(rows, i + 1)["depth"], F.lit(-1))
            own = F.when(r["opens"] == 0, "{}").when(r["opens"] == 1, F.concat(F.lit("{\n"), _pad(depth + 1), F.lit("}"))) \
                .when(r["opens"] == 2, "{\n").otherwise(r["value"])
            closes = F.when(depth > then, F.array_join(F.transform(F.sequence(depth, then + 1, F.lit(-1)), lambda d: F.concat(F.lit("\n"), _pad(d), F.lit("}"))), ""))
            after = F.when(r["opens"] == 2, "").otherwise(F.concat(F.coalesce(closes, F.lit("")), F.when(then >= 0, ",\n").otherwise("")))
            return F.concat(_pad(depth + 1), F.lit('"'), r["name"], F.lit('": '), own, after)
        return F.when(F.size(rows) == 0, "{\n}").otherwise(F.concat(F.lit("{\n"), F.array_join(F.transform(rows, one), "")))
    return _documents(_shown(fields, key, "json", value), key, line(F.col("rows")), "example_json", owners)


def example_yaml(fields: DataFrame, key: Sequence[str], owners: DataFrame | None = None) -> DataFrame:
    """``owners(key, owner_line, owner)``: all structs, so that those without fields get a row too."""
    t = F.regexp_replace(F.trim(F.col("type_text")), r"^\*", "")
    value = F.when(t.startswith("[]"), F.concat(F.lit("\n"), _pad(F.col("depth") + 1), F.lit("- "), example_value(F.substr(t, F.lit(3))))) \
        .when(t.startswith("map["), F.lit(" {}")).otherwise(F.concat(F.lit(" "), example_value(t)))
    lines = F.transform("rows", lambda r: F.concat(_pad(r["depth"]), r["name"], F.lit(":"),
                                                   F.when(r["opens"] == 2, "").when(r["opens"].isNotNull(), " {}").otherwise(r["value"])))
    return _documents(_shown(fields, key, "yaml", value), key, F.array_join(lines, "\n"), "example_yaml", owners)
