"""Queries for whole documents, written and read back line by line (Fx14): R1, R2, F7, O2, S4, S5, W3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import cte, fx
from ..shapes import package_lines_sql
from ..sources.sinks import read_lines, scratch_dir, write_lines
from . import documents as DOC
from .catalog import query
from .queries_modules import module_table

LINES_SQL = cte("fx14_files") + package_lines_sql()


def _lines(spark, sf_dir):
    return DOC.kept(DOC.document_lines(DOC.package_documents(fx(spark, sf_dir, "fx14_files"), module_table(spark, sf_dir))))


@query("s4_package_documents", oracle=LINES_SQL + "SELECT replace(package, '/', '_') || '.adoc' AS out_file, line_no, text FROM lines")
def s4_package_documents(spark, sf_dir):
    """Every package's document, written by the sink and read back."""
    out = scratch_dir(spark, "documents")
    lines = _lines(spark, sf_dir).withColumn("out_file", F.concat(F.translate("package", "/", "_"), F.lit(".adoc")))
    write_lines(lines, out, [*DOC.ORDER, "line"], "out_file")
    return read_lines(spark, out, "out_file")


@query("s5_merged_sections", oracle=LINES_SQL + """
, parts AS (SELECT '' AS package, CAST(0 AS BIGINT) AS line_no, '= Corpus' AS text UNION ALL SELECT package, 0, '' FROM docs UNION ALL SELECT package, line_no, text FROM lines)
SELECT CAST(row_number() OVER (ORDER BY package, line_no) AS BIGINT) AS line_no, text FROM parts""")
def s5_merged_sections(spark, sf_dir):
    """All packages in one document, its header once, written by the sink and read back."""
    out = scratch_dir(spark, "merged")
    lines = _lines(spark, sf_dir)
    first = lines.select("package").distinct().select("package", *[F.lit(v).alias(c) for c, v in zip(DOC.ORDER, (-1, "", 0, 0, "", 0))], F.lit(0).alias("line"), F.lit("").alias("text"))
    header = spark.range(1).select(F.lit("").alias("package"), *[F.lit(v).alias(c) for c, v in zip(DOC.ORDER, (-1, "", 0, 0, "", 0))], F.lit(0).alias("line"), F.lit("= Corpus").alias("text"))
    write_lines(header.unionByName(first).unionByName(lines), out, ["package", *DOC.ORDER, "line"])
    return read_lines(spark, out)
