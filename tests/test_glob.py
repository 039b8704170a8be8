"""Glob semantics: compiled once, evaluated by Spark (rlike) and by Python re as a cross-check."""
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions.glob import GlobError, glob_to_regex

CASES = [
    ("**/.temp-files/**", "/home/user/project/.temp-files/foo/bar.go", True),
    ("**/.temp-files/**", "project/.temp-files/file.go", True),
    ("src/*/test.go", "src/pkg/test.go", True),
    ("src/*/test.go", "src/pkg/sub/test.go", False),
    ("**/{bin,obj}/**", "dir/obj/lib/file.go", True),
    ("**/{bin,obj}/**", "dir/tmp/lib/file.go", False),
    ("src/**/test_{small,large}.go", "src/test_small.go", True),
    ("src/**/test_{small,large}.go", "src/pkg/test_large.go", True),
    ("src/**/test_{small,large}.go", "src/pkg/other.go", False),
    ("a/**/b", "a/b", True),
    ("a/**/b", "a/x/y/b", True),
    ("a/**", "a/", True),
    ("*.go", "dir/x.go", False),
    ("?.go", "a.go", True),
    ("?.go", "/.go", False),
    ("[abc].go", "b.go", True),
    ("[!abc].go", "d.go", True),
    ("[!abc].go", "a.go", False),
    ("[a-c]x", "bx", True),
    ("[[:digit:]]x", "7x", True),
    ("[[:digit:]]x", "ax", False),
    (r"\*.go", "*.go", True),
    (r"\*.go", "a.go", False),
    ("{,bak}file", "file", True),
    ("{,bak}file", "bakfile", True),
    ("{a,{b,c}}z", "cz", True),
    ("x", "xx", False),
    ("[+--]x", "/x", False),
    ("[.-0]x", "/x", False),
    ("[.-0]x", "0x", True),
    ("[a/]x", "/x", False),
    ("[!a]x", "/x", False),
    ("[/]x", "/x", False),
    ("[a-]x", "-x", True),
    ("a}b,c", "a}b,c", True),
    ("**", "a/b", True),
    ("a**b", "a/x/b", True),
    ("**.go", "a/b.go", True),
]

ERRORS = [("test[abc", "bracket is not closed"), ("test.go[", "bracket is not closed"), ("test[].go", "bracket holds nothing"),
          ("test[!].go", "bracket holds nothing"), ("test.{go,py", "brace is not closed"), ("{a,{b,c}", "brace is not closed"),
          ("test\\", "last backslash"), ("test[[:digit:].go", "bracket is not closed"), ("[[:nope:]]", "no POSIX class")]


@pytest.mark.parametrize("glob,path,expected", CASES)
def test_glob_python_re(glob, path, expected):
    rx = glob_to_regex(glob, "re2").replace(r"\z", r"\Z")
    assert bool(re.match(rx, path)) == expected or "[:" in rx


@pytest.mark.parametrize("glob,msg", ERRORS)
def test_glob_errors(glob, msg):
    with pytest.raises(GlobError, match=re.escape(msg)):
        glob_to_regex(glob)


def test_glob_spark(spark):
    rows = [(i, g, p, e) for i, (g, p, e) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, glob string, path string, expected boolean")
    got = {}
    for i, g, p, e in rows:
        got[i] = df.filter(F.col("i") == i).select(F.col("path").rlike(glob_to_regex(g)).alias("m")).first()["m"]
    assert all(got[i] == e for i, _, _, e in rows), [(rows[i][1], rows[i][2]) for i in got if got[i] != rows[i][3]]
