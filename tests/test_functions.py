import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fileguard.functions import text
from fileguard.functions.text import _common_subsequence, name_entropy
import pandas as pd


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def column(spark, values, expression, schema="s string"):
    rows = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r[0] for r in rows.select(expression).collect()]


def test_entropy_goldens(spark):
    names = ["", "aaaa", "a😀b😀", "mydocument.encrypted", None, "x" * 300 + "y" * 300, "a\0b\0"]
    got = column(spark, names, name_entropy(F.col("s")))
    want = [entropy(n or "") for n in names]
    assert got == pytest.approx(want)
    assert round(got[3], 6) == 3.484184


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(min_size=250, max_size=400)), max_size=20))
def test_entropy_matches_counting(names):
    got = name_entropy.func(pd.Series(names, dtype=object))
    assert list(got) == pytest.approx([entropy(n or "") for n in names])
    assert all(0 <= g <= math.log2(max(len(n or ""), 1)) + 1e-9 for g, n in zip(got, names))


@settings(max_examples=200, deadline=None)
@given(st.text("abcd.", max_size=90), st.text("abcd.", max_size=20))
def test_common_subsequence(a, b):
    assert _common_subsequence(a, b) == lcs(a, b)


def test_indel_goldens(spark):
    pairs = [(".txt", ".txt"), ("", ""), (".txt", ""), (".doc", ".docx"), (".abc", ".xyz"), (".docx", ".encrypted")]
    got = column(spark, pairs, text.indel_ratio(F.col("a"), F.col("b")), "a string, b string")
    assert got == pytest.approx([1, 1, 0, 0.888889, 0.25, 0.266667], abs=1e-6)


def test_extension_and_token(spark):
    names = ["a.txt", ".bashrc", "foo.", "a.b.c", "...", "..x.y", "noext", "dir/a", "d.x/a", "d\\b.q"]
    assert column(spark, names, text.extension(F.col("s"))) == [".txt", "", ".", ".c", "", ".y", "", "", "", ".q"]
    names = ["a.tar.gz", "noext", "A.ENCRYPTED"]
    assert column(spark, names, text.last_token(F.col("s"))) == ["gz", "noext", "ENCRYPTED"]


def test_paths(spark):
    assert column(spark, ["a/b\\c", "x"], text.folder_of(F.col("s"))) == ["a/b", ""]
    assert column(spark, ["a\\b\\c"], text.separator_count(F.col("s"), "\\")) == [2]
