"""Joint counts of categorical pairs, and hashes of rows."""

import itertools
import math

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondage.operators import quality, relations


@given(st.lists(st.sampled_from([1, 2, 3, 7, 40, 400, 90_000, 10**9]), min_size=2, max_size=14), st.integers(4, 10**6))
def test_groups_cover_every_pair_and_stay_small(distinct, limit):
    groups, wide = relations.joint_groups(distinct, limit)
    pairs = set(itertools.combinations(range(len(distinct)), 2))
    covered = set().union(*(itertools.combinations(g, 2) for g in groups))
    assert {p for p in pairs if distinct[p[0]] * distinct[p[1]] > limit} == set(wide)
    assert covered | set(wide) == pairs
    assert all(math.prod(distinct[c] for c in g) <= limit for g in groups)


def test_ten_narrow_columns_need_few_passes():
    groups, wide = relations.joint_groups([4] * 10)
    assert len(groups) <= 4 and not wide  # 45 pairs, eight columns in a group


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        (("a", "b", None)[i % 3], ("x", "y")[i * i % 7 % 2], f"w{i % 700}", None if i % 11 == 0 else str(i % 5))
        for i in range(2000)
    ]
    return pd.DataFrame(rows, columns=["one", "two", "wide", "four"]), spark.createDataFrame(rows, "one string, two string, wide string, four string")


@pytest.mark.parametrize("limit", [3, 100, 100_000])
def test_cells_are_those_of_every_pair(frame, monkeypatch, limit):
    pdf, df = frame
    monkeypatch.setattr(relations, "joint_groups", lambda d, f=relations.joint_groups: f(d, limit))
    found = {tuple(r[:4]): r["n"] for part in relations._cells(df, df.columns) for r in part.collect()}
    wanted = {}
    for i, j in itertools.combinations(range(4), 2):
        counts = pdf.groupby([pdf.columns[i], pdf.columns[j]]).size()
        wanted |= {(i, j, *key): n for key, n in counts.items()}
    assert found == wanted


def test_no_row_of_the_table_is_copied(frame, capsys):
    _, df = frame
    narrow, = relations._cells(df, ["one", "two", "four"])
    narrow.explain("formatted")
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    tree = plan.split("\n\n")[0]
    assert tree.index("Generate") < tree.index("HashAggregate", tree.index("Generate")) < tree.index("Scan")


def test_duplicates_tell_missing_values_and_borders_apart(spark):
    rows = [("a", None, 0.0), (None, "a", 0.0), ("ab", "c", -0.0), ("a", "bc", 0.0), ("ab", "c", 0.0), (None, None, float("nan")), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, x double")
    assert quality.duplicates(df).first()[:] == (7, 4, 57.14)
    nested = df.select(F.array("a", "b").alias("l"), F.create_map(F.lit("k"), "a", F.lit("l"), "b").alias("m"))
    assert quality.duplicates(nested).first()["duplicate_rows"] == 4
    wide = spark.range(3).select(*[F.when(F.col("id") == i % 3, 1).alias(f"c{i}") for i in range(130)])
    assert quality.duplicates(wide).first()["duplicate_rows"] == 0
