"""Relations between columns: correlation, chi-square association, analysis of variance.

Column pairs come from the schema; rows are never joined with each other. All numeric
pairs come from one scan, all categorical pairs one counted pass, and all
numeric-by-categorical pairs one grouped pass. Tail probabilities are computed on the
resulting rows, one per pair.
"""

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.columns import (
    categorical_columns,
    column,
    identity_key,
    nan_as_null,
    numeric_columns,
    require,
    rounded,
)
from sondage.functions.pvalues import anova_p, chi_square_p, pearson_p
from sondage.functions.rules import correlation_label

CORRELATION_THRESHOLD = 0.7
MIN_CRAMERS_V = 0.3
MIN_ETA_SQUARED = 0.06
SIGNIFICANCE = 0.05
# The numeric columns of one analysis of variance pass: larger aggregations are no longer
# compiled by the JVM.
NUMERIC_PER_PASS = 10
# A pass over categorical pairs makes this many copies of two keys per row.
PAIRS_PER_PASS = 45
# Categorical columns are counted together while their joint table has so few cells.
JOINT_CELLS = 100_000


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


MOMENTS = ("n", "mx", "my", "sxx", "syy", "sxy")


def _moments_of(x: np.ndarray) -> np.ndarray:
    """n, means, sums of squares and products around them of all column pairs of a batch,
    over the rows where both are present: an array (6, columns, columns)."""
    present = ~np.isnan(x)
    shift = np.where(present.any(0), np.nan_to_num(x).sum(0) / np.maximum(present.sum(0), 1), 0.0)
    x = np.where(present, x - shift, 0.0)
    there = present.astype(float)
    n = there.T @ there
    many = np.maximum(n, 1.0)
    sx, sxx = x.T @ there, (x * x).T @ there
    mean = sx / many
    around = sxx - sx * mean
    return np.stack([
        n, mean + shift[:, None], mean.T + shift, np.maximum(around, 0.0),
        np.maximum(around.T, 0.0), x.T @ x - sx * mean.T,
    ])


def _together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of two sets of rows as those of all."""
    n = a[0] + b[0]
    share = a[0] * b[0] / np.maximum(n, 1.0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    part = b[0] / np.maximum(n, 1.0)
    return np.stack([
        n, a[1] + dx * part, a[2] + dy * part, a[3] + b[3] + dx * dx * share,
        a[4] + b[4] + dy * dy * share, a[5] + b[5] + dx * dy * share,
    ])


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (i, j, n, mx, my, sxx, syy, sxy) for i <= j, from one scan for all pairs.

    Every task multiplies the matrices of its batches and passes on one row per pair;
    these are put together around their own means, so that no digits cancel.
    """
    values = nan_as_null(df).select(
        *[column(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]
    )
    at = np.triu_indices(len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1)
            found = _moments_of(x)
            total = found if total is None else _together(total, found)
        if total is not None:
            arrays = [at[0], at[1], *[m[at] for m in total]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["i", "j", *MOMENTS])

    rows = values.mapInArrow(run, "i bigint, j bigint, " + ", ".join(f"{m} double" for m in MOMENTS))
    none = F.struct(*[F.lit(0.0).alias(m) for m in MOMENTS])

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        part = F.coalesce(F.try_divide(b["n"], n), F.lit(0.0))
        dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
        share = a["n"] * part
        return F.struct(
            n.alias("n"), (a["mx"] + dx * part).alias("mx"), (a["my"] + dy * part).alias("my"),
            (a["sxx"] + b["sxx"] + dx * dx * share).alias("sxx"),
            (a["syy"] + b["syy"] + dy * dy * share).alias("syy"),
            (a["sxy"] + b["sxy"] + dx * dy * share).alias("sxy"),
        )

    # One row per task and pair; in a fixed order, so that sums do not vary.
    lists = rows.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct(*MOMENTS))).alias("parts"))
    merged = lists.select("i", "j", F.aggregate("parts", none, add).alias("m"))
    return merged.select(F.col("i").cast("int"), F.col("j").cast("int"), "m.*")


def pair_correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (i, j, column1, column2, r, n) for i <= j, over rows where both are present.

    r is Pearson's; NULL if either column is constant there.
    """
    columns = list(columns or numeric_columns(df))
    require(df, columns)
    if len(columns) < 2:
        raise ValueError("At least 2 numeric columns are needed")
    r = F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))
    # Rounding errors must not carry r past 1; a column goes with itself exactly.
    r = F.when(F.abs(r) > 1, F.signum(r)).otherwise(r)
    r = F.when((F.col("i") == F.col("j")) & r.isNotNull(), 1.0).otherwise(r)
    pairs = pair_moments(df, columns).where(F.col("n") > 0)
    every = df.sparkSession.createDataFrame(
        [(i, j) for j in range(len(columns)) for i in range(j + 1)], "i int, j int"
    )
    pairs = F.broadcast(every).join(pairs, ["i", "j"], "left").withColumn("r", r)
    n = F.coalesce("n", F.lit(0.0)).cast("bigint").alias("n")
    return _named(pairs, columns, columns).select("i", "j", "column1", "column2", "r", n)


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``pair_correlations`` of different columns: i < j."""
    return pair_correlations(df, columns).where("i < j")


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """Rows (column1, column2, correlation) of the full square matrix, to 4 dp.

    ``pairs`` are the ``pair_correlations`` of the same columns, if they are at hand.
    """
    pairs = pair_correlations(df, columns) if pairs is None else pairs
    value = rounded(F.col("r"), 4).alias("correlation")
    one = F.struct(F.col("column1"), F.col("column2"), value)
    other = F.struct(F.col("column2").alias("column1"), F.col("column1").alias("column2"), value)
    ways = F.when(F.col("i") < F.col("j"), F.array(one, other)).otherwise(F.array(one))
    return pairs.select(F.inline(ways))


def strong_correlations(
    df: DataFrame, threshold: float = CORRELATION_THRESHOLD, pairs: DataFrame | None = None
) -> DataFrame:
    """Rows (column1, column2, correlation) with |r| at or above the threshold."""
    pairs = pair_correlations(df) if pairs is None else pairs
    return pairs.where((F.col("i") < F.col("j")) & (F.abs("r") >= threshold)).select(
        "column1", "column2", rounded(F.col("r"), 4).alias("correlation")
    )


def numeric_relations(
    df: DataFrame, threshold: float | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """Correlated numeric pairs with label and p-value. None means the default threshold."""
    threshold = CORRELATION_THRESHOLD if threshold is None else threshold
    return (
        (pair_correlations(df) if pairs is None else pairs)
        .where((F.col("i") < F.col("j")) & (F.abs("r") >= threshold))
        .withColumn("p", pearson_p(F.col("r"), F.col("n").cast("double")))
        .select(
            "i", "j", "column1", "column2",
            correlation_label(F.col("r")).alias("relationship_type"),
            "r", "n", "p",
        )
    )


def contingency(df: DataFrame, column1: str, column2: str) -> DataFrame:
    """Rows (value1, value2, n) of the observed cells; rows with a missing value left out."""
    require(df, [column1, column2])
    both = df.where(column(column1).isNotNull() & column(column2).isNotNull())
    return both.groupBy(column(column1).alias("value1"), column(column2).alias("value2")).agg(
        F.count(F.lit(1)).alias("n")
    )


def joint_groups(
    distinct: Sequence[int], limit: int = JOINT_CELLS
) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Groups of columns, by number, whose joint table has at most ``limit`` cells, so that
    every pair that can be is in one; and the pairs that are too wide by themselves.

    Each group starts from the narrowest pair left and takes in, one by one, the column
    that adds most pairs still left (of equal ones the narrowest) while it stays small.
    """
    left = set(combinations(range(len(distinct)), 2))
    wide = sorted((i, j) for i, j in left if distinct[i] * distinct[j] > limit)
    left -= set(wide)
    groups = []
    while left:
        group = list(min(left, key=lambda p: (distinct[p[0]] * distinct[p[1]], p)))
        cells = distinct[group[0]] * distinct[group[1]]
        while True:
            gains = {
                c: sum((min(c, g), max(c, g)) in left for g in group)
                for c, n in enumerate(distinct) if c not in group and cells * n <= limit
            }
            best = min(gains, key=lambda c: (-gains[c], distinct[c], c), default=None)
            if best is None or not gains[best]:
                break
            group.append(best)
            cells *= distinct[best]
        groups.append(sorted(group))
        left -= set(combinations(sorted(group), 2))
    return groups, wide


def _pair_cells(rows: DataFrame, pairs: Sequence[tuple[int, int]], n: Column) -> DataFrame:
    """Rows (i, j, v1, v2, n) from rows of keys that stand for ``n`` rows each."""
    copies = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(j).alias("j"),
                F.col(f"_k{i}").alias("v1"),
                F.col(f"_k{j}").alias("v2"),
            )
            for i, j in pairs
        ]
    )
    return (
        rows.select(n.alias("_n"), F.inline(copies))
        .where(F.col("v1").isNotNull() & F.col("v2").isNotNull())
        .groupBy("i", "j", "v1", "v2")
        .agg(F.sum("_n").cast("double").alias("n"))
    )


def _cells(df: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """Rows (i, j, v1, v2, n): the contingency tables of all pairs.

    Narrow columns are counted together, in groups that hold every pair once at least, and
    each pair is summed from the joint counts of its smallest group: no row of the table is
    copied. Estimated distinct counts choose the groups and change no result. Only pairs
    too wide for a joint table copy the rows, in one pass for PAIRS_PER_PASS of them.
    """
    keys = df.select(
        *[identity_key(c, df.schema[c].dataType).alias(f"_k{i}") for i, c in enumerate(columns)]
    )
    counts = keys.agg(*[F.approx_count_distinct(c) for c in keys.columns]).first()
    # Missing values are a value of the joint table.
    groups, wide = joint_groups([n + 1 for n in counts])
    size = {tuple(g): math.prod(counts[i] + 1 for i in g) for g in groups}
    mine: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for pair in combinations(range(len(columns)), 2):
        if pair not in wide:
            home = min((g for g in size if {*pair} <= {*g}), key=lambda g: (size[g], g))
            mine.setdefault(home, []).append(pair)
    narrow = [
        _pair_cells(keys.groupBy(*[f"_k{i}" for i in group]).agg(F.count(F.lit(1)).alias("_all")), pairs, F.col("_all"))
        for group, pairs in mine.items()
    ]
    passes = [wide[i : i + PAIRS_PER_PASS] for i in range(0, len(wide), PAIRS_PER_PASS)]
    found = [_union(narrow)] if narrow else []
    return found + [_pair_cells(keys, pairs, F.lit(1)) for pairs in passes]


def associations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (i, j, column1, column2, chi_square, dof, cramers_v, n) for i < j.

    Cells that never occur need no row. With one degree of freedom it is Yates-corrected. Pairs in which a
    column has a single value are left out.

    Marginals are aggregates of the counted cells, joined back on the value. A value
    held by a third of the rows makes a skewed partition there; adaptive execution
    splits it, or broadcasts the marginals once it has seen that they are small.
    """
    columns = list(columns or categorical_columns(df))
    require(df, columns)
    if len(columns) < 2:
        raise ValueError("At least 2 categorical columns are needed")
    parts = []
    for cells in _cells(df, columns):
        first = cells.groupBy("i", "j", "v1").agg(F.sum("n").alias("r"))
        second = cells.groupBy("i", "j", "v2").agg(F.sum("n").alias("c"))
        # A row per pair.
        totals = first.groupBy("i", "j").agg(
            F.sum("r").alias("total"), F.count(F.lit(1)).alias("rows")
        )
        widths = second.groupBy("i", "j").agg(F.count(F.lit(1)).alias("cols"))
        sizes = totals.join(widths, ["i", "j"]).where((F.col("rows") > 1) & (F.col("cols") > 1))
        o, r, c, total = (F.col(x) for x in ("n", "r", "c", "total"))
        e = r * c / total
        sums = (
            cells.join(F.broadcast(sizes), ["i", "j"])
            .join(first, ["i", "j", "v1"])
            .join(second, ["i", "j", "v2"])
            .groupBy("i", "j")
            .agg(
                F.max("total").alias("n"),
                F.max("rows").alias("rows"),
                F.max("cols").alias("cols"),
                # (o - e)^2 / e of the observed cells, and e of the others: what their
                # e leaves of the total.
                F.sum((o - e) * (o - e) / e + (o - e)).alias("fit"),
                # In a 2x2 table every cell gives the same |ad - bc| and margin product.
                F.max(F.abs(o * total - r * c)).alias("cross"),
                F.max(r * (total - r) * c * (total - c)).alias("margins"),
            )
        )
        parts.append(sums)
    n = F.col("n")
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    shrunk = F.greatest(F.col("cross") - n / 2.0, F.lit(0.0))
    yates = F.try_divide(n * shrunk * shrunk, F.col("margins"))
    plain = F.greatest(F.col("fit"), F.lit(0.0))
    smaller = F.least("rows", "cols") - 1
    return (
        _named(_union(parts), columns, columns)
        .withColumn("dof", dof)
        .withColumn("chi_square", F.when(F.col("dof") == 1, yates).otherwise(plain))
        .withColumn("cramers_v", F.sqrt(F.try_divide(F.col("chi_square"), n * smaller)))
        .select("i", "j", "column1", "column2", "chi_square", "dof", "cramers_v", "n")
    )


def _named(df: DataFrame, firsts: Sequence[str], seconds: Sequence[str]) -> DataFrame:
    def name(names: Sequence[str], index: str) -> Column:
        return F.get(F.array(*[F.lit(x) for x in names]), F.col(index))

    return df.withColumns({"column1": name(firsts, "i"), "column2": name(seconds, "j")})


def categorical_relations(df: DataFrame) -> DataFrame:
    """Associated categorical pairs: V at least 0.3 and p below 0.05."""
    return (
        associations(df)
        .where(F.col("cramers_v") >= MIN_CRAMERS_V)
        .withColumn("p", chi_square_p(F.col("chi_square"), F.col("dof").cast("double")))
        .where(F.col("p") < SIGNIFICANCE)
    )


def variance_by_category(
    df: DataFrame,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
) -> DataFrame:
    """Rows (i, j, column1, column2, f_statistic, eta_squared, k, n) for each numeric
    (column1) by categorical (column2) column: one-way analysis of variance.

    Group counts, means and variances come from one pass over all category columns; the
    sums of squares are taken around the mean of all rows, which keeps them exact.
    eta squared compares them with the variance of all rows, also those without a
    category; 0 if that is 0. Pairs with a single group are left out.
    """
    numeric = list(numeric or numeric_columns(df))
    categorical = list(categorical or categorical_columns(df))
    require(df, [*numeric, *categorical])
    if not numeric or not categorical:
        raise ValueError("A numeric and a categorical column are needed")
    if len(numeric) > NUMERIC_PER_PASS:
        starts = range(0, len(numeric), NUMERIC_PER_PASS)
        return _union(
            [
                variance_by_category(df, numeric[s : s + NUMERIC_PER_PASS], categorical)
                .withColumn("i", F.col("i") + s)
                for s in starts
            ]
        )
    clean = nan_as_null(df)
    values = [column(c).cast("double").alias(f"_v{i}") for i, c in enumerate(numeric)]
    names = [f"_v{i}" for i in range(len(numeric))]
    whole = (
        clean.select(*values)
        .agg(
            F.struct(
                *[F.avg(v).alias(f"mean{v}") for v in names],
                *[(F.var_pop(v) * F.count(v)).alias(f"sst{v}") for v in names],
            ).alias("whole")
        )
        .scalar()
    )
    copies = F.array(
        *[
            F.struct(
                F.lit(j).alias("j"),
                identity_key(c, df.schema[c].dataType).alias("category"),
            )
            for j, c in enumerate(categorical)
        ]
    )
    groups = (
        clean.select(*values, F.inline(copies))
        .where(F.col("category").isNotNull())
        .groupBy("j", "category")
        .agg(
            *[F.count(v).alias(f"n{v}") for v in names],
            *[F.avg(v).alias(f"m{v}") for v in names],
            *[(F.var_pop(v) * F.count(v)).alias(f"s{v}") for v in names],
        )
    )
    groups = groups.withColumn("_whole", whole)
    whole = F.col("_whole")
    rows = []
    for i, v in enumerate(names):
        n, shift = F.col(f"n{v}"), F.col(f"m{v}") - whole[f"mean{v}"]
        rows.append(
            F.struct(
                F.lit(i).alias("i"),
                F.count_if(n > 0).alias("k"),
                F.sum(n).alias("n"),
                F.sum(n * shift).alias("shift"),
                F.sum(n * shift * shift).alias("around_mean"),
                F.sum(f"s{v}").alias("within"),
                F.max(whole[f"sst{v}"]).alias("sst"),
            )
        )
    sums = (
        groups.groupBy("j")
        .agg(F.array(*rows).alias("rows"))
        .select("j", F.inline("rows"))
        .where(F.col("k") >= 2)
    )
    k, n = F.col("k"), F.col("n")
    between = F.col("around_mean") - F.col("shift") * F.col("shift") / n
    between_ms = F.try_divide(between, (k - 1).cast("double"))
    within_ms = F.try_divide(F.col("within"), (n - k).cast("double"))
    f = F.when((within_ms == 0) & (between_ms > 0), float("inf")).otherwise(
        F.try_divide(between_ms, within_ms)
    )
    eta = F.when(F.col("sst") > 0, F.col("around_mean") / F.col("sst")).otherwise(0.0)
    return (
        _named(sums, numeric, categorical)
        .withColumn("f_statistic", f)
        .withColumn("eta_squared", eta)
        .select("i", "j", "column1", "column2", "f_statistic", "eta_squared", "k", "n")
    )


def mixed_relations(df: DataFrame) -> DataFrame:
    """Numeric columns influenced by a category: eta squared at least 0.06, p below 0.05."""
    return (
        variance_by_category(df)
        .where(F.col("eta_squared") >= MIN_ETA_SQUARED)
        .withColumn(
            "p", anova_p(F.col("f_statistic"), F.col("k").cast("double"), F.col("n").cast("double"))
        )
        .where(F.col("p") < SIGNIFICANCE)
    )


RELATIONSHIP_FIELDS = [
    ("correlation", "double"),
    ("cramers_v", "double"),
    ("chi_square", "double"),
    ("degrees_of_freedom", "bigint"),
    ("eta_squared", "double"),
    ("f_statistic", "double"),
    ("p_value", "double"),
    ("significance", "string"),
]


def _relationship(
    found: DataFrame, kind: Column, order: int, strength: Column, text: Column, **metrics: Column
) -> DataFrame:
    empty = F.lit(None)
    return found.select(
        F.lit(order).alias("kind_order"),
        "i",
        "j",
        "column1",
        "column2",
        kind.alias("relationship_type"),
        strength.alias("strength"),
        text.alias("description"),
        *[metrics.get(m, empty).cast(t).alias(m) for m, t in RELATIONSHIP_FIELDS],
    )


def relationships(
    df: DataFrame,
    threshold: float | None = None,
    limit: int | None = 50,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """The relationships found, strongest first, at most ``limit`` (None for all).

    Rows as of ``all_relationships``, without the columns that order them.
    """
    return strongest(all_relationships(df, threshold, pairs), limit)


def all_relationships(
    df: DataFrame, threshold: float | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """All relationships found, in no order; kind_order, i and j order equal strengths.

    Rows (column1, column2, relationship_type, strength, description, the metrics of
    each kind or NULL). Equal strengths keep the order numeric, categorical, mixed, and
    within a kind that of the columns.
    """
    numeric, categorical = numeric_columns(df), categorical_columns(df)
    parts = []
    if len(numeric) >= 2:
        found = numeric_relations(df, threshold, pairs)
        r = rounded(F.col("r"), 4)
        kind = F.col("relationship_type")
        text = F.format_string(
            "%s and %s: %s, |r| = %.2f", "column1", "column2", kind, F.abs("r")
        )
        parts.append(
            _relationship(
                found, kind, 0, r, text,
                correlation=r,
                p_value=rounded(F.col("p"), 6),
                significance=F.when(F.col("p") < SIGNIFICANCE, "significant").otherwise(
                    "not significant"
                ),
            )
        )
    if len(categorical) >= 2:
        found = categorical_relations(df)
        v = rounded(F.col("cramers_v"), 4)
        text = F.format_string(
            "%s and %s depend on each other, V = %.2f", "column1", "column2", "cramers_v"
        )
        parts.append(
            _relationship(
                found, F.lit("categorical_association"), 1, v, text,
                cramers_v=v,
                chi_square=rounded(F.col("chi_square"), 4),
                degrees_of_freedom=F.col("dof"),
                p_value=rounded(F.col("p"), 6),
            )
        )
    if numeric and categorical:
        found = mixed_relations(df)
        eta = rounded(F.col("eta_squared"), 4)
        text = F.format_string(
            "%s varies with %s, η² = %.2f", "column1", "column2", "eta_squared"
        )
        parts.append(
            _relationship(
                found, F.lit("numeric_categorical"), 2, eta, text,
                eta_squared=eta,
                f_statistic=rounded(F.col("f_statistic"), 4),
                p_value=rounded(F.col("p"), 6),
            )
        )
    fields = ", ".join(f"{m} {t}" for m, t in RELATIONSHIP_FIELDS)
    if parts:
        every = _union(parts)
    else:
        every = df.sparkSession.createDataFrame(
            [],
            "kind_order int, i int, j int, column1 string, column2 string, "
            f"relationship_type string, strength double, description string, {fields}",
        )
    return every


def strongest(every: DataFrame, limit: int | None) -> DataFrame:
    """``all_relationships``, strongest first, at most ``limit``."""
    ranked = every.orderBy(F.abs("strength").desc(), "kind_order", "i", "j")
    if limit is not None:
        ranked = ranked.limit(limit)
    return ranked.drop("kind_order", "i", "j")
