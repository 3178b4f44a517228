"""The rows behind each kind of chart, ready to be drawn.

Reduced charts (histogram, bar, box, heatmap, correlation, distribution, KDE, pair plot)
scan the table once or twice and return bins or summaries. Scatter and line return every
point.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.functions.columns import (
    categorical_columns,
    column,
    nan_as_null,
    numeric_columns,
    require,
    require_numeric,
)
from sondage.operators.quality import FENCE
from sondage.operators.relations import correlation_matrix
from sondage.operators.stats import column_stats
from sondage.session import checkpointed

HISTOGRAM_BINS = 30
GRID = 200
CELLS_PER_BANDWIDTH = 64
RAW_HEATMAP_ROWS = 100
# exp(-u^2 / 2) is 0 from here on.
REACH = 39.0


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column_name, value) of the non-missing values, as doubles."""
    clean = nan_as_null(df).select(*[column(c).cast("double").alias(c) for c in columns])
    return clean.unpivot([], [column(c) for c in columns], "column_name", "value").where(
        F.col("value").isNotNull()
    )


def _chosen(df: DataFrame, columns: Sequence[str] | None, first: int | None) -> list[str]:
    if columns:
        require_numeric(df, list(columns))
        return list(columns)
    return numeric_columns(df)[:first]


def _bin(value: Column, lo: Column, width: Column, bins: Column) -> Column:
    """Equal-width bin from 0; the last bin includes its upper edge."""
    at = F.least(F.floor((value - lo) / width), bins - 1)
    return F.when(value.isNotNull(), at).cast("int")


def _bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column_name, n, lo, hi); a single value gets half a unit on either side."""
    single = F.col("min") == F.col("max")
    return column_stats(df, columns, ["n", "min", "max"]).where(F.col("n") > 0).select(
        "column_name",
        "n",
        F.when(single, F.col("min") - 0.5).otherwise(F.col("min")).alias("lo"),
        F.when(single, F.col("max") + 0.5).otherwise(F.col("max")).alias("hi"),
    )


def histogram(
    df: DataFrame, columns: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Rows (column_name, bin, lo, hi, n), empty bins included; first 5 columns."""
    columns = _chosen(df, columns, 5)
    width = (F.col("hi") - F.col("lo")) / bins
    bounds = _bounds(df, columns).withColumn("width", width)
    counted = (
        _long(df, columns)
        .join(F.broadcast(bounds), "column_name")
        .groupBy(
            "column_name",
            _bin(F.col("value"), F.col("lo"), F.col("width"), F.lit(bins)).alias("bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    empty = bounds.drop("n").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return empty.join(counted, ["column_name", "bin"], "left").select(
        "column_name",
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def scatter(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (x, y) of two numeric columns, one per row where both are present."""
    columns = _chosen(df, columns, 2)
    if len(columns) < 2:
        raise ValueError("A scatter chart shows two numeric columns")
    x, y = (column(c).cast("double") for c in columns[:2])
    return nan_as_null(df).select(x.alias("x"), y.alias("y")).dropna()


def line(
    df: DataFrame, order_by: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows (idx, column_name, value): values against the row's position in the order.

    The sort is range-partitioned, equal keys spread by a hash of the row, and kept in
    the shared folder. A row's position is its position in its partition plus the rows
    of all partitions before; only the partition sizes are added up in one place.
    """
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    require(df, order_by)
    columns = _chosen(df, columns, 5)
    clean = nan_as_null(df)
    keys = [column(k).alias(f"_k{i}") for i, k in enumerate(order_by)]
    values = [column(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]
    slim = clean.select(*keys, *values)
    spread = F.xxhash64(*[F.col(c) for c in slim.columns])
    placed = checkpointed(
        slim.orderBy(*[f"_k{i}" for i in range(len(keys))], spread).select(
            F.monotonically_increasing_id().alias("_at"),
            *[f"_v{i}" for i in range(len(columns))],
        )
    )
    # The id holds the partition in its upper bits and the position in its lower 33.
    partition = F.shiftright("_at", 33)
    sizes = placed.groupBy(partition.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(
        "_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_start")
    )  # one row per partition
    numbered = placed.withColumn("_p", partition).join(F.broadcast(starts), "_p")
    idx = F.col("_start") + F.col("_at") - F.shiftleft("_p", 33)
    points = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"_v{i}").alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    return numbered.select(idx.alias("idx"), F.inline(points))


def bar(df: DataFrame, columns: Sequence[str] | None = None, first: int = 20) -> DataFrame:
    """Rows (category, mean): the categories with the highest means, ties by category."""
    if not columns:
        categories, numbers = categorical_columns(df), numeric_columns(df)
        if not categories or not numbers:
            raise ValueError("A bar chart shows a numeric column by a categorical one")
        columns = [categories[0], numbers[0]]
    if len(columns) < 2:
        raise ValueError("A bar chart shows two columns: a categorical and a numeric one")
    category, number = columns[:2]
    require(df, [category])
    require_numeric(df, [number])
    return (
        nan_as_null(df)
        .where(column(category).isNotNull())
        .groupBy(column(category).alias("category"))
        .agg(F.avg(column(number).cast("double")).alias("mean"))
        .orderBy(F.desc_nulls_last("mean"), "category")
        .limit(first)
    )


def box(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (column_name, q1, median, q3, whisker_lo, whisker_hi, fliers).

    A whisker ends at the most extreme value within 1.5 times the quartile distance,
    but not inside the box; fliers counts the values beyond the whiskers.
    """
    columns = _chosen(df, columns, 5)
    reach = FENCE * (F.col("q3") - F.col("q1"))
    quartiles = (
        column_stats(df, columns, ["n"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
        .where(F.col("n") > 0)
        .withColumn("_from", F.col("q1") - reach)
        .withColumn("_to", F.col("q3") + reach)
    )
    value = F.col("value")
    spread = (
        _long(df, columns)
        .join(F.broadcast(quartiles), "column_name")
        .groupBy("column_name", "q1", "median", "q3")
        .agg(
            F.min(F.when(value >= F.col("_from"), value)).alias("lowest"),
            F.max(F.when(value <= F.col("_to"), value)).alias("highest"),
            F.count_if((value < F.col("_from")) | (value > F.col("_to"))).alias("fliers"),
        )
    )
    return spread.select(
        "column_name", "q1", "median", "q3",
        F.least("lowest", "q1").alias("whisker_lo"),
        F.greatest("highest", "q3").alias("whisker_hi"),
        "fliers",
    )


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (column1, column2, value): the correlation matrix to 2 dp."""
    columns = _chosen(df, columns, None)
    if len(columns) < 2:
        raise ValueError("Correlations are between two numeric columns or more")
    return correlation_matrix(df, columns).select(
        "column1", "column2", (F.round("correlation", 2) + F.lit(0.0)).alias("value")
    )


def heatmap(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_by: str | None = None,
    values: str = "correlation",
    rows: int = RAW_HEATMAP_ROWS,
) -> DataFrame:
    """The correlation matrix, or with ``values="raw"`` the values of the first ``rows``.

    Both come as rows (column1, column2, value); for raw values column1 is the row's
    position by ``order_by`` (by all shown columns if not given).
    """
    if values not in ("correlation", "raw"):
        raise ValueError(f"A heatmap shows correlation or raw values, not {values}")
    columns = _chosen(df, columns, None)
    if not columns:
        raise ValueError("A heatmap shows numeric columns, of which there are none")
    if values == "correlation":
        return correlation(df, columns) if len(columns) > 1 else _constant_or_one(df, columns[0])
    order = [order_by] if order_by else columns
    by = [column(c) for c in order]
    at = F.row_number().over(W.orderBy(*by)) - 1  # of the rows shown
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column2"), column(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    shown = nan_as_null(df).select(*[column(c) for c in dict.fromkeys([*order, *columns])])
    numbered = shown.orderBy(*by).limit(rows).withColumn("_at", at.cast("string"))
    return numbered.select(F.col("_at").alias("column1"), F.inline(cells))


def _constant_or_one(df: DataFrame, name: str) -> DataFrame:
    spread = F.var_pop(column(name).cast("double"))
    return nan_as_null(df).agg(F.when(spread > 0, 1.0).alias("value")).select(
        F.lit(name).alias("column1"), F.lit(name).alias("column2"), "value"
    )


def auto_bins(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column_name, n, lo, hi, bins): bin width by the narrower of the
    Freedman-Diaconis and Sturges rules, Sturges alone if the quartiles coincide."""
    stats = column_stats(df, columns, ["n", "min", "max"], {"q1": 0.25, "q3": 0.75}).where(
        F.col("n") > 0
    )
    n = F.col("n").cast("double")
    single = F.col("min") == F.col("max")
    reach = F.col("max") - F.col("min")
    sturges = reach / (F.log2(n) + 1.0)
    freedman = 2.0 * (F.col("q3") - F.col("q1")) / F.cbrt(n)
    width = F.when(freedman > 0, F.least(freedman, sturges)).otherwise(sturges)
    return stats.select(
        "column_name",
        "n",
        F.when(single, F.col("min") - 0.5).otherwise(F.col("min")).alias("lo"),
        F.when(single, F.col("max") + 0.5).otherwise(F.col("max")).alias("hi"),
        F.when(single, 1).otherwise(F.ceil(F.try_divide(reach, width))).cast("bigint").alias("bins"),
    )


def distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (column_name, bins, bin, lo, hi, n): a histogram with automatic bins, first 3
    columns. ``bins`` is their number; bins without a value have no row, for an extreme
    value can make any number of them."""
    columns = _chosen(df, columns, 3)
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    rules = auto_bins(df, columns).drop("n").withColumn("width", width)
    at = F.least(
        F.floor((F.col("value") - F.col("lo")) / F.col("width")).cast("bigint"), F.col("bins") - 1
    )
    return (
        _long(df, columns)
        .join(F.broadcast(rules), "column_name")
        .groupBy("column_name", "bins", at.alias("bin"), F.col("lo").alias("_lo"), "width")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "column_name",
            "bins",
            "bin",
            (F.col("_lo") + F.col("bin") * F.col("width")).alias("lo"),
            (F.col("_lo") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
            "n",
        )
    )


def density(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exact: bool = False,
    grid: int = GRID,
) -> DataFrame:
    """Rows (column_name, point, x, density): Gaussian kernel density on ``grid`` points
    from minimum to maximum, bandwidth by Scott's rule; first 3 columns.

    Values are first counted in cells of 1/64 bandwidth, each represented by its mean,
    which changes a density by less than 1e-4 of its peak; with ``exact`` the cells are
    the distinct values themselves. A cell meets the grid points at which its kernel is
    not 0 in double precision. Constant columns have no density.
    """
    columns = _chosen(df, columns, 3)
    spread = column_stats(df, columns, ["n", "min", "max", "std"]).where(F.col("std") > 0)
    spread = spread.withColumn("h", F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    value = F.col("value")
    if exact:
        cell = value
    else:
        cell = F.floor((value - F.col("min")) / (F.col("h") / CELLS_PER_BANDWIDTH))
    counted = (
        _long(df, columns)
        .join(F.broadcast(spread.select("column_name", "min", "h")), "column_name")
        .groupBy("column_name", cell.alias("cell"))
        .agg(F.count(F.lit(1)).alias("weight"), F.avg("value").alias("centre"))
    )
    step = (F.col("max") - F.col("min")) / (grid - 1)
    x = F.col("min") + F.col("point") * F.col("step")
    u = (F.col("x") - F.col("centre")) / F.col("h")
    total = F.sum(F.col("weight") * F.exp(-u * u / 2.0))
    spread = spread.withColumn("step", step)
    middle = F.col("centre") - F.col("min")
    first = F.greatest(F.floor((middle - REACH * F.col("h")) / F.col("step")), F.lit(0))
    last = F.least(F.ceil((middle + REACH * F.col("h")) / F.col("step")), F.lit(grid - 1))
    sums = (
        counted.join(F.broadcast(spread), "column_name")
        .withColumn("point", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        .withColumn("x", x)
        .groupBy("column_name", "point")
        .agg(total.alias("total"))
    )
    every = spread.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    return (
        every.withColumn("x", x)
        .join(F.broadcast(sums), ["column_name", "point"], "left")
        .select(
            "column_name",
            "point",
            "x",
            (
                F.coalesce("total", F.lit(0.0))
                / (F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
            ).alias("density"),
        )
    )


def pairplot(
    df: DataFrame, columns: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Rows (column1, column2, bx, by, n): points of every pair of the first 4 columns,
    counted on a grid. ``density`` of these columns gives the diagonal, ``scatter`` the
    single points."""
    columns = _chosen(df, columns, 4)
    if len(columns) < 2:
        raise ValueError("A pair plot shows two numeric columns or more")
    bounds = _bounds(df, columns)
    edges = F.struct(
        *[
            F.max(F.when(F.col("column_name") == c, F.struct("lo", "hi"))).alias(f"_e{i}")
            for i, c in enumerate(columns)
        ]
    )
    # One row, read as a scalar subquery: no join.
    edge = bounds.agg(edges.alias("edges")).scalar()
    clean = nan_as_null(df).select(
        *[column(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]
    )
    binned = clean.select(
        *[
            _bin(
                F.col(f"_v{i}"),
                edge[f"_e{i}"]["lo"],
                (edge[f"_e{i}"]["hi"] - edge[f"_e{i}"]["lo"]) / bins,
                F.lit(bins),
            ).alias(f"_b{i}")
            for i in range(len(columns))
        ]
    )
    # Few bins per column: first count the points that share all of them.
    together = binned.groupBy(*binned.columns).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.array(
        *[
            F.struct(
                F.lit(columns[i]).alias("column1"),
                F.lit(columns[j]).alias("column2"),
                F.col(f"_b{i}").alias("bx"),
                F.col(f"_b{j}").alias("by"),
            )
            for i in range(len(columns))
            for j in range(i + 1, len(columns))
        ]
    )
    return (
        together.select("_n", F.inline(pairs))
        .where(F.col("bx").isNotNull() & F.col("by").isNotNull())
        .groupBy("column1", "column2", "bx", "by")
        .agg(F.sum("_n").alias("n"))
    )


CHARTS = {
    "histogram": histogram,
    "scatter": scatter,
    "line": line,
    "bar": bar,
    "box": box,
    "heatmap": heatmap,
    "correlation": correlation,
    "distribution": distribution,
    "density": density,
    "pairplot": pairplot,
}


def chart_data(
    df: DataFrame, kind: str, columns: Sequence[str] | None = None, **options
) -> DataFrame:
    """The rows behind a chart of the given kind."""
    if kind not in CHARTS:
        raise ValueError(f"No such chart: {kind}")
    return CHARTS[kind](df, columns=columns, **options)
