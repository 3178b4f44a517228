"""Statistics of many columns at once, one output row per (group and) column.

Counts, means, deviations and extremes of all columns come from one aggregation. Modes
come from the counts of the distinct values, of the column's own type. Exact quantiles are
found by radix refinement, at every size, with no task ever holding a column or a group:

1. one pass counts the values by a prefix that keeps their order, sign and the logarithm
   in steps of 1/64, so the cell holding each wanted rank is known exactly, however the
   values are spread;
2. while one of those cells is large, a pass counts its values by 16 further bits of
   their place between the cell's least and greatest value;
3. one pass counts the distinct values of what is left, small by now, and picks the ranks.

A cell of one value needs no further pass. After a few refinements every cell is one.
"""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.functions.columns import column, in_slots, nan_as_null, require
from sondage.session import checkpointed

Aggregate = Callable[[Column], Column]

# Aggregations over more columns outgrow what the JVM compiles.
COLUMNS_PER_PASS = 10
# Steps of the first prefix in each doubling of a value, and parts of a cell that is refined.
OCTAVE_PARTS = 64
CELL_PARTS = 65_536
# A cell of so many rows is not refined further; its distinct values meet in one task.
CELL_ROWS = 100_000
JOIN_SALTS = 16

MOMENTS: dict[str, Aggregate] = {
    "n": F.count,
    "mean": F.avg,
    "std": F.stddev_samp,
    "variance": F.var_samp,
    "min": F.min,
    "max": F.max,
    "skewness": F.skewness,
    "kurtosis": F.kurtosis,
}


def column_stats(
    df: DataFrame,
    columns: Sequence[str],
    wanted: Sequence[str],
    quantiles: dict[str, float] | None = None,
    mode: bool = False,
    keys: Sequence[str] = (),
    base: DataFrame | None = None,
) -> DataFrame:
    """Rows (keys..., column_name, wanted..., quantiles..., mode), all over non-missing
    values as doubles. Undefined statistics are NULL. Without keys, ``base`` may hold rows
    (column_name, wanted...) found before, which are then not computed again.

    ``wanted`` names entries of MOMENTS, ``quantiles`` maps an output name to a
    probability (linear interpolation); rows with a NULL key are left out, ``mode`` adds
    the smallest most frequent value.
    """
    require(df, [*columns, *keys])
    quantiles = quantiles or {}
    clean = nan_as_null(df)
    for key in keys:
        clean = clean.where(column(key).isNotNull())
    # A column can be both key and measured, so measures get names of their own.
    named = {name: f"_v{i}" for i, name in enumerate(columns)}
    values = clean.select(
        *[column(k) for k in keys],
        *[column(c).cast("double").alias(v) for c, v in named.items()],
    )

    def described(part: Sequence[str]) -> DataFrame:
        rows = []
        for name in part:
            c = F.col(named[name])
            fields = [F.lit(columns.index(name)).alias("_id"), F.lit(name).alias("column_name")]
            fields += [MOMENTS[s](c).alias(s) for s in wanted]
            fields.append(F.count(c).alias("_total"))
            rows.append(F.struct(*fields))
        grouped = values.groupBy(*[column(k) for k in keys])
        return grouped.agg(F.array(*rows).alias("_rows")).select(
            *[column(k) for k in keys], F.inline("_rows")
        )

    if base is not None:
        names = F.array(*[F.lit(c) for c in columns])
        result = base.withColumn("_id", F.array_position(names, F.col("column_name")).cast("int") - 1)
    else:
        parts = [columns[i : i + COLUMNS_PER_PASS] for i in range(0, len(columns), COLUMNS_PER_PASS)]
        result = reduce(DataFrame.unionByName, map(described, parts))
    order = [*keys, "column_name", *wanted, *quantiles, *(["mode"] if mode else [])]
    if not (quantiles or mode):
        return result.select(*[column(c) for c in order])

    long = values.select(
        *[column(k) for k in keys],
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("_id"), F.col(v).alias("_v"))
                    for i, v in enumerate(named.values())
                ]
            )
        ),
    ).where(F.col("_v").isNotNull())
    on = [*keys, "_id"]
    extra = []
    if quantiles:
        extra.append(quantiles_by_counting(long, quantiles, on))
    if mode:
        extra.append(_modes(clean, named, on))
    # Groups without any value of a column have no row in ``extra``; keys are never NULL.
    for found in extra:
        result = result.join(found, on, "left")
    return result.select(*[column(c) for c in order])


def _modes(clean: DataFrame, named: dict[str, str], on: Sequence[str]) -> DataFrame:
    """The smallest of the most frequent values, compared in the column's own type:
    as doubles, large integers would fall together. One scan for columns of all types."""
    keys = [column(c) for c in on[:-1]]
    held = clean.select(*[column(n) for n in named], F.struct(*keys).alias("_keys")) if keys else clean
    kinds = [clean.schema[n].dataType.simpleString() for n in named]
    rows, slots = in_slots(held, [column(n) for n in named], kinds, *(["_keys"] if keys else []))
    if keys:
        rows = rows.select(F.col("_keys.*"), "_id", *slots)
    known = reduce(Column.__or__, [F.col(s).isNotNull() for s in slots])
    counts = rows.where(known).groupBy(*keys, "_id", *slots).agg(F.count(F.lit(1)).alias("_n"))
    # Of equal counts the smallest value: the first by (-count, value).
    best = F.min(F.struct((-F.col("_n")).alias("n"), *slots))
    mode = F.coalesce(*[best[s].cast("double") for s in slots])
    return counts.groupBy(*keys, "_id").agg(mode.alias("mode"))


def _positions(quantiles: dict[str, float]) -> dict[str, Column]:
    """Zero-based, possibly fractional rank of each quantile among _total values."""
    return {q: F.lit(p) * (F.col("_total") - 1) for q, p in quantiles.items()}


def _interpolated(position: Column, low: Column, high: Column) -> Column:
    """Linear interpolation between the values at the ranks around ``position``."""
    below = F.floor(position)
    weighted = (below + 1 - position) * low + (position - below) * high
    return F.when(low == high, low).otherwise(weighted)


# Prefixes of finite values other than 0 are above 0 from 2^-1100 on.
LEAST_OCTAVE, INFINITE = -1100, 1 << 20


def _prefix(v: Column) -> Column:
    """A whole number that never falls as ``v`` grows: 0 for 0, else by logarithm and sign."""
    size = F.floor(F.log2(F.abs(v)) * OCTAVE_PARTS) - LEAST_OCTAVE * OCTAVE_PARTS
    infinite = F.abs(v) == float("inf")
    return (F.signum(v) * F.when(v == 0, 0).when(infinite, INFINITE).otherwise(size)).cast("int")


def _ends(prefix: Column) -> tuple[Column, Column]:
    """About the least and greatest value with the prefix; equal where it has only one."""
    size, sign = F.abs(prefix), F.signum(prefix.cast("double"))
    near, far = (F.pow(F.lit(2.0), (size + n) / OCTAVE_PARTS + LEAST_OCTAVE) for n in (0, 1))
    one = F.when(prefix == 0, 0.0).when(size == INFINITE, sign * float("inf"))
    return tuple(
        F.coalesce(one, F.when(sign > 0, low).otherwise(-high)) for low, high in ((near, far), (far, near))
    )


def _part(v: Column, first: Column, last: Column) -> Column:
    """The place of ``v`` in its cell. Subtraction, division and floor keep order; between
    values that occur, the cell's ends fall into different parts."""
    share = F.floor((v - first) / (last - first) * CELL_PARTS)
    return F.greatest(F.lit(0), F.least(share, F.lit(CELL_PARTS - 1))).cast("int")


def quantiles_by_counting(
    long: DataFrame, quantiles: dict[str, float], on: Sequence[str]
) -> DataFrame:
    """Exact quantiles of rows (on..., _v) by the passes above.

    ``on`` ends with the column's number; what comes before are group keys. The cells that
    hold a wanted rank, at most two per quantile, are joined on the key and a salt of the
    row, so that the rows of a hot group are spread over JOIN_SALTS tasks.
    """
    grouped = len(on) > 1
    group = [column(c) for c in on]
    salts = F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))
    by = [*on, "_spread"] if grouped else list(on)
    if grouped:
        long = long.withColumn("_spread", F.pmod(F.monotonically_increasing_id(), F.lit(JOIN_SALTS)).cast("int"))

    def side(cells: DataFrame) -> DataFrame:
        # Without groups: at most two rows per column and quantile.
        return cells.withColumn("_spread", F.explode(salts)) if grouped else F.broadcast(cells)

    v = F.col("_v")
    n = F.count(F.lit(1)).alias("_n")
    positions = _positions(quantiles)
    ranks = F.array_distinct(
        F.array(*[f(p).cast("bigint") for p in positions.values() for f in (F.floor, F.ceil)])
    )

    def holding(cells: DataFrame, within: Sequence[Column]) -> DataFrame:
        """The cells that hold some of ``_ranks``. What a pass finds is kept: later ones
        must see the same cells even if an executor is lost in between."""
        upto = W.partitionBy(*within).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
        before = F.col("_base") + F.sum("_n").over(upto) - F.col("_n")
        inside = F.filter(
            "_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))
        )
        found = cells.withColumn("_before", before).withColumn("_ranks", inside).where(F.size("_ranks") > 0)
        return checkpointed(found.select(*group, "_cell", "_first", "_last", "_n", "_before", "_total", "_ranks"))

    def in_cells(cells: DataFrame, refined: bool) -> DataFrame:
        """The rows of the cells, which are known by their prefix or by their ends."""
        ends = cells.select(*group, "_cell", "_first", "_last")
        if refined:
            return long.join(side(ends), by).where(v.between(F.col("_first"), F.col("_last")))
        return long.withColumn("_cell", _prefix(v).cast("double")).join(side(ends), [*by, "_cell"])

    def with_cell(counts: DataFrame, cells: DataFrame) -> DataFrame:
        """Counts within cells, with what else is known of the cell."""
        known = cells.select(*group, "_cell", F.col("_before").alias("_base"), "_total", "_ranks")
        return counts.join(known if grouped else F.broadcast(known), [*on, "_cell"])

    # At most 2 * 2,100 * OCTAVE_PARTS rows per group and column, few of which occur.
    counts = long.groupBy(*group, _prefix(v).alias("_prefix")).agg(n)
    first, last = _ends(F.col("_prefix"))
    counts = counts.select(
        *group, F.col("_prefix").cast("double").alias("_cell"), first.alias("_first"), last.alias("_last"), "_n",
        F.sum("_n").over(W.partitionBy(*group)).alias("_total"), F.lit(0).cast("bigint").alias("_base"),
    )
    cells = holding(counts.withColumn("_ranks", ranks), group)
    found, refined = [], False
    while True:
        single = F.col("_first") == F.col("_last")
        found.append(
            cells.where(single).select(
                *group, "_total", F.explode("_ranks").alias("_rank"), F.col("_first").alias("_v")
            )
        )
        cells = cells.where(~single)
        most = cells.agg(F.max("_n")).first()[0]
        if most is None:
            break
        kept = in_cells(cells, refined)
        if most <= CELL_ROWS:
            distinct = with_cell(kept.groupBy(*group, "_cell", "_v").agg(n), cells)
            upto = F.col("_base") + F.sum("_n").over(W.partitionBy(*group, "_cell").orderBy("_v"))
            mine = F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")))
            picked = distinct.withColumn("_upto", upto)
            found.append(picked.select(*group, "_total", F.explode(mine).alias("_rank"), "_v"))
            break
        part = _part(v, F.col("_first"), F.col("_last")).alias("_part")
        counts = kept.groupBy(*group, "_cell", part).agg(n, F.min("_v").alias("_first"), F.max("_v").alias("_last"))
        inner = with_cell(counts, cells).withColumn("_outer", F.col("_cell")).withColumn("_cell", F.col("_first"))
        cells, refined = holding(inner, [*group, F.col("_outer")]), True

    picked = (
        reduce(DataFrame.unionByName, found)
        .groupBy(*group)
        .agg(
            F.any_value("_total").alias("_total"),
            F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"),
        )
    )

    def at(rank: Column) -> Column:
        return F.element_at("_at", rank.cast("bigint"))

    return picked.select(
        *group,
        *[
            _interpolated(p, at(F.floor(p)), at(F.ceil(p))).alias(q)
            for q, p in positions.items()
        ],
    )
