"""The D'Agostino-Pearson normality test from n, skewness and excess kurtosis.

D'Agostino, Belanger, D'Agostino (1990), "A suggestion for using powerful and
informative tests of normality"; Anscombe, Glynn (1983) for the kurtosis part.
Everything is arithmetic over one already aggregated row per column, in steps: one long
expression would repeat its parts many times over.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The test is not defined for fewer values.
FEWEST = 8


def with_k_squared(df: DataFrame) -> DataFrame:
    """Add skewness_z, kurtosis_z and k2 to rows with n, skewness and kurtosis.

    They are NULL below 8 values and for a constant column, whose skewness and kurtosis
    are NULL. A skewness of exactly 0 counts as y = 1.
    """
    n, y, w, a, d = (F.col(f"_{c}") for c in ("n", "y", "w", "a", "d"))
    steps = [
        {"_n": F.when(F.col("n") >= FEWEST, F.col("n")).cast("double")},
        {
            "_y": F.col("skewness") * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))),
            # What the expected kurtosis exceeds 3 by, its 3 cancelled beforehand.
            "_e": 36.0 * (n * n * n - 5.0 * n * n - 19.0 * n + 35.0)
            / ((n - 2) * (n + 5) * (n + 7) * (n + 9)),
            "_x": (F.col("kurtosis") + 3.0 - 3.0 * (n - 1) / (n + 1))
            / F.sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))),
            "_s": 6.0 * (n * n - 5.0 * n + 2.0) / ((n + 7) * (n + 9))
            * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))),
        },
        {
            "_y": F.when(y == 0, 1.0).otherwise(y),
            # sqrt(2 (e + 2)) - 2
            "_w": 2.0 * F.col("_e") / (F.sqrt(4.0 + 2.0 * F.col("_e")) + 2.0),
            "_a": 6.0
            + 8.0 / F.col("_s") * (2.0 / F.col("_s") + F.sqrt(1.0 + 4.0 / (F.col("_s") * F.col("_s")))),
        },
        {
            "_y": y / F.sqrt(2.0 / w),
            "_d": 1.0 + F.col("_x") * F.sqrt(2.0 / (a - 4.0)),
        },
        {
            "skewness_z": F.asinh(y) / F.sqrt(0.5 * F.log1p(w)),
            "kurtosis_z": (
                1.0 - 2.0 / (9.0 * a)
                - F.signum(d) * F.cbrt(F.try_divide(1.0 - 2.0 / a, F.abs(d)))
            )
            / F.sqrt(2.0 / (9.0 * a)),
        },
        {
            "k2": F.col("skewness_z") * F.col("skewness_z")
            + F.col("kurtosis_z") * F.col("kurtosis_z")
        },
    ]
    result = df
    for step in steps:
        result = result.withColumns(step)
    return result.drop(*[c for c in result.columns if c.startswith("_")])


def k_squared_p(k2: Column) -> Column:
    """Upper tail of chi-square with two degrees of freedom."""
    return F.exp(-k2 / 2.0)
