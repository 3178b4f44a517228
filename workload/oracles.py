"""The SQL each query is checked against, for DuckDB over the same tables.

Statistics are spelled out where the two engines define them differently. Tail
probabilities, which SQL lacks, are integrals summed by the midpoint rule, independent
of the series the package uses.
"""

from dataclasses import dataclass
from itertools import combinations


@dataclass
class Frame:
    """A table or subquery with its columns as (name, type) in order."""

    sql: str
    columns: list[tuple[str, str]]

    @property
    def names(self):
        return [c for c, _ in self.columns]

    @property
    def numeric(self):
        return [c for c, t in self.columns if t in ("int", "bigint", "double")]

    @property
    def text(self):
        return [c for c, t in self.columns if t == "string"]

    def only(self, *names):
        return Frame(self.sql, [(c, t) for c, t in self.columns if c in names])


def union(parts):
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


def rnd(expression, digits=4):
    return f"(round(({expression})::DOUBLE, {digits}) + 0.0)"


def pct(part, whole):
    return f"round(({part}) / nullif(({whole})::DOUBLE, 0) * 100.0, 2)"


CUSTOMER = Frame("customer", [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
    ("c_acctbal", "double"), ("c_mktsegment", "string")])
PART = Frame("part", [
    ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
    ("p_size", "int"), ("p_retailprice", "double")])
ORDERS = Frame("orders", [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
    ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")])
LINEITEM = Frame("lineitem", [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
    ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
    ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
    ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")])
EVENTS = Frame("events", [
    ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
    ("event_type", "string"), ("value", "double"), ("props", "string")])
DOCUMENTS = Frame("documents", [
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
    ("n_chars", "bigint")])
PAGES = Frame("pages", [("page_id", "bigint"), ("url", "string"), ("html", "string")])
CONVERSATIONS = Frame("conversations", [
    ("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")])

GAPS = Frame(
    """(SELECT event_id, ts, user_id, event_type,
        CASE WHEN value < 25 THEN NULL ELSE value END AS value,
        nullif(props, '{"k": 0}') AS props FROM events)""",
    EVENTS.columns,
)
NET = Frame(
    "(SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)",
    [*LINEITEM.columns, ("net", "double")],
)
FLAGS = Frame(
    """(SELECT l_returnflag, l_linestatus,
        CASE WHEN l_quantity + CASE WHEN l_linestatus = 'O' THEN 20 ELSE 0 END > 35
             THEN 'big' ELSE 'small' END AS size_flag,
        l_quantity, l_extendedprice FROM lineitem)""",
    [("l_returnflag", "string"), ("l_linestatus", "string"), ("size_flag", "string"),
     ("l_quantity", "double"), ("l_extendedprice", "double")],
)


# --- one row per column ---------------------------------------------------------------


def per_column(f, columns, fields, where=""):
    """``fields`` is SQL with {c} for the column."""
    return union(
        f"SELECT '{c}' AS column_name, {fields.format(c=c, f=f.sql)} FROM {f.sql} {where}"
        for c in columns
    )


QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def quantiles(*names):
    return ", ".join(f"{rnd('quantile_cont({c}::DOUBLE, %s)' % QUANTILES[q])} AS {q}" for q in names)


def numeric_summary(f):
    return per_column(
        f, f.numeric,
        f"count({{c}}) AS n, {rnd('avg({c})')} AS mean, {rnd('stddev_samp({c})')} AS std, "
        f"{rnd('min({c})')} AS min, {quantiles('p25', 'p50', 'p75')}, {rnd('max({c})')} AS max",
    )


def shape(f):
    return f"SELECT count(*) AS n_rows, {len(f.columns)} AS n_columns FROM {f.sql}"


def unique(f, columns=None):
    return per_column(f, columns or f.text, "count(DISTINCT {c}) AS unique_values")


def top(f):
    return union(
        f"""SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, count(*) AS n,
            (row_number() OVER (ORDER BY count(*) DESC, sha256({c})))::INTEGER AS rank
            FROM {f.sql} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"""
        for c in f.text
    )


SKEW = "(skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)))"
KURT = "kurtosis_pop({c})"


def base_moments(f, columns=None):
    return per_column(
        f, columns or f.numeric,
        f"count({{c}}) AS n, {SKEW} AS g1, {KURT} AS g2, "
        "min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi",
    )


def chunk_profile(f):
    always = "count(DISTINCT {c}) AS unique_values, true AS estimate_close"
    some = "count(*) AS n_rows, count(*) - count({c}) AS n_missing"
    numbers = ", ".join(
        f"{rnd(e)} AS {n}" for n, e in [
            ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"), ("max", "max({c})"),
            ("skewness", SKEW), ("kurtosis", KURT)]
    )
    none = ", ".join(f"NULL::DOUBLE AS {n}" for n in ("mean", "std", "min", "max", "skewness", "kurtosis"))
    others = [c for c in f.names if c not in f.numeric]
    return union([
        per_column(f, f.numeric, f"{some}, count({{c}}) AS n, {numbers}, {always}"),
        per_column(f, others, f"{some}, 0::BIGINT AS n, {none}, {always}"),
    ])


def moments(f):
    return (
        f"SELECT column_name, n, {rnd('g1')} AS skewness, {rnd('g2')} AS kurtosis "
        f"FROM ({base_moments(f)})"
    )


def k_squared(base):
    """K^2 step by step from rows (column_name, n, g1, g2, ...)."""
    return f"""
    SELECT *, zs * zs + zk * zk AS k2raw FROM (
    SELECT *, (1 - 2 / (9 * a) - sign(d) * cbrt((1 - 2 / a) / abs(d))) / sqrt(2 / (9 * a)) AS zk,
        ln(y / alpha + sqrt((y / alpha) ^ 2 + 1)) / sqrt(0.5 * ln(w2)) AS zs FROM (
    SELECT *, 1 + x * sqrt(2 / (a - 4)) AS d, sqrt(2 / (w2 - 1)) AS alpha FROM (
    SELECT *, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS a,
        sqrt(2 * (beta2 - 1)) - 1 AS w2 FROM (
    SELECT *, (g2 + 3 - 3 * (m - 1) / (m + 1))
            / sqrt(24 * m * (m - 2) * (m - 3) / ((m + 1) ^ 2 * (m + 3) * (m + 5))) AS x,
        6 * (m * m - 5 * m + 2) / ((m + 7) * (m + 9))
            * sqrt(6 * (m + 3) * (m + 5) / (m * (m - 2) * (m - 3))) AS s,
        CASE WHEN g1 = 0 THEN 1 ELSE g1 * sqrt((m + 1) * (m + 3) / (6 * (m - 2))) END AS y,
        3 * (m * m + 27 * m - 70) * (m + 1) * (m + 3)
            / ((m - 2) * (m + 5) * (m + 7) * (m + 9)) AS beta2
    FROM (SELECT *, n::DOUBLE AS m FROM ({base}))))))"""


def normality(f, digits=2, columns=None):
    return (
        f"SELECT column_name, n, {rnd('k2raw', digits)} AS k2, "
        f"{rnd('exp(-k2raw / 2)', 6)} AS p_value, exp(-k2raw / 2) > 0.05 AS is_normal "
        f"FROM ({k_squared(base_moments(f, columns))})"
    )


def value_range(f):
    return (
        f"SELECT column_name, n, {rnd('lo')} AS min, {rnd('hi')} AS max, {rnd('hi - lo')} AS range "
        f"FROM ({base_moments(f)})"
    )


def percentiles(f):
    return per_column(f, f.numeric, f"count({{c}}) AS n, {quantiles(*QUANTILES)}")


def tests(f):
    return f"""SELECT k.column_name, k.n, {rnd('exp(-k2raw / 2)', 4)} AS normality_p_value,
        exp(-k2raw / 2) > 0.05 AS is_normal, {rnd('g1')} AS skewness, {rnd('g2')} AS kurtosis,
        {rnd('lo')} AS min, {rnd('hi')} AS max, {rnd('hi - lo')} AS range, p25, p50, p75, p95
        FROM ({k_squared(base_moments(f))}) k JOIN ({percentiles(f)}) q USING (column_name)"""


def dists(f):
    mode = (
        "(SELECT {c}::DOUBLE FROM {f} WHERE {c} IS NOT NULL "
        "GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    )
    return per_column(
        f, f.numeric,
        f"{rnd('avg({c})')} AS mean, {rnd('quantile_cont({c}::DOUBLE, 0.5)')} AS median, "
        f"{mode} AS mode, {rnd('stddev_samp({c})')} AS std, {rnd('var_samp({c})')} AS variance, "
        f"{rnd('stddev_samp({c}) / nullif(avg({c}), 0)')} AS cv",
    )


def group_stats(f, key, columns=None):
    return union(
        f"""SELECT {key} AS group_value, '{c}' AS column_name, {rnd(f'avg({c})')} AS mean,
        {rnd(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median, {rnd(f'stddev_samp({c})')} AS std,
        {rnd(f'min({c})')} AS min, {rnd(f'max({c})')} AS max
        FROM {f.sql} WHERE {key} IS NOT NULL GROUP BY {key}"""
        for c in columns or f.numeric
    )


def group_sizes(f, key):
    return (
        f"SELECT {key} AS group_value, count(*) AS n FROM {f.sql} "
        f"WHERE {key} IS NOT NULL GROUP BY {key}"
    )


def group_count(f, key):
    return f"SELECT '{key}' AS group_column, count(DISTINCT {key}) AS n_groups FROM {f.sql}"


# --- quality ----------------------------------------------------------------------------


def nulls(f):
    return per_column(
        f, f.names, "count(*) AS n_rows, (count(*) - count({c}))::BIGINT AS missing"
    )


def missing(f):
    return (
        f"SELECT column_name, missing, {pct('missing', 'n_rows')} AS missing_pct "
        f"FROM ({nulls(f)}) WHERE missing > 0"
    )


def missing_total(f):
    return f"""SELECT sum(n_rows)::BIGINT AS total_cells, sum(missing)::BIGINT AS missing_cells,
        {pct('sum(missing)', 'sum(n_rows)')} AS missing_pct FROM ({nulls(f)})"""


def duplicates(f, columns=None):
    keys = ", ".join(columns or f.names)
    return f"""SELECT coalesce(sum(n), 0)::BIGINT AS n_rows,
        coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows,
        {pct('coalesce(sum(n) FILTER (n > 1), 0)', 'sum(n)')} AS duplicate_pct
        FROM (SELECT {keys}, count(*) AS n FROM {f.sql} GROUP BY {keys})"""


ROLES = {"bigint": "numeric", "int": "numeric", "double": "numeric", "string": "categorical",
         "timestamp_ntz": "datetime"}


def column_types(f):
    return union(
        f"""SELECT '{c}' AS column_name, '{t}' AS data_type, '{ROLES[t]}' AS role,
        count({c}) AS present FROM {f.sql}"""
        for c, t in f.columns
    )


WIDTHS = {"bigint": 8, "int": 4, "double": 8, "timestamp_ntz": 8}


def data_bytes(f):
    return union(
        f"""SELECT '{c}' AS column_name, coalesce(sum({f'strlen({c})' if t == 'string'
            else f'CASE WHEN {c} IS NOT NULL THEN {WIDTHS[t]} END'}), 0)::BIGINT AS bytes
            FROM {f.sql}"""
        for c, t in f.columns
    )


def quality_report(f):
    kinds = {t: sum(1 for _, u in f.columns if u == t) for _, t in f.columns}
    total, double = missing_total(f), duplicates(f)
    cells = [
        ("shape", "'rows'", "count(*)", f.sql),
        ("shape", "'columns'", str(len(f.columns)), "(SELECT 1)"),
        *[("missing_values", f"'{k}'", k, f"({total})")
          for k in ("total_cells", "missing_cells", "missing_pct")],
        ("missing_by_column", "column_name", "missing", f"({missing(f)})"),
        *[("duplicates", f"'{k}'", k, f"({double})") for k in ("duplicate_rows", "duplicate_pct")],
        *[("data_types", f"'{t}'", str(n), "(SELECT 1)") for t, n in kinds.items()],
        ("size", "'data_mb'", "round(sum(bytes) / 1048576.0, 2)", f"({data_bytes(f)})"),
    ]
    return union(
        f"SELECT '{s}' AS section, {k} AS key, ({v})::DOUBLE AS value FROM {t}"
        for s, k, v, t in cells
    )


def score(f):
    return f"""SELECT *, CASE WHEN score >= 90 THEN 'good' WHEN score >= 70 THEN 'fair'
        ELSE 'poor' END AS band FROM (SELECT missing_pct, duplicate_pct,
        round(greatest(100 - least(missing_pct, 30) - least(duplicate_pct * 0.5, 20), 0), 2) AS score
        FROM (SELECT missing_pct FROM ({missing_total(f)})),
             (SELECT duplicate_pct FROM ({duplicates(f)})))"""


def iqr_bounds(f, c):
    return f"""SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, n FROM (
        SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3,
        count({c}) AS n FROM {f.sql})"""


def outliers_iqr(f, columns):
    return union(
        f"""SELECT '{c}' AS column_name, {rnd('any_value(lower)')} AS lower,
        {rnd('any_value(upper)')} AS upper,
        count(*) FILTER ({c} < lower OR {c} > upper) AS outlier_count,
        {rnd(pct(f'count(*) FILTER ({c} < lower OR {c} > upper)', 'any_value(n)'))} AS outlier_pct
        FROM {f.sql}, ({iqr_bounds(f, c)})"""
        for c in columns
    )


def outliers_z(f, columns):
    return union(
        f"""SELECT '{c}' AS column_name, count(*) FILTER (abs(({c} - m) / s) > 3) AS outlier_count,
        {pct(f'count(*) FILTER (abs(({c} - m) / s) > 3)', 'any_value(n)')} AS outlier_pct
        FROM {f.sql}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s, count({c}) AS n FROM {f.sql})"""
        for c in columns
    )


# --- relations ----------------------------------------------------------------------------


def pairs_r(f):
    """Rows (i, j, column1, column2, r, n); rounding must not carry r past 1."""
    names = f.numeric
    pairs = union(
        f"""SELECT {names.index(a)} AS i, {names.index(b)} AS j, '{a}' AS column1,
        '{b}' AS column2, covar_pop({a}, {b}) / nullif(
            sqrt(var_pop(CASE WHEN {b} IS NOT NULL THEN {a} END))
            * sqrt(var_pop(CASE WHEN {a} IS NOT NULL THEN {b} END)), 0) AS r,
        count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {f.sql}"""
        for a, b in combinations(names, 2)
    )
    return f"""SELECT * REPLACE (CASE WHEN abs(r) > 1 THEN sign(r)::DOUBLE ELSE r END AS r)
        FROM ({pairs})"""


def matrix(f, digits=4, value="correlation"):
    ones = union(
        f"""SELECT '{c}' AS column1, '{c}' AS column2,
        CASE WHEN var_pop({c}) > 0 THEN 1.0::DOUBLE END AS {value} FROM {f.sql}"""
        for c in f.numeric
    )
    r = rnd("r") if digits == 4 else f"(round({rnd('r')}, {digits}) + 0.0)"
    return f"""SELECT column1, column2, {r} AS {value} FROM ({pairs_r(f)})
        UNION ALL SELECT column2, column1, {r} FROM ({pairs_r(f)}) UNION ALL {ones}"""


def strong(f):
    return (
        f"SELECT column1, column2, {rnd('r')} AS correlation FROM ({pairs_r(f)}) WHERE abs(r) >= 0.7"
    )


LABEL = """((CASE WHEN r > 0 THEN 'positive_' ELSE 'negative_' END) || CASE WHEN abs(r) >= 0.9
    THEN 'very_strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate'
    ELSE 'weak' END)"""


def integral(expression, lo, hi, steps):
    """Midpoint rule; ``expression`` holds {u}. Sums with lists, so that it is one expression."""
    u = f"(({lo}) + (i + 0.5) * (({hi}) - ({lo})) / {steps})"
    return (
        f"((({hi}) - ({lo})) / {steps} * "
        f"list_sum(list_transform(range(0, {steps}), lambda i: {expression.format(u=u)})))"
    )


# Two-sided: the density of r under independence, r = sin(u).
PEARSON_P = (
    "(2 * exp(lgamma((n - 1) / 2.0) - lgamma(0.5) - lgamma((n - 2) / 2.0)) * "
    + integral("exp((n - 3) * ln(greatest(cos({u}), 1e-300)))", "asin(abs(r))",
        "least(pi() / 2, asin(abs(r)) + 40 / sqrt(n))", 20000)
    + ")"
)
# One minus the chi-square density below, with x = u^2.
CHI_P = (
    "(CASE WHEN chi <= 0 THEN 1.0 ELSE 1 - "
    + integral(
        "exp(ln(2.0) + (dof - 1) * ln({u}) - {u} * {u} / 2 - dof / 2.0 * ln(2.0) - lgamma(dof / 2.0))",
        "0.0", "sqrt(greatest(chi, 1e-12))", 20000,
    )
    + " END)"
)
# The beta density below z = (n - k) / ((n - k) + (k - 1) f), with z = sin(u)^2.
ANOVA_P = (
    "(CASE WHEN n <= k THEN NULL WHEN isinf(fstat) THEN 0.0 ELSE "
    + integral(
        "exp(ln(2.0) + (n - k - 1) * ln(sin({u})) + (k - 2) * ln(cos({u})) "
        "+ lgamma((n - 1) / 2.0) - lgamma((n - k) / 2.0) - lgamma((k - 1) / 2.0))",
        "greatest(0.0, asin(sqrt((n - k) / ((n - k) + (k - 1) * fstat))) - 40 / sqrt(n - k))",
        "asin(sqrt((n - k) / ((n - k) + (k - 1) * fstat)))", 20000,
    )
    + " END)"
)


def numeric_p(f):
    return f"SELECT *, {PEARSON_P} AS p FROM ({pairs_r(f)})"


def chi(f):
    """Rows (i, j, column1, column2, chi, dof, v, n) over the full table of every pair."""
    names = f.text

    def one(a, b):
        return f"""
        WITH o AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {f.sql}
                   WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
             r AS (SELECT a, sum(o)::DOUBLE AS r FROM o GROUP BY a),
             c AS (SELECT b, sum(o)::DOUBLE AS c FROM o GROUP BY b),
             t AS (SELECT (SELECT sum(o)::DOUBLE FROM o) AS n, (SELECT count(*) FROM r) AS nr,
                          (SELECT count(*) FROM c) AS nc),
             e AS (SELECT coalesce(o.o, 0) AS o, r.r * c.c / t.n AS e,
                          CASE WHEN (t.nr - 1) * (t.nc - 1) = 1 THEN 0.5 ELSE 0 END AS yates
                   FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN o ON o.a = r.a AND o.b = c.b)
        SELECT {names.index(a)} AS i, {names.index(b)} AS j, '{a}' AS column1, '{b}' AS column2,
            chi, (nr - 1) * (nc - 1) AS dof, sqrt(chi / (n * (least(nr, nc) - 1))) AS v, n
        FROM t, (SELECT sum(greatest(abs(o - e) - yates, 0) ^ 2 / e) AS chi FROM e)
        WHERE nr > 1 AND nc > 1"""

    return union(one(a, b) for a, b in combinations(names, 2))


def chi2(f):
    return f"""SELECT column1, column2, {rnd('chi')} AS chi_square, dof, {rnd('v')} AS cramers_v
        FROM ({chi(f)})"""


def chi2_p(f):
    return f"SELECT column1, column2, dof, {rnd(CHI_P, 6)} AS p_value FROM ({chi(f)})"


def variance(f):
    """Rows (i, j, column1, column2, fstat, eta, k, n)."""

    def one(x, c):
        return f"""
        WITH b AS (SELECT {x}::DOUBLE AS x, {c} AS c FROM {f.sql} WHERE {x} IS NOT NULL),
             w AS (SELECT avg(x) AS m, var_pop(x) * count(*) AS sst FROM b),
             g AS (SELECT c, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS s
                   FROM b WHERE c IS NOT NULL GROUP BY c),
             a AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n * m) / sum(n) AS m,
                          sum(s) AS ssw FROM g),
             q AS (SELECT any_value(a.k) AS k, any_value(a.n) AS n, any_value(a.ssw) AS ssw,
                          sum(g.n * (g.m - a.m) ^ 2) AS ssb, sum(g.n * (g.m - w.m) ^ 2) AS ssw_all,
                          any_value(w.sst) AS sst FROM g, a, w)
        SELECT {f.numeric.index(x)} AS i, {f.text.index(c)} AS j, '{x}' AS column1,
            '{c}' AS column2, CASE WHEN n = k THEN NULL
                WHEN ssw = 0 AND ssb > 0 THEN 'Infinity'::DOUBLE WHEN ssw = 0 THEN NULL
                ELSE (ssb / (k - 1)) / (ssw / (n - k)) END AS fstat,
            CASE WHEN sst > 0 THEN ssw_all / sst ELSE 0 END AS eta, k, n
        FROM q WHERE k >= 2"""

    return union(one(x, c) for x in f.numeric for c in f.text)


def anova(f):
    return f"""SELECT column1, column2, {rnd('fstat')} AS f_statistic, {rnd('eta')} AS eta_squared,
        k, n FROM ({variance(f)})"""


def anova_p(f):
    return f"SELECT column1, column2, {rnd(ANOVA_P, 6)} AS p_value FROM ({variance(f)})"


RELATION_METRICS = ["correlation", "cramers_v", "chi_square", "degrees_of_freedom", "eta_squared",
                    "f_statistic", "p_value", "significance"]


def relationships(f, threshold=0.7):
    """All relationships with ordering columns, strongest first."""

    def kind(order, source, where, type_, strength, description, **metrics):
        shown = ", ".join(
            f"{metrics.get(m, 'NULL')}::{'VARCHAR' if m == 'significance' else 'DOUBLE'} AS {m}"
            for m in RELATION_METRICS
        )
        return f"""SELECT {order} AS kind_order, i, j, column1, column2,
            {type_} AS relationship_type, {strength} AS strength, {description} AS description,
            {shown} FROM ({source}) WHERE {where}"""

    parts = []
    if len(f.numeric) > 1:
        parts.append(kind(
            0, numeric_p(f), f"abs(r) >= {threshold}", LABEL, rnd("r"),
            f"printf('%s and %s: %s, |r| = %.2f', column1, column2, {LABEL}, abs(r))",
            correlation=rnd("r"), p_value=rnd("p", 6),
            significance="CASE WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END"))
    if len(f.text) > 1:
        parts.append(kind(
            1, f"SELECT *, {CHI_P} AS p FROM ({chi(f)}) WHERE v >= 0.3", "p < 0.05",
            "'categorical_association'", rnd("v"),
            "printf('%s and %s depend on each other, V = %.2f', column1, column2, v)",
            cramers_v=rnd("v"), chi_square=rnd("chi"), degrees_of_freedom="dof",
            p_value=rnd("p", 6)))
    if f.numeric and f.text:
        parts.append(kind(
            2, f"SELECT *, {ANOVA_P} AS p FROM ({variance(f)}) WHERE eta >= 0.06", "p < 0.05",
            "'numeric_categorical'", rnd("eta"),
            "printf('%s varies with %s, η² = %.2f', column1, column2, eta)",
            eta_squared=rnd("eta"), f_statistic=rnd("fstat"), p_value=rnd("p", 6)))
    return f"SELECT * FROM ({union(parts)}) ORDER BY abs(strength) DESC, kind_order, i, j"


def relationship_insights(f, threshold=0.7):
    found = f"({relationships(f, threshold)})"
    rules = [
        ("none", "count(*) = 0", "'No relationship passed the thresholds'"),
        ("strong", "count(*) FILTER (abs(strength) >= 0.8) > 0",
         "count(*) FILTER (abs(strength) >= 0.8) || ' strong relationships: columns may be redundant'"),
        ("categorical", "count(*) FILTER (relationship_type = 'categorical_association') > 0",
         "count(*) FILTER (relationship_type = 'categorical_association') || "
         "' associations between categories'"),
        ("mixed", "count(*) FILTER (relationship_type = 'numeric_categorical') > 0",
         "count(*) FILTER (relationship_type = 'numeric_categorical') || "
         "' pairs in which a number differs by category'"),
    ]
    return union(finding(found, "insight", r, m, having=w) for r, w, m in rules)


# --- schema ---------------------------------------------------------------------------------


def schema_columns(f):
    def one(c, t):
        share = f"count(DISTINCT {c}) / nullif(count(*)::DOUBLE, 0)"
        if t in ("int", "bigint"):
            kind = f"CASE WHEN {share} > 0.95 THEN 'identifier' ELSE 'integer' END"
        elif t == "string":
            kind = f"""CASE WHEN count({c}) = 0 THEN 'text' WHEN {share} < 0.05 THEN 'categorical'
                WHEN avg(contains({c}, '@')::INT) > 0.8 THEN 'email'
                WHEN avg(contains({c}, 'http')::INT) > 0.8 THEN 'url' ELSE 'text' END"""
        else:
            names = {"double": "numeric", "timestamp_ntz": "datetime", "boolean": "boolean"}
            kind = f"'{names[t]}'"
        return f"""SELECT '{c}' AS column_name, '{t}' AS data_type,
            (count(*) - count({c}))::BIGINT AS null_count,
            {pct(f'count(*) - count({c})', 'count(*)')} AS null_pct,
            count(DISTINCT {c}) AS unique_count,
            {pct(f'count(DISTINCT {c})', 'count(*)')} AS unique_pct, {kind} AS inferred_type
            FROM {f.sql}"""

    return union(one(c, t) for c, t in f.columns)


def semantic_types(f):
    return f"SELECT column_name, inferred_type FROM ({schema_columns(f)})"


def numeric_constraints(f):
    return per_column(
        f, f.numeric,
        f"{rnd('min({c})')} AS min, {rnd('max({c})')} AS max, {rnd('avg({c})')} AS mean, "
        f"{rnd('quantile_cont({c}::DOUBLE, 0.5)')} AS median, {rnd('stddev_samp({c})')} AS std",
    )


def text_constraints(f):
    return per_column(
        f, f.text,
        "min(length({c}))::INTEGER AS min_length, max(length({c}))::INTEGER AS max_length, "
        f"{rnd('avg(length({c}))')} AS avg_length",
    )


def overview(f):
    return f"""SELECT (SELECT count(*) FROM {f.sql}) AS total_rows,
        {len(f.columns)} AS total_columns, score AS data_quality_score, band FROM ({score(f)})"""


def sample_values(f, key):
    return union(
        f"""SELECT '{c}' AS column_name, string_agg(v, '|' ORDER BY draw) AS sample_values FROM (
        SELECT {c}::VARCHAR AS v, md5({key}::VARCHAR || '|{c}:42') AS draw FROM {f.sql}
        WHERE {c} IS NOT NULL ORDER BY draw LIMIT 5)"""
        for c in f.names
    )


# --- findings ---------------------------------------------------------------------------------


def finding(source, kind, rule, message, where="true", subject="NULL::VARCHAR", having=None):
    tail = f"HAVING {having}" if having else f"WHERE {where}"
    return f"""SELECT '{kind}' AS kind, '{rule}' AS rule, {subject} AS subject,
        {message} AS message FROM {source} {tail}"""


def insights(f, tier="comprehensive"):
    parts = [finding(
        f"({shape(f)})", "insight", "size",
        "format('{:,}', n_rows) || ' rows in ' || n_columns || ' columns'")]
    for rule, n, use in [
        ("numeric_columns", len(f.numeric), "columns hold numbers"),
        ("categorical_columns", len(f.text), "columns hold categories"),
    ]:
        if n:
            parts.append(finding("(SELECT 1)", "insight", rule, f"'{n} {use}'"))
    if tier == "comprehensive" and len(f.numeric) > 1:
        parts.append(finding(
            f"({strong(f)})", "insight", "strong_correlations",
            "count(*) || ' pairs of columns correlate strongly'",
            having="count(*) > 0"))
    return union(parts)


def warnings(f):
    parts = [
        finding(f"({missing_total(f)})", "warning", "missing_values",
                "'Missing cells: ' || missing_pct || '%'", "missing_pct > 10"),
        finding(f"({duplicates(f)})", "warning", "duplicates",
                "'Repeated rows: ' || duplicate_rows || ' (' || duplicate_pct || '%)'",
                "duplicate_pct > 5"),
    ]
    if f.numeric:
        parts.append(finding(
            f"({per_column(f, f.numeric, 'stddev_samp({c}) AS std')})", "warning", "low_variance",
            "column_name || ' hardly varies'", "std < 0.01",
            "column_name"))
    return union(parts)


def recommendations(f, tier="comprehensive"):
    parts = []
    if tier == "comprehensive":
        parts.append(finding(
            f"({missing_total(f)})", "recommendation", "missing_values",
            "'Fill or drop the missing cells'", "missing_pct > 5"))
    if f.text:
        parts.append(finding(
            f"({per_column(f, f.text, 'count(DISTINCT {c}) / count(*)::DOUBLE AS share')})",
            "recommendation", "high_cardinality",
            "column_name || ' is mostly unique: encode it before use'", "share > 0.5", "column_name"))
    if tier != "descriptive" and f.numeric:
        parts.append(finding(
            f"({moments(f)})", "recommendation", "skewed",
            "column_name || ' is very skewed: a transformation may help'",
            "abs(skewness) > 2", "column_name"))
    return union(parts)


def schema_recommendations(f):
    many = "More than ten numeric columns: select or combine some"
    return union([
        finding(f"({missing_total(f)})", "recommendation", "missing_values",
                "missing_pct || '% of the cells are missing: fill or drop them'", "missing_pct > 30"),
        finding(f"({duplicates(f)})", "recommendation", "duplicates",
                "duplicate_pct || '% of the rows are repeated: remove the repetitions'",
                "duplicate_pct > 5"),
        finding("(SELECT 1)", "recommendation", "many_numeric_columns", f"'{many}'",
                str(len(f.numeric) > 10)),
    ])


# --- charts -----------------------------------------------------------------------------------


def bounds(f, c):
    return f"""SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END::DOUBLE
        AS lo, CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END::DOUBLE AS hi
        FROM {f.sql}"""


def histogram(f, columns, bins=30):
    return union(
        f"""WITH b AS (SELECT *, (hi - lo) / {bins} AS w FROM ({bounds(f, c)})),
        v AS (SELECT least(floor(({c} - lo) / w), {bins - 1})::INTEGER AS bin, count(*) AS n
              FROM {f.sql}, b WHERE {c} IS NOT NULL GROUP BY 1)
        SELECT '{c}' AS column_name, r.bin::INTEGER AS bin, {rnd('lo + r.bin * w')} AS lo,
            {rnd('lo + (r.bin + 1) * w')} AS hi, coalesce(n, 0)::BIGINT AS n
        FROM (SELECT unnest(range(0, {bins})) AS bin) r CROSS JOIN b LEFT JOIN v ON v.bin = r.bin"""
        for c in columns
    )


def box(f, columns):
    return union(
        f"""WITH q AS (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1,
            quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q3
            FROM {f.sql}),
        v AS (SELECT min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1))::DOUBLE AS lowest,
            max({c}) FILTER ({c} <= q3 + 1.5 * (q3 - q1))::DOUBLE AS highest,
            count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS fliers
            FROM {f.sql}, q)
        SELECT '{c}' AS column_name, {rnd('q1')} AS q1, {rnd('median')} AS median,
            {rnd('q3')} AS q3, {rnd('least(lowest, q1)')} AS whisker_lo,
            {rnd('greatest(highest, q3)')} AS whisker_hi, fliers FROM q, v"""
        for c in columns
    )


def distribution(f, columns):
    return union(
        f"""WITH s AS (SELECT count({c})::DOUBLE AS n, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi,
            quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) AS iqr
            FROM {f.sql}),
        w AS (SELECT *, (hi - lo) / (log2(n) + 1) AS sturges, 2 * iqr / cbrt(n) AS fd FROM s),
        b AS (SELECT lo, hi, ceil((hi - lo) / CASE WHEN fd > 0 THEN least(fd, sturges)
              ELSE sturges END)::BIGINT AS bins FROM w),
        x AS (SELECT *, (hi - lo) / bins AS width FROM b)
        SELECT '{c}' AS column_name, bins, bin, {rnd('lo + bin * width')} AS lo,
            {rnd('lo + (bin + 1) * width')} AS hi, count(*) AS n
        FROM (SELECT bins, lo, width, least(floor(({c} - lo) / width)::BIGINT, bins - 1) AS bin
              FROM {f.sql}, x WHERE {c} IS NOT NULL) GROUP BY bins, bin, lo, width"""
        for c in columns
    )


def density(f, columns, digits, exact):
    cell = "x" if exact else "floor((x - lo) / (h / 64))"
    return union(
        f"""WITH b AS (SELECT {c}::DOUBLE AS x FROM {f.sql} WHERE {c} IS NOT NULL),
        s AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi,
              stddev_samp(x) * count(*) ^ (-0.2) AS h FROM b),
        g AS (SELECT {cell} AS cell, count(*) AS w, avg(x) AS m FROM b, s GROUP BY 1),
        p AS (SELECT point, lo + point * ((hi - lo) / 199) AS pos, n, h
              FROM (SELECT unnest(range(0, 200)) AS point), s)
        SELECT '{c}' AS column_name, point::INTEGER AS point, {rnd('pos', digits)} AS x,
            {rnd('sum(w * exp(-((pos - m) / h) * ((pos - m) / h) / 2)) / (n * h * sqrt(2 * pi()))', digits)}
            AS density
        FROM g, p GROUP BY point, pos, n, h"""
        for c in columns
    )


def pairplot(f, columns, bins=30):
    def bin_of(c, b):
        return f"least(floor(({c} - {b}.lo) / (({b}.hi - {b}.lo) / {bins})), {bins - 1})::INTEGER"

    return union(
        f"""SELECT '{a}' AS column1, '{b}' AS column2, {bin_of(a, 'p')} AS bx,
        {bin_of(b, 'q')} AS by, count(*) AS n
        FROM {f.sql}, ({bounds(f, a)}) p, ({bounds(f, b)}) q
        WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2, 3, 4"""
        for a, b in combinations(columns, 2)
    )


# --- composite operations -----------------------------------------------------------------------


def facts(section, sql, items=(), numbers=(), texts=()):
    item = f"concat_ws(' / ', {', '.join(f'{i}::VARCHAR' for i in items)})" if items else "''"
    cells = [(c, rnd(c), "NULL") for c in numbers] + [(c, "NULL", f"{c}::VARCHAR") for c in texts]
    return union(
        f"""SELECT '{section}' AS section, {item} AS item, '{c}' AS key,
        {number}::DOUBLE AS number, {text}::VARCHAR AS text FROM ({sql})"""
        for c, number, text in cells
    )


def finding_facts(section, sql):
    return facts(section, sql, ("rule", "subject"), (), ("kind", "message"))


PCTS = ["p25", "p50", "p75", "p95"]


def analysis(f, tier, group_by=None, prefix=""):
    parts = [
        facts(f"{prefix}shape", shape(f), (), ["n_rows", "n_columns"]),
        facts(f"{prefix}column_types", column_types(f), ["column_name"], ["present"],
              ["data_type", "role"]),
        facts(f"{prefix}numeric_summary", numeric_summary(f), ["column_name"],
              ["n", "mean", "std", "min", "p25", "p50", "p75", "max"]),
        facts(f"{prefix}categorical_unique", unique(f), ["column_name"], ["unique_values"]),
        facts(f"{prefix}categorical_top", top(f), ["column_name", "value"], ["n", "rank"]),
    ]
    if tier != "descriptive":
        parts.append(facts(
            f"{prefix}statistical_tests", tests(f), ["column_name"],
            ["n", "normality_p_value", "skewness", "kurtosis", "min", "max", "range", *PCTS],
            ["is_normal"]))
    if tier == "comprehensive":
        parts += [
            facts(f"{prefix}data_quality", f"SELECT section AS s, * FROM ({quality_report(f)})",
                  ["s"], ["value"], ["key"]),
            facts(f"{prefix}correlation_matrix", matrix(f), ["column1", "column2"], ["correlation"]),
            facts(f"{prefix}strong_correlations", strong(f), ["column1", "column2"], ["correlation"]),
            facts(f"{prefix}distributions", dists(f), ["column_name"],
                  ["mean", "median", "mode", "std", "variance", "cv"]),
        ]
        if group_by:
            parts += [
                facts(f"{prefix}group_sizes", group_sizes(f, group_by), ["group_value"], ["n"]),
                facts(f"{prefix}group_count", group_count(f, group_by), (), ["n_groups"],
                      ["group_column"]),
                facts(f"{prefix}group_stats", group_stats(f, group_by),
                      ["column_name", "group_value"], ["mean", "median", "std", "min", "max"]),
            ]
    parts += [
        finding_facts(f"{prefix}insights", insights(f, tier)),
        finding_facts(f"{prefix}warnings", warnings(f)),
        finding_facts(f"{prefix}recommendations", recommendations(f, tier)),
    ]
    return union(parts)


def report_charts(f, prefix=""):
    return union([
        facts(f"{prefix}correlation", matrix(f, 2, "value"), ["column1", "column2"], ["value"]),
        facts(f"{prefix}distribution", distribution(f, f.numeric[:3]), ["column_name"],
              ["bins", "bin", "lo", "hi", "n"]),
        facts(f"{prefix}box", box(f, f.numeric[:5]), ["column_name"],
              ["q1", "median", "q3", "whisker_lo", "whisker_hi", "fliers"]),
    ])


def report_sections(f, key):
    samples = f"SELECT column_name, replace(sample_values, '|', ', ') AS sample_values FROM ({sample_values(f, key)})"
    found = relationships(f)
    return union([
        facts("schema.overview", overview(f), (),
              ["total_rows", "total_columns", "data_quality_score"], ["band"]),
        facts("schema.columns", schema_columns(f), ["column_name"],
              ["null_count", "null_pct", "unique_count", "unique_pct"],
              ["data_type", "inferred_type"]),
        facts("schema.numeric_constraints", numeric_constraints(f), ["column_name"],
              ["min", "max", "mean", "median", "std"]),
        facts("schema.text_constraints", text_constraints(f), ["column_name"],
              ["min_length", "max_length", "avg_length"]),
        facts("schema.samples", samples, ["column_name"], (), ["sample_values"]),
        finding_facts("schema.recommendations", schema_recommendations(f)),
        analysis(f, "comprehensive", prefix="analysis."),
        facts("relationships.relationships", found,
              ["column1", "column2"],
              ["strength", *[m for m in RELATION_METRICS if m != "significance"]],
              ["relationship_type", "description", "significance"]),
        facts("relationships.total",
              f"SELECT count(*) AS total_relationships FROM ({found})", (),
              ["total_relationships"]),
        finding_facts("relationships.insights", relationship_insights(f)),
        report_charts(f, "charts."),
    ])


def markdown(f, name, generated):
    def fixed(part, lines):
        rows = ", ".join("({}, '{:09d}', '{}')".format(part, i, x.replace("'", "''"))
                         for i, x in enumerate(lines))
        return f"SELECT * FROM (VALUES {rows}) t(part, within, line)"

    place = "CASE column_name " + " ".join(
        f"WHEN '{c}' THEN '{i:09d}'" for i, c in enumerate(f.names)) + " END"
    subject = place.replace("column_name", "subject")
    parts = [
        fixed(0, ["# Profile", "", f"Source: {name}  ", f"Made: {generated}  ", "Depth: comprehensive", "",
                  "## Size and quality", ""]),
        f"""SELECT 1 AS part, unnest(['0', '1', '2']) AS within, unnest([
            '- Rows: ' || format('{{:,}}', total_rows),
            '- Columns: ' || total_columns,
            '- Quality: ' || data_quality_score || '%']) AS line
            FROM ({overview(f)})""",
        fixed(2, ["", "## Columns", "", "| Column | Stored as | Holds | Missing | Distinct |",
                  "| --- | --- | --- | --- | --- |"]),
        f"""SELECT 3, {place}, '| ' || column_name || ' | ' || data_type || ' | ' || inferred_type
            || ' | ' || null_pct || '% | ' || unique_pct || '% |' FROM ({schema_columns(f)})""",
    ]
    for i, (sql, title) in enumerate([
        (insights(f), "## Observations"), (warnings(f), "## Cautions"),
        (recommendations(f), "## Advice"),
    ]):
        parts.append(f"SELECT * FROM ({fixed(4 + 2 * i, ['', title, ''])}) "
                     f"WHERE (SELECT count(*) FROM ({sql})) > 0")
        parts.append(f"SELECT {5 + 2 * i}, concat_ws(':', rule, {subject}), '- ' || message "
                     f"FROM ({sql})")
    parts.append(f"""SELECT 20, unnest(['0', '1', '2', '3', '4']), unnest(['',
        '## Relationships', '', n || ' found.', ''])
        FROM (SELECT count(*) AS n FROM ({relationships(f)}))""")
    return f"""SELECT (row_number() OVER (ORDER BY part, within, line))::INTEGER AS line_no, line
        FROM ({union(parts)})"""


# --- the queries ------------------------------------------------------------------------------

THREE = (EVENTS, LINEITEM, PART)
CUSTOMER_BACK = """SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal,
    c_mktsegment FROM customer"""
PEOPLE = Frame(
    """(SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment,
        lower(replace(c_name, '#', '')) || '@example.com' AS mail, c_acctbal < 0 AS in_debt,
        nullif(c_name, c_name) AS nothing FROM customer)""",
    [("c_custkey", "bigint"), ("c_nationkey", "int"), ("c_acctbal", "double"),
     ("c_mktsegment", "string"), ("mail", "string"), ("in_debt", "boolean"),
     ("nothing", "string")],
)
TINY = Frame("(SELECT l_tax / 100 AS tiny, l_returnflag FROM lineitem)",
             [("tiny", "double"), ("l_returnflag", "string")])
HALF = Frame(
    f"(SELECT event_type, CASE WHEN value > 40 THEN NULL ELSE value END AS value FROM {GAPS.sql})",
    [("event_type", "string"), ("value", "double")])
WIDE = Frame(
    f"""(SELECT l_orderkey, l_linenumber,
        {', '.join(f'l_quantity + {i} AS q{i}' for i in range(10))} FROM lineitem)""",
    [("l_orderkey", "bigint"), ("l_linenumber", "int"), *[(f"q{i}", "double") for i in range(10)]])
PAIRWISE = Frame(
    """(SELECT nullif(l_discount, 0) AS discount, CASE WHEN l_tax < 0.02 THEN NULL ELSE l_tax END
        AS tax, l_quantity, l_extendedprice FROM lineitem)""",
    [(c, "double") for c in ("discount", "tax", "l_quantity", "l_extendedprice")])
ROLE_GAPS = Frame(
    "(SELECT nullif(role, 'system') AS role, turn, conv_id FROM conversations)",
    [("role", "string"), ("turn", "bigint"), ("conv_id", "bigint")])
FLAGS_NET = Frame(
    f"(SELECT *, l_extendedprice * 0.9::DOUBLE AS net FROM {FLAGS.sql})",
    [*FLAGS.columns, ("net", "double")])
SUPPLIER_MEANS = Frame(
    """(SELECT avg(l_quantity) AS mean_quantity, avg(l_tax) AS mean_tax FROM lineitem
        GROUP BY l_suppkey)""",
    [("mean_quantity", "double"), ("mean_tax", "double")])
CUSTOMER_SAMPLE = Frame(
    "(SELECT * FROM customer ORDER BY md5(c_custkey::VARCHAR || '|42') LIMIT 300)",
    CUSTOMER.columns)

LARGE = Frame(
    """(SELECT CASE WHEN o_orderkey % 7 < 2 THEN 9007199254740993 WHEN o_orderkey % 7 < 4
        THEN 9007199254740992 ELSE 5 END AS k FROM orders)""", [("k", "bigint")])
DERIVED = Frame(
    f"(SELECT l_returnflag, {', '.join(f'l_quantity * {i + 1} AS q{i}' for i in range(12))} FROM lineitem)",
    [("l_returnflag", "string"), *[(f"q{i}", "double") for i in range(12)]])

PAGE_ROW = " || ".join(
    f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in PAGES.names)

ORACLES = {
    "desc_numeric": numeric_summary(LINEITEM),
    "desc_shape": shape(ORDERS),
    "desc_categorical_unique": union([unique(ORDERS), unique(PART), unique(DOCUMENTS)]),
    "desc_top_values": union([top(PART), top(ORDERS), top(EVENTS), top(DOCUMENTS)]),
    "proj_columns": "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem",
    "stat_moments": union(moments(f) for f in THREE),
    "stat_normality": union(normality(f) for f in THREE),
    "stat_normality_groups": normality(SUPPLIER_MEANS, 4),
    "stat_range": union(value_range(f) for f in THREE),
    "stat_percentiles": union(percentiles(f) for f in THREE),
    "stat_tests": union(tests(f) for f in (ORDERS, PART)),
    "dist_summary": union(dists(f) for f in THREE),
    "dist_large_ints": f"SELECT column_name, mode FROM ({dists(LARGE)})",
    "group_count": group_count(ORDERS, "o_custkey"),
    "group_sizes": group_sizes(LINEITEM, "l_returnflag"),
    "group_stats": group_stats(LINEITEM, "l_returnflag"),
    "group_stats_numeric_key": group_stats(
        LINEITEM, "l_suppkey", ["l_suppkey", "l_quantity", "l_tax"]),
    "quality_missing": missing(GAPS),
    "quality_missing_total": missing_total(GAPS),
    "quality_duplicates": duplicates(LINEITEM),
    "quality_duplicates_subset": duplicates(DOCUMENTS, ["text"]),
    "quality_type_roles": column_types(ORDERS),
    "quality_data_bytes": data_bytes(DOCUMENTS),
    "quality_report": quality_report(GAPS),
    "quality_score": score(GAPS),
    "outliers_iqr": union([outliers_iqr(EVENTS, ["value", "user_id"]),
                           outliers_iqr(DOCUMENTS, ["n_chars"])]),
    "outliers_zscore": union([outliers_z(EVENTS, ["value", "user_id"]),
                              outliers_z(DOCUMENTS, ["n_chars"])]),
    "outlier_values": f"""SELECT 'value' AS column_name, value FROM events,
        ({iqr_bounds(EVENTS, 'value')}) WHERE value < lower OR value > upper
        ORDER BY value LIMIT 100""",
    "corr_matrix": matrix(NET),
    "corr_strong": strong(NET),
    "corr_with_gaps": f"""SELECT column1, column2, {rnd('r')} AS correlation, n
        FROM ({pairs_r(PAIRWISE)})""",
    "rel_numeric": f"""SELECT column1, column2, {LABEL} AS relationship_type,
        {rnd('r')} AS strength, n FROM ({pairs_r(NET)}) WHERE abs(r) >= 0.7""",
    "rel_numeric_p": f"""SELECT column1, column2, {LABEL} AS relationship_type,
        {rnd('r')} AS strength, n, {rnd('p', 6)} AS p_value,
        CASE WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END AS significance
        FROM ({numeric_p(PART)})""",
    "crosstab_long": """SELECT o_orderstatus AS value1, o_orderpriority AS value2, count(*) AS n
        FROM orders GROUP BY 1, 2""",
    "rel_chi2": union(chi2(f) for f in (PART, DOCUMENTS, FLAGS)),
    "rel_chi2_p": union(chi2_p(f) for f in (ORDERS, PART, FLAGS)),
    "rel_anova": union(anova(f) for f in (CONVERSATIONS, ORDERS, FLAGS)),
    "rel_anova_p": union(anova_p(f) for f in (ORDERS, PART, CUSTOMER)),
    "rel_anova_gaps": anova(ROLE_GAPS),
    "rel_all": f"""SELECT column1, column2, relationship_type, strength, description, p_value,
        significance FROM ({relationships(DOCUMENTS)})""",
    "rel_all_lineitem": f"""SELECT column1, column2, relationship_type, strength, description,
        correlation, cramers_v, degrees_of_freedom::BIGINT AS degrees_of_freedom, eta_squared,
        p_value, significance FROM ({relationships(FLAGS_NET)})""",
    "rel_topk": f"""SELECT column1, column2, relationship_type, strength
        FROM ({relationships(FLAGS, 0.0)}) LIMIT 3""",
    "rel_insights": relationship_insights(DOCUMENTS),
    "rel_insights_none": relationship_insights(EVENTS.only("event_type", "value")),
    "rel_total_uncut": f"SELECT count(*) AS total_relationships FROM ({relationships(DERIVED)})",
    "schema_columns": union(schema_columns(f) for f in (CUSTOMER, PAGES, ORDERS)),
    "schema_columns_gaps": schema_columns(
        GAPS.only("event_id", "user_id", "event_type", "value", "props")),
    "schema_semantic_type": union(semantic_types(f) for f in (PEOPLE, PAGES, ORDERS)),
    "schema_constraints_num": union(numeric_constraints(f) for f in (CUSTOMER, ORDERS, PART)),
    "schema_constraints_str": union(
        text_constraints(f) for f in (CUSTOMER, ORDERS, PAGES, DOCUMENTS)),
    "schema_sample_values": sample_values(
        CUSTOMER.only("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey"),
    "schema_sample_values_any": union(
        f"""SELECT '{c}' AS column_name, string_agg(v, '|' ORDER BY draw) AS sample_values FROM (
        SELECT {c}::VARCHAR AS v, md5(upper(sha256({PAGE_ROW})) || '|{c}:42') AS draw FROM pages
        WHERE {c} IS NOT NULL ORDER BY draw, v LIMIT 5)"""
        for c in PAGES.names
    ),
    "sample_rows": """SELECT * FROM lineitem ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber,
        l_partkey, l_suppkey, '42')) LIMIT 500""",
    "schema_of_sample": schema_columns(CUSTOMER_SAMPLE),
    "schema_overview": overview(GAPS),
    "schema_recommendations": union([schema_recommendations(HALF), schema_recommendations(WIDE)]),
    "insights": union([insights(NET), insights(DOCUMENTS)]),
    "warnings": union([warnings(DOCUMENTS), warnings(GAPS.only("event_type", "value")),
                       warnings(TINY)]),
    "recommendations": union(recommendations(f) for f in (DOCUMENTS, PAGES, GAPS)),
    "chart_histogram": histogram(LINEITEM, LINEITEM.numeric[:5]),
    "chart_scatter": "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem",
    "chart_line": """WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx,
    value, user_id FROM events) SELECT idx, 'value' AS column_name, value FROM e
    UNION ALL SELECT idx, 'user_id', user_id::DOUBLE FROM e""",
    "chart_bar": f"""SELECT p_name AS category, {rnd('avg(p_partkey)')} AS mean FROM part
        GROUP BY p_name ORDER BY avg(p_partkey) DESC, p_name LIMIT 20""",
    "chart_box": union([box(LINEITEM, LINEITEM.numeric[:5]), box(EVENTS, ["value"])]),
    "chart_heatmap": matrix(PART, 2, "value"),
    "chart_heatmap_raw": f"""WITH m AS (SELECT l_linenumber, {rnd('avg(l_quantity)')} AS q,
    count(*)::DOUBLE AS n, (row_number() OVER (ORDER BY l_linenumber) - 1)::VARCHAR AS column1
    FROM lineitem GROUP BY l_linenumber)
    SELECT column1, 'quantity' AS column2, q AS value FROM m
    UNION ALL SELECT column1, 'lines', n FROM m""",
    "chart_correlation": matrix(NET, 2, "value"),
    "chart_distribution": union([
        distribution(LINEITEM, ["l_quantity", "l_extendedprice"]),
        distribution(EVENTS, ["value"])]),
    "chart_kde": density(EVENTS, ["value", "user_id"], 8, exact=False),
    "chart_kde_exact": density(LINEITEM, ["l_quantity", "l_discount"], 6, exact=True),
    "chart_pairplot": pairplot(PART, PART.numeric),
    "analyze_descriptive": analysis(PART, "descriptive"),
    "analyze_statistical": analysis(PART, "statistical"),
    "analyze_comprehensive": analysis(ORDERS, "comprehensive", "o_orderstatus"),
    "report_sections": report_sections(ORDERS, "o_orderkey"),
    "report_charts": report_charts(ORDERS),
    "report_raw_sample": """SELECT * FROM lineitem
        ORDER BY l_orderkey, l_linenumber, l_extendedprice LIMIT 100""",
    "report_json_roundtrip": numeric_summary(ORDERS),
    "report_markdown_lines": markdown(ORDERS, "orders.parquet", "2024-01-01 00:00:00"),
    "src_load_auto": "SELECT * FROM lineitem",
    "src_csv_roundtrip": CUSTOMER_BACK,
    "src_csv_text": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "src_csv_delim": union(
        f"""SELECT {d} AS written, {d} AS guessed, count(*) AS n_rows,
        count(DISTINCT c_name) AS names, round(sum(c_acctbal), 2) AS balance FROM customer"""
        for d in ("','", "';'", "chr(9)", "'|'")),
    "src_csv_na_tokens": """SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS c_custkey,
        CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
        nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_name FROM customer""",
    "src_csv_chunks": CUSTOMER_BACK,
    "src_multi_file_union": CUSTOMER_BACK,
    "src_file_info": """SELECT l_returnflag AS flag, '.parquet' AS extension, count(*) AS n_rows, true AS has_bytes
        FROM lineitem GROUP BY l_returnflag""",
    "profile_of_chunks": chunk_profile(LINEITEM),
    "src_json_roundtrip": CUSTOMER_BACK,
    "src_csv_wide_ids": """SELECT o_orderkey + 1234567890123456789 AS id,
        (o_orderkey::HUGEINT * 10000000000000000000 + 7)::VARCHAR AS wide FROM orders""",
    "src_csv_spaces": """SELECT c_custkey, '  ' || c_name || ' ' AS padded, ' NA ' AS mark
        FROM customer""",
    "src_csv_line_breaks": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "src_csv_chunks_text": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "src_csv_schema_order": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "src_csv_stray_quote": """SELECT p_partkey AS key, p_size || '" ' || p_brand AS label FROM part
        UNION ALL SELECT -1 - doc_id, md5(text) || chr(10) || lang FROM documents""",
    "src_json_records": CUSTOMER_BACK,
    "src_json_columns": """SELECT c_custkey, c_name, c_acctbal FROM customer""",
    "src_arrow_empty": "SELECT * FROM orders WHERE o_orderkey < 0",
    "sample_rows_many": """SELECT * FROM lineitem ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber,
        l_partkey, l_suppkey, '42')), l_orderkey LIMIT 20000""",
    "src_arrow_ipc": "SELECT * FROM orders",
    "src_sql_query": """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM orders GROUP BY o_orderstatus""",
    "src_sql_table": """SELECT * FROM customer UNION ALL
        SELECT * FROM customer WHERE c_acctbal < 0""",
    "src_list_tables": """SELECT 'sondage_view_orders' AS table_name, count(*) AS n_rows FROM orders
        UNION ALL SELECT 'sondage_view_customer', count(*) FROM customer""",
}
