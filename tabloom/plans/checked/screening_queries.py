"""Correlation, chi-square, analysis of variance, mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import screen
from tabloom.operators.information import neighbour_information
from tabloom.operators.roles import id_like_columns
from tabloom.plans.checked import checked
from tabloom.plans.checked.inputs import (
    LINEITEM_WITH_GAPS,
    ORDERS_WITH_GAPS,
    lineitem_with_gaps,
    orders_with_gaps,
    table,
)
from tabloom.plans.checked.profile_queries import union_over

_NUMERIC = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_net"]
_PAIRS = [(i, j) for j in range(len(_NUMERIC)) for i in range(j)]


def correlations_sql(columns, source: str) -> str:
    pairs = [(i, j) for j in range(len(columns)) for i in range(j)]
    return union_over(
        pairs,
        lambda p: f"SELECT '{columns[p[0]]}' AS a, '{columns[p[1]]}' AS b, "
        f"count(*) FILTER ({columns[p[0]]} IS NOT NULL AND {columns[p[1]]} IS NOT NULL) AS n, "
        f"round(corr({columns[p[0]]}, {columns[p[1]]}), 8) + 0.0 AS corr FROM {source}",
    )


def _rounded(df: DataFrame, column: str, digits: int = 8) -> DataFrame:
    # adding zero turns -0.0 into 0.0
    return df.withColumn(column, F.round(column, digits) + 0.0)


@checked(f"WITH g AS ({LINEITEM_WITH_GAPS}) {correlations_sql(_NUMERIC, 'g')}")
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    out = screen.correlations(lineitem_with_gaps(spark, d), _NUMERIC)
    return _rounded(out.select("a", "b", "n", "corr"), "corr")


def _widened(df: DataFrame) -> DataFrame:
    """Fourteen columns: the measures and simple functions of them."""
    more = {f"{c}_sq": F.col(c) * F.col(c) for c in _NUMERIC[:4]}
    more.update({f"{c}_inv": 1 / (F.col(c) + 1) for c in _NUMERIC[:4]})
    return df.select(*_NUMERIC, *[e.alias(n) for n, e in more.items()])


_WIDE = [*_NUMERIC, *[f"{c}_sq" for c in _NUMERIC[:4]], *[f"{c}_inv" for c in _NUMERIC[:4]]]
_WIDE_SQL = (
    f"SELECT {', '.join(_NUMERIC)}, {', '.join(f'{c} * {c} AS {c}_sq' for c in _NUMERIC[:4])}, "
    f"{', '.join(f'1 / ({c} + 1) AS {c}_inv' for c in _NUMERIC[:4])} FROM ({LINEITEM_WITH_GAPS})"
)


@checked(f"WITH g AS ({_WIDE_SQL}) {correlations_sql(_WIDE, 'g')}")
def corr_matrix_wide(spark: SparkSession, d: str) -> DataFrame:
    """More columns than one aggregate holds: matrix products per task."""
    out = screen.correlations(_widened(lineitem_with_gaps(spark, d)), _WIDE)
    return _rounded(out.select("a", "b", "n", "corr"), "corr")


@checked(f"""
WITH g AS ({LINEITEM_WITH_GAPS}), c AS ({correlations_sql(_NUMERIC, "g")})
SELECT b AS "column", max(abs(corr)) AS worst FROM c WHERE abs(corr) > 0.8 GROUP BY 1""")
def corr_screen(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(screen.correlated_columns(lineitem_with_gaps(spark, d), _NUMERIC, 0.8), "worst")


_FILLED_SQL = (
    "SELECT "
    + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM g0)) AS {c}" for c in _NUMERIC)
    + " FROM g0"
)


@checked(f"""
WITH g0 AS ({LINEITEM_WITH_GAPS}), g AS ({_FILLED_SQL}), c AS ({correlations_sql(_NUMERIC, "g")})
SELECT b AS "column", max(abs(corr)) AS worst FROM c WHERE abs(corr) > 0.6 GROUP BY 1""")
def corr_screen_filled(spark: SparkSession, d: str) -> DataFrame:
    out = screen.correlated_columns(lineitem_with_gaps(spark, d), _NUMERIC, 0.6, fill_median=True)
    return _rounded(out, "worst")


@checked(f"WITH g AS ({LINEITEM_WITH_GAPS}) SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM g")
def drop_correlated(spark: SparkSession, d: str) -> DataFrame:
    df = lineitem_with_gaps(spark, d).select(*_NUMERIC)
    return screen.drop_correlated(df, _NUMERIC, 0.8)[0]


@checked(
    f"WITH g AS ({LINEITEM_WITH_GAPS}) SELECT * FROM ("
    + union_over(_NUMERIC, lambda c: f"SELECT '{c}' AS \"column\", round(var_samp({c}), 2) AS variance FROM g")
    + ") ORDER BY variance DESC LIMIT 4"
)
def top_variance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(screen.top_variance(lineitem_with_gaps(spark, d), _NUMERIC, 4), "variance", 2)


@checked(
    f"WITH g AS ({LINEITEM_WITH_GAPS}), v AS ("
    + union_over(_NUMERIC, lambda c: f"SELECT '{c}' AS name, var_samp({c}) AS s FROM g")
    + f"), t AS (SELECT name FROM v ORDER BY s DESC LIMIT 3), c AS ({correlations_sql(_NUMERIC, 'g')}) "
    "SELECT least(a, b) AS a, greatest(a, b) AS b, n, corr FROM c WHERE a IN (SELECT name FROM t) AND b IN (SELECT name FROM t)"
)
def top_variance_correlations(spark: SparkSession, d: str) -> DataFrame:
    df = lineitem_with_gaps(spark, d)
    names = [r["column"] for r in screen.top_variance(df, _NUMERIC, 3).collect()]
    out = screen.correlations(df, sorted(names)).select("a", "b", "n", "corr")
    return _rounded(out, "corr")


_CATEGORIES = ["l_linestatus", "ship_month", "l_suppkey"]


def _shipped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_suppkey", F.month("l_shipdate").alias("ship_month")
    )


_SHIPPED = "SELECT l_returnflag, l_linestatus, l_suppkey, month(l_shipdate) AS ship_month FROM lineitem"


def _chi_sql(label: str, features, digits: int = 6) -> str:
    return (
        f"WITH g AS ({_SHIPPED}), cells AS ("
        + union_over(
            features,
            lambda f: f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value, CAST({label} AS VARCHAR) AS class, count(*) AS o FROM g GROUP BY 2, 3",
        )
        + "), r AS (SELECT feature, value, sum(o) AS r FROM cells GROUP BY 1, 2), "
        "c AS (SELECT feature, class, sum(o) AS c FROM cells GROUP BY 1, 2), "
        "n AS (SELECT feature, sum(r) AS n, count(*) AS vals FROM r GROUP BY 1), "
        "k AS (SELECT feature, count(*) AS classes FROM c GROUP BY 1), "
        "grid AS (SELECT r.feature, r.value, c.class, r, c, n, vals, classes, coalesce(o, 0) AS o, r * c / CAST(n AS DOUBLE) AS e, "
        "  (vals - 1) * (classes - 1) AS dof FROM r JOIN c ON r.feature = c.feature JOIN n ON r.feature = n.feature "
        "  JOIN k ON r.feature = k.feature LEFT JOIN cells ON cells.feature = r.feature AND cells.value = r.value AND cells.class = c.class) "
        "SELECT feature, round(sum(power(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e), "
        f"{digits}) AS chi2, "
        'CAST(max(dof) AS BIGINT) AS dof, CAST(max(n) AS BIGINT) AS n, CAST(max(vals) AS BIGINT) AS "values" '
        "FROM grid GROUP BY feature HAVING max(vals) <= 50 AND min(o) >= 5"
    )


@checked(_chi_sql("l_returnflag", _CATEGORIES))
def chi2_stat(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(screen.chi_square(_shipped(spark, d), _CATEGORIES, "l_returnflag"), "chi2", 6)


@checked(_chi_sql("l_linestatus", ["l_returnflag", "ship_month"]))
def chi2_two_classes(spark: SparkSession, d: str) -> DataFrame:
    out = screen.chi_square(_shipped(spark, d), ["l_returnflag", "ship_month"], "l_linestatus")
    return _rounded(out, "chi2", 6)


@checked(
    f"WITH t AS ({_chi_sql('l_returnflag', _CATEGORIES, 12)}) "
    "SELECT feature, dof, round(least(1, (SELECT sum(exp(i * ln(chi2 / 2) - chi2 / 2 - lgamma(i + 1))) "
    "FROM (SELECT unnest(range(dof // 2)) AS i))), 6) AS p_value FROM t"
)
def chi2_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Even degrees of freedom, where the tail is a finite sum."""
    out = screen.with_chi2_p(screen.chi_square(_shipped(spark, d), _CATEGORIES, "l_returnflag"))
    return _rounded(out.select("feature", "dof", "p_value"), "p_value", 6)


def _anova_sql(digits: int) -> str:
    return f"WITH g AS ({LINEITEM_WITH_GAPS}) " + union_over(
        _NUMERIC,
        lambda c: f"SELECT '{c}' AS feature, round((sum(n * (m - g0) * (m - g0)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), {digits}) AS f, "
        f"count(*) - 1 AS between_dof, CAST(sum(n) - count(*) AS BIGINT) AS within_dof FROM (SELECT count({c}) AS n, avg({c}) AS m, "
        f"var_pop({c}) AS v, (SELECT avg({c}) FROM g) AS g0 FROM g GROUP BY l_returnflag)",
    )


@checked(_anova_sql(6))
def anova_f(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(screen.anova(lineitem_with_gaps(spark, d), _NUMERIC, "l_returnflag"), "f", 6)


@checked(
    f"SELECT feature, within_dof, round(power(1 + 2 * f / within_dof, -(within_dof / 2.0E0)), 6) AS p_value FROM ({_anova_sql(12)})"
)
def anova_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Three classes, where the tail has a closed form."""
    out = screen.with_f_p(screen.anova(lineitem_with_gaps(spark, d), _NUMERIC, "l_returnflag"))
    return _rounded(out.select("feature", "within_dof", "p_value"), "p_value", 6)


def _information_sql(source: str, features, label: str) -> str:
    return union_over(
        features,
        lambda f: f"SELECT '{f}' AS feature, round(greatest(0, sum(o / n * ln(o * n / (r * CAST(c AS DOUBLE))))), 9) AS score FROM ("
        f"SELECT count(*) AS o, CAST(sum(count(*)) OVER () AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY {f}) AS r, "
        f"sum(count(*)) OVER (PARTITION BY {label}) AS c FROM {source} WHERE {f} IS NOT NULL GROUP BY {f}, {label})",
    )


@checked(f"WITH g AS ({ORDERS_WITH_GAPS}) {_information_sql('g', ['o_orderstatus', 'o_custkey', 'o_rare'], 'o_orderpriority')}")
def mi_discrete(spark: SparkSession, d: str) -> DataFrame:
    out = screen.discrete_information(
        orders_with_gaps(spark, d), ["o_orderstatus", "o_custkey", "o_rare"], "o_orderpriority"
    )
    return _rounded(out, "score", 9)


_PSI = " ".join(f"WHEN {i} THEN {sum(1.0 / j for j in range(1, i)) - 0.5772156649015329!r}" for i in range(1, 13))


def psi_sql(x: str) -> str:
    s = f"CAST({x} AS DOUBLE)"
    return (
        f"(CASE CAST({x} AS BIGINT) {_PSI} ELSE ln({s}) - 1 / {s} / 2 - 1 / ({s} * {s}) / 12 "
        f"+ 1 / power({s}, 4) / 120 - 1 / power({s}, 6) / 252 END)"
    )


def neighbour_sql(source: str, feature: str, label: str) -> str:
    """k = 3 neighbours, point by point, without counting ties first."""
    spans = ", ".join(
        f"CASE WHEN {'TRUE' if i == 0 else f'lag(x, {i}) OVER w IS NOT NULL'} AND {'TRUE' if 3 - i == 0 else f'lead(x, {3 - i}) OVER w IS NOT NULL'} "
        f"THEN greatest({'0.0E0' if i == 0 else f'x - lag(x, {i}) OVER w'}, {'0.0E0' if 3 - i == 0 else f'lead(x, {3 - i}) OVER w - x'}) END"
        for i in range(4)
    )
    return f"""
    SELECT '{feature}' AS feature, round(greatest(0, max({psi_sql("total")}) + {psi_sql("3")} - avg({psi_sql("size")}) - avg({psi_sql("m")})), 8) AS score
    FROM (SELECT *, count(*) OVER () AS total, count(*) OVER (ORDER BY x RANGE BETWEEN rad PRECEDING AND rad FOLLOWING) AS m
      FROM (SELECT x, class, size, greatest(dist - 2e-15 * (abs(x) + dist), 0) AS rad
        FROM (SELECT x, class, count(*) OVER (PARTITION BY class) AS size, least({spans}) AS dist
          FROM (SELECT CAST({feature} AS DOUBLE) AS x, {label} AS class FROM {source} WHERE {feature} IS NOT NULL)
          WINDOW w AS (PARTITION BY class ORDER BY x))))"""


@checked(
    f"WITH g AS ({LINEITEM_WITH_GAPS}) "
    + union_over(["l_quantity", "l_extendedprice", "l_net", "l_tax"], lambda f: neighbour_sql("g", f, "l_returnflag"))
)
def mi_knn(spark: SparkSession, d: str) -> DataFrame:
    features = ["l_quantity", "l_extendedprice", "l_net", "l_tax"]
    return _rounded(neighbour_information(lineitem_with_gaps(spark, d), features, "l_returnflag"), "score")


@checked(
    f"WITH g AS ({LINEITEM_WITH_GAPS}), i AS ({neighbour_sql('lineitem', 'l_extendedprice', 'l_returnflag')}), "
    f"h AS ({_chi_sql('l_returnflag', ['l_linestatus', 'ship_month'])}), c AS ({correlations_sql(_NUMERIC, 'g')}) "
    "SELECT 'mutual_information' AS kind, feature, score FROM i "
    "UNION ALL SELECT 'chi_square', feature, round(chi2, 6) FROM h "
    "UNION ALL SELECT 'id_like', c, NULL FROM (SELECT 'l_orderkey' AS c, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL "
    "SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem) WHERE n > 50 "
    "UNION ALL SELECT 'correlated', b, max(abs(corr)) FROM c WHERE abs(corr) > 0.8 GROUP BY b"
)
def selection_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    out = screen.selection_summary(
        _rounded(neighbour_information(lines, ["l_extendedprice"], "l_returnflag"), "score"),
        _rounded(screen.chi_square(_shipped(spark, d), ["l_linestatus", "ship_month"], "l_returnflag"), "chi2", 6),
        id_like_columns(lines.select("l_orderkey", "l_partkey", "l_suppkey")),
        _rounded(screen.correlated_columns(lineitem_with_gaps(spark, d), _NUMERIC, 0.8), "worst"),
    )
    return out
