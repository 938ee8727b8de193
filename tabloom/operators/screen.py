"""Correlation, chi-square, analysis of variance and mutual information."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.aggregate import long_form, wide_stats
from tabloom.operators.quantiles import exact_medians
from tabloom.operators.roles import names_where

def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, a, b, n, corr) for each pair i < j, each over its complete rows; undefined -> null.

    Pairwise sums of all columns are matrix products, one set per task. Values
    are shifted by the column mean first, so the sums do not cancel. Each task
    emits a fixed number of rows whatever its length. (One aggregate over all
    pairs outgrows what the JVM compiles: six times slower at six columns.)
    """
    columns = list(columns)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, a string, b string, n long, corr double")
    width = len(columns)
    means = {
        r["column"]: r["m"] or 0.0
        for r in wide_stats(df, columns, {"m": lambda c: F.avg(F.col(c).cast("double"))}).collect()
    }
    shift = [float(means[c]) for c in columns]
    data = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])

    def products(batches):
        import numpy as np
        import pandas as pd

        n, sx, sxx, sxy = (np.zeros((width, width)) for _ in range(4))
        offset = np.array(shift)
        for batch in batches:
            x = batch.to_numpy(dtype="float64") - offset
            seen = ~np.isnan(x)
            x[~seen] = 0.0
            m = seen.astype("float64")
            n += m.T @ m
            sx += x.T @ m
            sxx += (x * x).T @ m
            sxy += x.T @ x
        i, j = np.triu_indices(width, 1)
        yield pd.DataFrame(
            {
                "i": i.astype("int32"),
                "j": j.astype("int32"),
                "n": n[i, j],
                "sx": sx[i, j],
                "sy": sx[j, i],
                "sxx": sxx[i, j],
                "syy": sxx[j, i],
                "sxy": sxy[i, j],
            }
        )

    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    schema = "i int, j int, " + ", ".join(f"{s} double" for s in sums)
    total = data.mapInPandas(products, schema).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    n = F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.try_divide(F.col("sx"), n)
    vy = F.col("syy") - F.col("sy") * F.try_divide(F.col("sy"), n)
    cov = F.col("sxy") - F.col("sx") * F.try_divide(F.col("sy"), n)
    # a spread at rounding level is a constant column
    varies = (vx > F.col("sxx") * 1e-13) & (vy > F.col("syy") * 1e-13)
    names = F.array(*[F.lit(c) for c in columns])
    return total.select(
        "i",
        "j",
        names[F.col("i")].alias("a"),
        names[F.col("j")].alias("b"),
        n.cast("long").alias("n"),
        F.when(varies & (n > 1), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy)))).alias("corr"),
    )


def correlated_columns(df: DataFrame, columns: Sequence[str], threshold: float, fill_median: bool = False) -> DataFrame:
    """(column, worst): columns whose |corr| with any earlier column exceeds the threshold."""
    if fill_median:
        medians = {r["column"]: r["value"] for r in exact_medians(df, columns).collect()}
        df = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c))).alias(c) for c in columns])
    return (
        correlations(df, columns)
        .filter(F.abs("corr") > threshold)
        .groupBy(F.col("b").alias("column"))
        .agg(F.max(F.abs("corr")).alias("worst"))
    )


def drop_correlated(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> tuple[DataFrame, list[str]]:
    """The frame less its correlated columns, and their names."""
    dropped = names_where(correlated_columns(df, columns, threshold))
    return df.drop(*dropped), dropped


def top_variance(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """(column, variance) of the k columns of largest sample variance."""
    stats = wide_stats(df, columns, {"variance": lambda c: F.var_samp(F.col(c).cast("double"))})
    return stats.orderBy(F.desc("variance"), "column").limit(k)


def contingency_cells(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, value, class, o): counts of every pair, missing sides left out."""
    data = df.filter(F.col(label).isNotNull()).select(*features, F.col(label).cast("string").alias("__class"))
    return (
        long_form(data, features, ["__class"])
        .filter(F.col("value").isNotNull())
        .groupBy(F.col("column").alias("feature"), "value", F.col("__class").alias("class"))
        .agg(F.count("*").alias("o"))
    )


def chi_square(
    df: DataFrame, features: Sequence[str], label: str, max_values: int = 50, min_cell: int = 5
) -> DataFrame:
    """(feature, chi2, dof, n, values) of the features that pass both rules.

    Too many values, or a cell (an absent pair is an empty cell) below the
    minimum, leave a feature out. A 2 x 2 table gets the continuity correction.
    """
    cells = contingency_cells(df, features, label)
    rows = cells.groupBy("feature", "value").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("feature", "class").agg(F.sum("o").alias("c"))
    sizes = rows.groupBy("feature").agg(F.count("*").alias("values"), F.sum("r").alias("n"))
    classes = cols.groupBy("feature").agg(F.count("*").alias("classes"))
    filled = cells.groupBy("feature").agg(F.count("*").alias("cells"), F.min("o").alias("least"))
    fit = (
        sizes.join(classes, "feature")
        .join(filled, "feature")
        .filter(
            (F.col("values") <= max_values)
            & (F.col("cells") == F.col("values") * F.col("classes"))
            & (F.col("least") >= min_cell)
        )
    )
    # at most one row per feature name
    full = cells.join(F.broadcast(fit), "feature").join(rows, ["feature", "value"]).join(cols, ["feature", "class"])
    dof = (F.col("values") - 1) * (F.col("classes") - 1)
    e = F.col("r") * F.col("c") / F.col("n")
    gap = F.abs(F.col("o") - e)
    gap = F.when(dof == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    return full.groupBy("feature").agg(
        F.sum(gap * gap / e).alias("chi2"),
        F.first(dof).alias("dof"),
        F.first("n").alias("n"),
        F.first("values").alias("values"),
    )


def with_chi2_p(table: DataFrame) -> DataFrame:
    """Add ``p_value`` to a chi-square table (one row per feature)."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, dof: pd.Series) -> pd.Series:
        # closed forms for whole degrees of freedom: a finite Poisson sum when
        # even, the normal tail plus such a sum when odd
        out = []
        for a, k in zip(x, dof):
            if not k:
                out.append(1.0)
                continue
            h = a / 2.0
            if k % 2 == 0:
                total, at, term = 0.0, 0.0, 0
                powers = range(int(k) // 2)
            else:
                total, powers = math.erfc(math.sqrt(h)), (i + 0.5 for i in range(int(k) // 2))
            for at in powers:
                total += math.exp(at * math.log(h) - h - math.lgamma(at + 1)) if h > 0 else float(at == 0)
            out.append(min(1.0, total))
        return pd.Series(out)

    return table.withColumn("p_value", tail("chi2", F.col("dof").cast("long")))


def anova(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, f, between_dof, within_dof): one-way F of each numeric feature."""
    data = df.filter(F.col(label).isNotNull())
    per = wide_stats(
        data,
        list(features),
        {
            "n": lambda c: F.count(c),
            "mean": lambda c: F.avg(F.col(c).cast("double")),
            "var": lambda c: F.var_pop(F.col(c).cast("double")),
        },
        [label],
    ).filter(F.col("n") > 0)
    grand = per.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("k"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
    )
    both = per.join(grand, "column")
    sums = both.groupBy("column", "total", "k").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("ssb"),
        F.sum(F.col("n") * F.col("var")).alias("ssw"),
    )
    between, within = F.col("k") - 1, F.col("total") - F.col("k")
    return sums.select(
        F.col("column").alias("feature"),
        F.try_divide(F.try_divide(F.col("ssb"), between), F.try_divide(F.col("ssw"), within)).alias("f"),
        between.alias("between_dof"),
        within.alias("within_dof"),
    )


def with_f_p(table: DataFrame) -> DataFrame:
    """Add ``p_value`` to an F table (one row per feature)."""

    @F.pandas_udf("double")
    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        import numpy as np

        # tail = 2/B(p, q) * integral of cos(v)^(2p-1) sin(v)^(2q-1) from the angle
        # of f up to a right angle, by Simpson's rule over the part that counts
        out = []
        for x, a, b in zip(f, d1, d2):
            if x is None or math.isnan(x) or a < 1 or b < 1:
                out.append(None)
                continue
            p, q = b / 2.0, a / 2.0
            start = math.atan(math.sqrt(a * x / b))
            peak = math.atan(math.sqrt(max(a - 1.0, 0.0) / max(b - 1.0, 1.0)))
            end = min(math.pi / 2, max(start, peak) + 40.0 / math.sqrt(2 * p))
            v = np.linspace(start, end, 20_001)
            cos, sin = np.maximum(np.cos(v), 1e-300), np.maximum(np.sin(v), 1e-300)
            if p > 1e6:  # the difference of two huge log-gammas would lose its digits
                gap = q * math.log(p) + q * (q - 1) / (2 * p)
            else:
                gap = math.lgamma(p + q) - math.lgamma(p)
            y = np.exp((b - 1) * np.log(cos) + (a - 1) * np.log(sin) + math.log(2.0) + gap - math.lgamma(q))
            area = (v[1] - v[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
            out.append(float(min(1.0, max(0.0, area))))
        return pd.Series(out, dtype="float64")

    return table.withColumn(
        "p_value", tail("f", F.col("between_dof").cast("long"), F.col("within_dof").cast("long"))
    )


def discrete_information(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, score): mutual information with the class in nats, from counted pairs."""
    cells = contingency_cells(df, features, label)
    rows = cells.groupBy("feature", "value").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("feature", "class").agg(F.sum("o").alias("c"))
    total = cols.groupBy("feature").agg(F.sum("c").alias("n"))
    full = cells.join(rows, ["feature", "value"]).join(cols.join(total, "feature"), ["feature", "class"])
    term = F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("r").cast("double") * F.col("c")))
    return full.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(term)).alias("score"))


def selection_summary(
    information: DataFrame, chi2: DataFrame, ids: DataFrame, correlated: DataFrame
) -> DataFrame:
    """(kind, feature, score): the four screening results as one table, ranked within a kind."""

    def part(kind: str, table: DataFrame, name: str, score: str | None) -> DataFrame:
        value = F.lit(None).cast("double") if score is None else F.col(score).cast("double")
        return table.select(F.lit(kind).alias("kind"), F.col(name).alias("feature"), value.alias("score"))

    return (
        part("mutual_information", information, "feature", "score")
        .unionByName(part("chi_square", chi2, "feature", "chi2"))
        .unionByName(part("id_like", ids, "column", None))
        .unionByName(part("correlated", correlated, "column", "worst"))
    )
