"""Nearest-neighbour mutual information of a continuous feature and a class.

The estimator of Ross (2014): for each point the distance to its k-th
neighbour of the same class, then the number of points of any class within that
distance. Both are questions about sort order, so no pair of points is ever
formed: equal (feature, value, class) rows are counted first and shuffled once
into cells, ranges of a feature's values. A cell is one stored row of packed
arrays. It learns the k points of each class before and after it and the rows
before it from small tables of cell edges and cell totals; distances and counts
are binary searches inside the cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.aggregate import one_zero, wide_stats
from tabloom.operators.quantiles import exact_medians
from tabloom.operators.ranks import in_cells
from tabloom.session import discard, stored

# Distances closer than this share of the operands are one distance.
_TIE = 2e-15
_EULER = 0.5772156649015329
_EXACT_UP_TO = 12
# a worker is handed a hundred cells at a time
POINTS_PER_CELL = 25_000
_MAX_CELLS = 80_000  # of a feature: its cells hold more than POINTS_PER_CELL only past 2e9 rows


def digamma(n: Column) -> Column:
    """Digamma of a positive whole number: exact sums first, then its asymptotic series."""
    x = n.cast("double")
    inv = F.lit(1.0) / x
    inv2 = inv * inv
    series = F.log(x) - inv / 2 - inv2 / 12 + inv2 * inv2 / 120 - inv2 * inv2 * inv2 / 252
    out, total = F.when(n == 1, F.lit(-_EULER)), 0.0
    for i in range(2, _EXACT_UP_TO + 1):
        total += 1.0 / (i - 1)
        out = out.when(n == i, F.lit(total - _EULER))
    return out.otherwise(series)


def with_neighbours(
    df: DataFrame, by: Sequence[str], x: str, carry: str, k: int, splits: list[float] | None
) -> DataFrame:
    """Add the k rows before and after each row of its group's order by ``x``.

    ``x`` is distinct within a group. Columns ``x_-1, c_-1, ... x_k, c_k`` hold
    neighbour values of ``x`` and ``carry``. Cells get copies of the k rows
    that precede and follow them, reaching over cells with fewer than k rows.
    """
    by = list(by)
    if splits is None:
        return _lags(df, Window.partitionBy(*by).orderBy(x), x, carry, k)

    celled = in_cells(df, x, splits)
    counts = celled.groupBy(*by, "__cell").agg(F.count("*").alias("__k"))
    along = Window.partitionBy(*by).orderBy("__cell")
    near = counts.select(
        *by,
        "__cell",
        *[
            f(c, j).over(along).alias(f"__{side}{c}{j}")
            for side, f in (("n", F.lead), ("p", F.lag))
            for c in ("__cell", "__k")
            for j in range(1, k + 1)
        ],
    )
    inside = Window.partitionBy(*by, "__cell")
    edge_rows = celled.withColumns(
        {
            "__top": F.row_number().over(inside.orderBy(F.desc(x))),
            "__bottom": F.row_number().over(inside.orderBy(x)),
        }
    ).filter((F.col("__top") <= k) | (F.col("__bottom") <= k))
    edge_rows = edge_rows.join(near, [*by, "__cell"])

    def reaches(side: str, rank: str) -> list[Column]:
        """Cell j away, where the row is still among the k nearest across the cells between."""
        out, between = [], F.lit(0)
        for j in range(1, k + 1):
            near_enough = F.col(rank) + between <= k
            out.append(F.when(near_enough, F.col(f"__{side}__cell{j}")))
            between = between + F.coalesce(F.col(f"__{side}__k{j}"), F.lit(k))
        return out

    targets = F.array(*reaches("n", "__top"), *reaches("p", "__bottom"))
    ghosts = (
        edge_rows.withColumn("__to", F.explode(targets))
        .filter(F.col("__to").isNotNull())
        .select(*df.columns, F.col("__to").alias("__cell"), F.lit(True).alias("__ghost"))
    )
    whole = celled.withColumn("__ghost", F.lit(False)).unionByName(ghosts)
    out = _lags(whole, inside.orderBy(x), x, carry, k)
    return out.filter(~F.col("__ghost")).drop("__ghost", "__cell")


def _lags(df: DataFrame, w, x: str, carry: str, k: int) -> DataFrame:
    new = {}
    for j in range(1, k + 1):
        new[f"x_-{j}"], new[f"c_-{j}"] = F.lag(x, j).over(w), F.lag(carry, j).over(w)
        new[f"x_{j}"], new[f"c_{j}"] = F.lead(x, j).over(w), F.lead(carry, j).over(w)
    return df.withColumns(new)


def neighbour_information(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    k: int = 3,
    fill_median: bool = False,
    rows_per_cell: int = POINTS_PER_CELL,
) -> DataFrame:
    """(feature, score): mutual information in nats of each numeric feature and the class.

    Classes of one member are left out; a class of at most k members uses its
    size less one. Missing values are left out, or filled by the median. A
    feature without two members of a class has no row. The work is done when the
    call returns: the cells are stored for it and deleted again, and one row of
    sums per feature reaches the driver.
    """
    spark, features = df.sparkSession, list(features)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    medians = {r["column"]: r["value"] for r in exact_medians(df, features).collect()} if fill_median else {}
    values = {f: one_zero(F.col(f), kinds[f]).cast("double") for f in features}
    columns = [f"f{i}" for i in range(len(features))]
    data = df.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("string").alias("class"),
        *[F.coalesce(values[f], F.lit(medians.get(f))).alias(c) for f, c in zip(features, columns)],
    )
    sizes = wide_stats(data, columns, {"size": lambda c: F.count(c)}, ["class"])
    sizes, sizes_path = stored(
        sizes.select(F.substring("column", 2, 9).cast("int").alias("feature"), "class", "size").filter("size > 1")
    )
    rows = {columns[r["feature"]]: r["n"] for r in sizes.groupBy("feature").agg(F.sum("size").alias("n")).collect()}
    edges = _cell_edges(data, columns, rows, rows_per_cell)
    # points of equal value meet in the tasks first, so a frequent value is few rows when it moves
    points = _placed(data, columns, edges).groupBy("feature", "cell", "class", "x").agg(F.count("*").alias("c"))
    points = points.join(sizes, ["feature", "class"])
    cells, path = stored(points.groupBy("feature", "cell").applyInPandas(_packer(k), _CELL))
    try:
        return _scores(spark, cells, features, edges, k)
    finally:
        discard(spark, path, sizes_path)


_EDGE = (
    "class string, size bigint, first_x array<double>, first_c array<bigint>, "
    "last_x array<double>, last_c array<bigint>"
)
_CELL = f"feature int, cell int, total bigint, classes array<string>, x binary, code binary, c binary, edges array<struct<{_EDGE}>>"
_FAR = "class int, x double, weight bigint, known bigint, at int, value double, upper boolean"
_SUMS = f"weight bigint, reach double, size double, near double, far array<struct<{_FAR}>>"


def _cell_edges(
    data: DataFrame, columns: Sequence[str], rows: Mapping[str, int], rows_per_cell: int
) -> list[list[float]]:
    """Inner bounds of the cells of every feature, from a sketch of fixed accuracy."""
    sized = [(c, math.ceil(rows.get(c, 0) / rows_per_cell)) for c in columns]
    cut = [(c, min(_MAX_CELLS, 2 * n)) for c, n in sized if n > 1]
    if not cut:
        return [[] for _ in columns]
    found = data.agg(
        *[F.percentile_approx(c, [i / n for i in range(1, n)], 10 * n).alias(c) for c, n in cut]
    ).first()
    return [sorted({v for v in found[c] if math.isfinite(v)}) if c in dict(cut) else [] for c in columns]


def _placed(data: DataFrame, columns: Sequence[str], edges: Sequence[list[float]]) -> DataFrame:
    """(class, feature, cell, x): a row per value that is there."""
    cut = [(c, e) for c, e in zip(columns, edges) if e]
    if cut:
        data = Bucketizer(
            splitsArray=[[-math.inf, *e, math.inf] for _, e in cut],
            inputCols=[c for c, _ in cut],
            outputCols=[f"{c}_cell" for c, _ in cut],
            handleInvalid="keep",
        ).transform(data)
    parts = [
        F.struct(
            F.lit(i).alias("feature"),
            (F.col(f"{c}_cell").cast("int") if edges[i] else F.lit(0)).alias("cell"),
            F.col(c).alias("x"),
        )
        for i, c in enumerate(columns)
    ]
    return data.select("class", F.inline(F.array(*parts))).filter(F.col("x").isNotNull())


def _packer(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The points of a cell as one row, with the first and last k points of each class."""

    def pack(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("x", kind="stable")
        code, classes = pd.factorize(points["class"])
        x, c, size = (points[n].to_numpy() for n in ("x", "c", "size"))
        edges = []
        for i, name in enumerate(classes):
            at = np.flatnonzero(code == i)
            first, last = at[:k], at[-k:]
            edges.append(
                {
                    "class": name, "size": int(size[at[0]]),
                    "first_x": x[first].tolist(), "first_c": c[first].tolist(),
                    "last_x": x[last].tolist(), "last_c": c[last].tolist(),
                }
            )
        row = {
            "feature": int(points["feature"].iloc[0]), "cell": int(points["cell"].iloc[0]), "total": int(c.sum()),
            "classes": list(classes), "x": x.astype("<f8").tobytes(), "code": code.astype("<i4").tobytes(),
            "c": c.astype("<i8").tobytes(), "edges": edges,
        }
        return pd.DataFrame([row])

    return pack


def _surroundings(cells: DataFrame, k: int) -> DataFrame:
    """(feature, cell, before, near): rows in earlier cells, and the k points of each class on both sides.

    A cell without points of a class has no edge of it, so the k cells next in
    the order of a class hold the k points next to any cell.
    """
    edges = cells.select("feature", "cell", F.inline("edges"))
    along = Window.partitionBy("feature", "class").orderBy("cell")
    none = {"x": F.array().cast("array<double>"), "c": F.array().cast("array<bigint>")}

    def earlier(v: str) -> Column:
        parts = [F.coalesce(F.lag(f"last_{v}", j).over(along), none[v]) for j in range(k, 0, -1)]
        return F.reverse(F.slice(F.reverse(F.concat(*parts)), 1, k))

    def later(v: str) -> Column:
        return F.slice(F.concat(*[F.coalesce(F.lead(f"first_{v}", j).over(along), none[v]) for j in range(1, k + 1)]), 1, k)

    sides = edges.select(
        "feature", "cell", "class", "size",
        earlier("x").alias("px"), earlier("c").alias("pc"), later("x").alias("nx"), later("c").alias("nc"),
    )
    near = sides.groupBy("feature", "cell").agg(
        F.collect_list(F.struct("class", "size", "px", "pc", "nx", "nc")).alias("near")
    )
    so_far = Window.partitionBy("feature").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("feature", "cell", F.coalesce(F.sum("total").over(so_far), F.lit(0)).alias("before"))
    return near.join(before, ["feature", "cell"])


def _scores(spark, cells: DataFrame, features: Sequence[str], edges: Sequence[list[float]], k: int) -> DataFrame:
    # one row per cell; read twice, for the sums and for the ends in other cells
    around, around_path = stored(_surroundings(cells, k))
    # stored tables are joined by their size on disk: a small one is broadcast, a large one shuffled
    measured = cells.drop("edges", "total").join(around, ["feature", "cell"])
    result, result_path = stored(
        measured.select(
            "feature", "cell", F.udf(_measurer(edges, k), _SUMS)("feature", "cell", "before", "classes", "x", "code", "c", "near").alias("r")
        ).select("feature", "cell", "r.*")
    )
    paths = [around_path, result_path]
    try:
        far = result.select("feature", F.col("cell").alias("home"), F.inline("far"))
        # an interval that leaves its cell covers the cell's bound, and at most 2k
        # intervals of a class cover any value: few ends ask a cell
        asked = far.groupBy("feature", F.col("at").alias("cell")).agg(F.collect_list(F.struct("home", "class", "x", "weight", "known", "value", "upper")).alias("asked"))
        asked, asked_path = stored(asked.join(around.select("feature", "cell", "before"), ["feature", "cell"]))
        paths.append(asked_path)
        answer = "home int, class int, x double, weight bigint, part bigint, known bigint"
        parts = cells.select("feature", "cell", "x", "c").join(asked, ["feature", "cell"]).select(
            "feature", F.inline(F.udf(_answerer(), f"array<struct<{answer}>>")("before", "x", "c", "asked"))
        )
        both = parts.groupBy("feature", "home", "class", "x").agg(
            F.first("weight").alias("weight"), (F.sum("part") + F.first("known")).alias("m")
        )
        others = both.groupBy("feature").agg(F.sum(F.col("weight") * digamma(F.col("m"))).alias("others"))
        sums = result.groupBy("feature").agg(*[F.sum(n).alias(n) for n in ("weight", "reach", "size", "near")])
        w = F.col("weight")
        score = digamma(w) + (F.col("reach") - F.col("size") - F.col("near") - F.coalesce("others", F.lit(0.0))) / w
        rows = sums.join(others, "feature", "left").select("feature", F.greatest(F.lit(0.0), score).alias("score")).collect()
    finally:
        discard(spark, *paths)
    return spark.createDataFrame([(features[r["feature"]], r["score"]) for r in rows], "feature string, score double")


def _measurer(edges: Sequence[list[float]], k: int) -> Callable:
    """Sums over a cell's points, and the interval ends that lie in other cells."""
    bounds = [np.array(e) for e in edges]
    tie_share, euler, exact = _TIE, _EULER, _EXACT_UP_TO

    def psi(n):
        x = np.asarray(n, dtype="f8")
        i2 = 1.0 / (x * x)
        series = np.log(x) - 0.5 / x - i2 / 12 + i2 * i2 / 120 - i2 * i2 * i2 / 252
        table = np.concatenate([[np.nan], np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, exact))]) - euler])
        return np.where(x <= exact, table[np.clip(x, 0, exact).astype("i8")], series)

    def kth_distance(xs, cs, at, reach):
        """Least span that takes i values to the left and j to the right and covers ``reach`` points."""
        here, best = cs[at] - 1, np.full(len(at), np.inf)
        left = np.zeros(len(at), "i8")
        for i in range(k + 1):
            if i:
                left = left + cs[at - i]
            right = np.zeros(len(at), "i8")
            for j in range(k + 1 - i):
                if j:
                    right = right + cs[at + j]
                span = np.maximum(xs[at] - xs[at - i], xs[at + j] - xs[at])
                best = np.where(here + left + right >= reach, np.minimum(best, span), best)
        return best

    def measure(feature, cell, before, classes, x, code, c, near):
        x, code, c = np.frombuffer(x, "<f8"), np.frombuffer(code, "<i4"), np.frombuffer(c, "<i8")
        upto = np.concatenate([[0], np.cumsum(c)]) + before
        inner = bounds[feature]
        low = inner[cell - 1] if cell else -np.inf
        high = inner[cell] if cell < len(inner) else np.inf
        sums, far = [0, 0.0, 0.0, 0.0], []
        known = {n["class"]: n for n in near}
        for i, name in enumerate(classes):
            side = known[name]
            at = np.flatnonzero(code == i)
            pad = [k - len(side["px"]), k - len(side["nx"])]
            xs = np.concatenate([np.full(pad[0], -np.inf), side["px"], x[at], side["nx"], np.full(pad[1], np.inf)])
            cs = np.concatenate([np.zeros(pad[0]), side["pc"], c[at], side["nc"], np.zeros(pad[1])]).astype("i8")
            mid, w, reach = np.arange(k, k + len(at)), c[at], min(k, side["size"] - 1)
            own = x[at]
            d = kth_distance(xs, cs, mid, reach)
            r = np.maximum(d - tie_share * (np.abs(own) + d), 0.0)
            lo, hi = own - r, own + r
            below, above = upto[np.searchsorted(x, lo, "left")], upto[np.searchsorted(x, hi, "right")]
            out_low, out_high = lo < low, hi >= high
            here = ~(out_low | out_high)
            sums[0] += int(w.sum())
            sums[1] += float(w.sum() * psi(reach))
            sums[2] += float(w.sum() * psi(side["size"]))
            sums[3] += float((w[here] * psi((above - below)[here])).sum())
            for p in np.flatnonzero(~here):
                part = (0 if out_high[p] else int(above[p])) - (0 if out_low[p] else int(below[p]))
                for out, end, upper in ((out_low[p], lo[p], False), (out_high[p], hi[p], True)):
                    if out:
                        to = int(np.searchsorted(inner, end, "right"))
                        far.append((i, float(own[p]), int(w[p]), part, to, float(end), upper))
        return (*sums, far)

    return measure


def _answerer() -> Callable:
    """Rows up to (upper) or below each asked value, the latter negative."""

    def answer(before, x, c, asked):
        x, c = np.frombuffer(x, "<f8"), np.frombuffer(c, "<i8")
        upto = np.concatenate([[0], np.cumsum(c)]) + before
        out = []
        for a in asked:
            rows = int(upto[np.searchsorted(x, a["value"], "right" if a["upper"] else "left")])
            out.append((a["home"], a["class"], a["x"], a["weight"], rows if a["upper"] else -rows, a["known"]))
        return out

    return answer
