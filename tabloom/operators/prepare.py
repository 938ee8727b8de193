"""Impute, scale and encode with statistics learned on the training side only.

Each operator is an Estimator whose model is a plain expression or a lookup
table. ``Preparer`` fits many blocks of columns together: moments of all
numeric columns in one aggregate, all value counts in one long pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import CountVectorizerModel, OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.hashing import md5_bucket_sql
from tabloom.operators.aggregate import long_form, wide_stats
from tabloom.operators.learned import ColumnExpressions, LookupModel, sql_literal, sql_name
from tabloom.operators.quantiles import exact_quantiles
from tabloom.session import durable

PREFIX = "p__"
INFREQUENT = "__infrequent__"
#: Up to so many values a column's labels are kept as a list with the model, beyond that as a table.
MAX_LABELS = 100_000


# ---------------------------------------------------------------- statistics


def value_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, k): row count of every value as text, missing included."""
    return long_form(df, columns).groupBy("column", "value").agg(F.count("*").alias("k"))


def most_frequent(values: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(column, value): commonest value per column as text, ties to the smallest.

    A minimum over (count, value) keeps this a combining aggregate; no column's
    values are sorted in one task. Whole numbers beyond the range in which
    doubles are exact are told apart as decimals.
    """
    of_number = F.col("column").isin(list(numeric))
    number = F.when(of_number, F.col("value").try_cast("double"))
    whole = F.when(of_number, F.col("value").try_cast("decimal(38,0)"))
    return (
        values.filter(F.col("value").isNotNull())
        .groupBy("column")
        .agg(F.min(F.struct(-F.col("k"), number, whole, F.col("value"))).alias("m"))
        .select("column", F.col("m.value").alias("value"))
    )


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int, float, float]]:
    """column -> (rows, non-missing, mean, population variance)."""
    stats = wide_stats(
        df,
        columns,
        {
            "rows": lambda c: F.count("*"),
            "n": lambda c: F.count(c),
            "mean": lambda c: F.avg(F.col(c).cast("double")),
            "var": lambda c: F.var_pop(F.col(c).cast("double")),
        },
    )
    return {r["column"]: (r["rows"], r["n"], r["mean"], r["var"]) for r in stats.collect()}


def _filled_moments(m: tuple, fill: float | None) -> tuple[float, float]:
    """Mean and population variance once the gaps hold ``fill``."""
    rows, n, mean, var = m
    if not n:
        return (fill or 0.0, 0.0)
    if fill is None or rows == n:
        return (mean, var)
    gaps = rows - n
    total = (n * mean + gaps * fill) / rows
    return total, (n * (var + (mean - total) ** 2) + gaps * (fill - total) ** 2) / rows


def _numeric_names(df: DataFrame, columns: Sequence[str]) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in columns if isinstance(kinds[c], (T.NumericType, T.BooleanType))]


@dataclass(frozen=True)
class Fill:
    """What the gaps of a column get: SQL in the type it is filled in, and its number if it has one."""

    sql: str
    number: float | None = None


def _as_kind(text: str, kind: T.DataType) -> str:
    return f"CAST({sql_literal(text)} AS {kind.simpleString()})"


def _constant(value, kind: T.DataType) -> Fill:
    """A constant in the column's own type where that holds it, else as it is."""
    if isinstance(value, str):
        return Fill(_as_kind(value, kind) if isinstance(kind, T.StringType) else sql_literal(value))
    number = float(value)
    if isinstance(kind, T.BooleanType) and number in (0.0, 1.0):
        return Fill(sql_literal(bool(number)), number)
    if isinstance(kind, T.IntegralType) and number.is_integer():
        return Fill(_as_kind(str(int(number)), kind), number)
    return Fill(sql_literal(number if isinstance(kind, T.NumericType) else value), number)


def _fills(
    df: DataFrame, columns: Sequence[str], strategy: str, constant, values: DataFrame | None = None
) -> dict[str, Fill]:
    """column -> what its gaps get; a commonest value keeps the type of its column."""
    numeric = set(_numeric_names(df, columns))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if strategy == "constant":
        default = {c: 0.0 if c in numeric else "missing_value" for c in columns}
        return {c: _constant(default[c] if constant is None else constant, kinds[c]) for c in columns}
    if strategy == "mean":
        found = {c: m[2] for c, m in moments(df, columns).items()}
    elif strategy == "median":
        found = {r["column"]: r["value"] for r in exact_quantiles(df, columns, [0.5]).collect()}
    elif strategy == "most_frequent":
        counted = value_table(df, columns) if values is None else values.filter(F.col("column").isin(list(columns)))
        rows = most_frequent(counted, sorted(numeric)).collect()
        return {r["column"]: Fill(_as_kind(r["value"], kinds[r["column"]]), _number(r["value"])) for r in rows}
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return {c: Fill(sql_literal(float(v)), float(v)) for c, v in found.items() if v is not None}


def _number(text: str) -> float | None:
    if text in ("true", "false"):
        return float(text == "true")
    try:
        return float(text)
    except ValueError:
        return None


def _filled(df: DataFrame, c: str, fill: Fill | None) -> str:
    """SQL of a column with its gaps filled; a boolean that gets a number becomes one."""
    if fill is None:
        return sql_name(c)
    number = isinstance(df.schema[c].dataType, T.BooleanType) and fill.sql not in ("true", "false") and not fill.sql.startswith("CAST")
    own = f"CAST({sql_name(c)} AS DOUBLE)" if number and fill.number is not None else sql_name(c)
    return f"coalesce({own}, {fill.sql})"


def _spelled(df: DataFrame, c: str, fill: Fill | None = None) -> str:
    """SQL of a column as text, spelled as ``value_table`` spells it, gaps filled."""
    kind = df.schema[c].dataType
    own = sql_name(c)
    if isinstance(kind, T.DoubleType):
        own = f"({own} + 0D)"
    elif isinstance(kind, T.FloatType):
        own = f"({own} + CAST(0 AS FLOAT))"
    text = f"CAST({own} AS STRING)"
    return text if fill is None else f"coalesce({text}, CAST({fill.sql} AS STRING))"


def _filled_values(values: DataFrame, fills: Mapping[str, Fill]) -> DataFrame:
    """Counted values once the gaps are filled."""
    fills = {c: f for c, f in fills.items() if f is not None}
    if not fills:
        return values
    spelled = F.create_map(*[x for c, f in fills.items() for x in (F.lit(c), F.expr(f"CAST({f.sql} AS STRING)"))])
    filled = values.withColumn("value", F.coalesce("value", spelled[F.col("column")]))
    return filled.groupBy("column", "value").agg(F.sum("k").alias("k"))


# ---------------------------------------------------------------- estimators


class _Columns(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    inputCols = Param(Params._dummy(), "inputCols", "columns read", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "columns written, by default over the inputs", TypeConverters.toListString)

    def _pairs(self) -> list[tuple[str, str]]:
        ins = self.getOrDefault(self.inputCols)
        outs = self.getOrDefault(self.outputCols) if self.isDefined(self.outputCols) else ins
        return list(zip(ins, outs))


class Imputing(_Columns):
    """Fills gaps by mean, median, most frequent value or a constant."""

    strategy = Param(Params._dummy(), "strategy", "mean, median, most_frequent or constant", TypeConverters.toString)
    fillValue = Param(Params._dummy(), "fillValue", "value of the constant strategy", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, strategy="mean", fillValue=None):
        super().__init__()
        self._setDefault(strategy="mean", fillValue=None)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ColumnExpressions:
        pairs = self._pairs()
        fills = _fills(
            dataset, [i for i, _ in pairs], self.getOrDefault(self.strategy), self.getOrDefault(self.fillValue)
        )
        return ColumnExpressions(
            outputs=[o for _, o in pairs],
            expressions=[_filled(dataset, i, fills.get(i)) for i, _ in pairs],
        )


class Scaling(_Columns):
    """(x - centre) / spread: mean and population deviation, or median and quartile range."""

    kind = Param(Params._dummy(), "kind", "standard or robust", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, kind="standard"):
        super().__init__()
        self._setDefault(kind="standard")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ColumnExpressions:
        pairs = self._pairs()
        ins = [i for i, _ in pairs]
        if self.getOrDefault(self.kind) == "standard":
            learned = {c: (m[2] or 0.0, (m[3] or 0.0) ** 0.5) for c, m in moments(dataset, ins).items()}
        else:
            learned = robust_spread(dataset, ins)
        return ColumnExpressions(
            outputs=[o for _, o in pairs],
            expressions=[scaled(sql_name(i), *learned.get(i, (0.0, 1.0))) for i, _ in pairs],
        )


def robust_spread(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """column -> (median, quartile range)."""
    got: dict[str, dict[float, float]] = {}
    for r in exact_quantiles(df, columns, [0.25, 0.5, 0.75]).collect():
        got.setdefault(r["column"], {})[r["prob"]] = r["value"]
    return {c: (q[0.5], q[0.75] - q[0.25]) for c, q in got.items()}


def scaled(x: str, centre: float, spread: float) -> str:
    """SQL of the scaled value; a zero spread divides by one."""
    return f"(CAST({x} AS DOUBLE) - {sql_literal(float(centre))}) / {sql_literal(float(spread) or 1.0)}"


class FrequencyEncoding(_Columns):
    """Value -> row count, or share of the rows with rare values forgotten; unseen -> 0."""

    share = Param(Params._dummy(), "share", "encode by share instead of count", TypeConverters.toBoolean)
    minShare = Param(Params._dummy(), "minShare", "shares below this are forgotten", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, share=False, minShare=0.001):
        super().__init__()
        self._setDefault(share=False, minShare=0.001)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> LookupModel:
        pairs = self._pairs()
        values = value_table(dataset, [i for i, _ in pairs])
        share, least = self.getOrDefault(self.share), self.getOrDefault(self.minShare)
        return frequency_model(values, pairs, share, least)


def frequency_model(values: DataFrame, pairs: Sequence[tuple[str, str]], share: bool, least: float) -> LookupModel:
    if share:
        text = values.withColumn("value", F.coalesce("value", F.lit("nan")))
        merged = text.groupBy("column", "value").agg(F.sum("k").alias("k"))
        totals = merged.groupBy("column").agg(F.sum("k").alias("n"))
        # one row per encoded column
        table = (
            merged.join(F.broadcast(totals), "column")
            .withColumn("stat", F.col("k") / F.col("n"))
            .filter(F.col("stat") >= least)
            .select("column", "value", "stat", "k")
        )
    else:
        table = values.filter(F.col("value").isNotNull()).select(
            "column", "value", F.col("k").cast("double").alias("stat"), "k"
        )
    return LookupModel.of(
        table.persist(), [i for i, _ in pairs], [o for _, o in pairs], 0.0, "nan" if share else None
    )


class PresenceEncoding(_Columns):
    """1.0 where a value exists, else 0.0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ColumnExpressions:
        pairs = self._pairs()
        return ColumnExpressions(outputs=[o for _, o in pairs], expressions=[_present(i) for i, _ in pairs])


def _present(c: str) -> str:
    return f"CAST({sql_name(c)} IS NOT NULL AS DOUBLE)"


class HashEncoding(_Columns):
    """Values of several columns counted into shared md5 buckets; the output is one vector."""

    buckets = Param(Params._dummy(), "buckets", "number of counters", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, buckets=32):
        super().__init__()
        self._setDefault(buckets=32)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        out = self.getOrDefault(self.outputCols)[0]
        return PipelineModel(hash_stages(self.getOrDefault(self.inputCols), out, self.getOrDefault(self.buckets)))


def hash_stages(columns: Sequence[str], output: str, buckets: int) -> list:
    """Values become bucket numbers, and a row's buckets are counted into a sparse vector.

    One expression per counter would outgrow what the JVM compiles; the counting
    stage works in time proportional to the number of columns.
    """
    words = ", ".join(
        f"CAST({md5_bucket_sql(f"coalesce(CAST({sql_name(c)} AS STRING), 'nan')", buckets)} AS STRING)" for c in columns
    )
    return [
        ColumnExpressions(outputs=[f"{output}__b"], expressions=[f"array({words})"]),
        CountVectorizerModel.from_vocabulary([str(i) for i in range(buckets)], f"{output}__b", output),
    ]


class OneHotEncoding(_Columns):
    """Sorted categories to 0/1 vectors; unseen or missing values give all zeros.

    ``maxCategories`` pools the rarer values of a wider column into one slot;
    ``dropIfBinary`` keeps one slot for a two-valued column.
    """

    maxCategories = Param(Params._dummy(), "maxCategories", "slots per column, 0 for no limit", TypeConverters.toInt)
    dropIfBinary = Param(Params._dummy(), "dropIfBinary", "one slot for two values", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, maxCategories=0, dropIfBinary=False):
        super().__init__()
        self._setDefault(maxCategories=0, dropIfBinary=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        pairs = self._pairs()
        values = value_table(dataset, [i for i, _ in pairs]).persist()
        pooled, drop = self.getOrDefault(self.maxCategories), self.getOrDefault(self.dropIfBinary)
        return PipelineModel(one_hot_stages(values, pairs, {}, pooled, drop, dataset))


class OrdinalEncoding(_Columns):
    """Sorted distinct values to 0..k-1; unseen or missing to -1."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        pairs = self._pairs()
        values = value_table(dataset, [i for i, _ in pairs]).persist()
        spelled = {i: _spelled(dataset, i) for i, _ in pairs}
        try:
            return PipelineModel(ordinal_stages(values, pairs, _sort_types(dataset), spelled))
        finally:
            values.unpersist()


def _sort_types(df: DataFrame) -> list[str]:
    """Columns whose labels sort as numbers; booleans sort as their text does."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def collect_labels(values: DataFrame, numeric: Sequence[str]) -> dict[str, list[str]]:
    """column -> its sorted values as text: the slots of the encoded vector.

    For columns within ``MAX_LABELS``; the others are told by ``wide_columns``.
    """
    known = values.filter(F.col("value").isNotNull())
    labels: dict[str, list[str]] = {}
    for r in known.select("column", "value").collect():
        labels.setdefault(r["column"], []).append(r["value"])
    order = set(numeric)
    return {c: sorted(v, key=_by_number if c in order else str) for c, v in labels.items()}


def wide_columns(values: DataFrame) -> dict[str, int]:
    """column -> number of values, of the columns with more than ``MAX_LABELS``."""
    sizes = values.filter(F.col("value").isNotNull()).groupBy("column").agg(F.count("*").alias("n"))
    return {r["column"]: r["n"] for r in sizes.filter(F.col("n") > MAX_LABELS).collect()}


def code_table(values: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(column, value, stat, k): the 0-based place of every value in its column's order.

    Values are sorted in ranges; a place is the row's place in its range and the
    counted rows of the ranges before it, so no column is held by one task.
    """
    of_number = F.col("column").isin(list(numeric))
    order = [F.col("column"), F.when(of_number, F.col("value").try_cast("double")).asc_nulls_last()]
    order += [F.when(of_number, F.col("value").try_cast("decimal(38,0)")), F.col("value")]
    known = values.filter(F.col("value").isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(known.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    runs = placed.groupBy("column", part.alias("__part")).agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before, starts = {}, []
    # one row per column and range
    for r in sorted(runs.collect(), key=lambda r: (r["column"], r["__part"])):
        starts.append((r["column"], r["__part"], before.get(r["column"], 0) - r["first"]))
        before[r["column"]] = before.get(r["column"], 0) + r["n"]
    shift = values.sparkSession.createDataFrame(starts, "column string, __part bigint, __shift bigint")
    found = placed.withColumn("__part", part).join(F.broadcast(shift), ["column", "__part"])
    return found.select("column", "value", (F.col("__at") + F.col("__shift")).cast("double").alias("stat"), "k")


def _looked_up(values: DataFrame, wide: Sequence[str], numeric: Sequence[str], text: Mapping[str, str], out: Mapping[str, str], default: float):
    """Stage that looks the codes of wide columns up in a table."""
    codes = code_table(values.filter(F.col("column").isin(list(wide))), numeric)
    renamed = F.create_map(*[F.lit(x) for c in wide for x in (c, text[c])])
    table = codes.withColumn("column", renamed[F.col("column")]).persist()
    return LookupModel.of(table, [text[c] for c in wide], [out[c] for c in wide], default)


def _by_number(text: str) -> tuple:
    """Numbers by size, whole ones exactly; a text that fills gaps comes last."""
    try:
        return (0, int(text) if text.lstrip("-").isdigit() else float(text), "")
    except ValueError:
        return (1, 0, text)


def _indexers(labels, inputs: Sequence[str], outputs: Sequence[str]) -> list[StringIndexerModel]:
    """One indexer per column: the several-column form pads shorter label lists."""
    return [
        StringIndexerModel.from_labels(own or [INFREQUENT], i, o, "keep")
        for own, i, o in zip(labels, inputs, outputs)
    ]


def ordinal_stages(values: DataFrame, pairs, numeric: Sequence[str], spelled: Mapping[str, str]) -> list:
    """Stages turning columns into codes, from counted values; ``spelled`` has the SQL of each column's text."""
    wide = wide_columns(values)
    narrow = [(i, o) for i, o in pairs if i not in wide]
    stages = _listed_codes(narrow, collect_labels(values.filter(~F.col("column").isin(list(wide))), numeric), spelled) if narrow else []
    if wide:
        text, out = {i: f"{o}__tx" for i, o in pairs if i in wide}, dict(pairs)
        stages.append(ColumnExpressions(outputs=list(text.values()), expressions=[spelled[i] for i in text]))
        stages.append(_looked_up(values, list(text), numeric, text, out, -1.0))
    return stages


def _listed_codes(pairs, labels: Mapping[str, list[str]], spelled: Mapping[str, str]) -> list:
    indexed = [f"{o}__ix" for _, o in pairs]
    text = [f"{o}__tx" for _, o in pairs]
    return [
        ColumnExpressions(outputs=text, expressions=[spelled[i] for i, _ in pairs]),
        *_indexers([labels.get(i) for i, _ in pairs], text, indexed),
        ColumnExpressions(
            outputs=[o for _, o in pairs],
            expressions=[
                f"CASE WHEN {sql_name(x)} = {len(labels.get(i) or [INFREQUENT])} THEN -1D ELSE {sql_name(x)} END"
                for (i, _), x in zip(pairs, indexed)
            ],
        ),
    ]


def one_hot_stages(values, pairs, fills: Mapping, max_categories: int, drop_binary: bool, df: DataFrame) -> list:
    """Stages turning columns into one-hot vectors, from counted values."""
    names = [i for i, _ in pairs]
    own = _filled_values(values.filter(F.col("column").isin(names)), fills)
    own = own.filter(F.col("value").isNotNull())
    wide: set[str] = set()
    if max_categories:
        sizes = own.groupBy("column").agg(F.count("*").alias("n")).filter(F.col("n") > max_categories)
        wide = {r["column"] for r in sizes.collect()}

    stages: list = []
    text = {i: f"{o}__tx" for i, o in pairs}
    as_text = [_spelled(df, i, fills.get(i)) for i, _ in pairs]
    stages.append(ColumnExpressions(outputs=list(text.values()), expressions=as_text))
    if wide:
        # the kept values per column are few; the rest share one slot
        rank = Window.partitionBy("column").orderBy(F.desc("k"), "value")
        kept = (
            own.filter(F.col("column").isin(sorted(wide)))
            .withColumn("r", F.row_number().over(rank))
            .filter(F.col("r") < max_categories)
            .select("column", "value", F.lit(True).alias("kept"))
        )
        # under maxCategories rows per column
        labelled = own.filter(F.col("column").isin(sorted(wide))).join(F.broadcast(kept), ["column", "value"], "left")
        label = F.when(F.col("kept"), F.col("value")).otherwise(INFREQUENT)
        table = labelled.select(F.col("column"), "value", label.alias("stat"), "k")
        renamed = F.create_map(*[x for c in sorted(wide) for x in (F.lit(c), F.lit(text[c]))])
        table = table.withColumn("column", renamed[F.col("column")]).persist()
        stages.append(LookupModel.of(table, [text[c] for c in sorted(wide)], [text[c] for c in sorted(wide)]))
        narrow = own.filter(~F.col("column").isin(sorted(wide)))
        labels = collect_labels(narrow, _sort_types(df))
        labels.update({c: v + [INFREQUENT] for c, v in collect_labels(kept, _sort_types(df)).items()})
    else:
        vast = wide_columns(own)
        labels = collect_labels(own.filter(~F.col("column").isin(list(vast))), _sort_types(df))
        if vast:
            # slots without names: the vector is wider than a list of names should be
            out = {i: f"{o}__ix" for i, o in pairs if i in vast}
            for c, n in vast.items():
                stages.append(_looked_up(own, [c], _sort_types(df), text, out, float(n)))
            last = df.sparkSession.createDataFrame([tuple(float(vast[c] - 1) for c in out)], list(out.values()))
            slots = OneHotEncoder(
                inputCols=list(out.values()), outputCols=[dict(pairs)[c] for c in out], dropLast=True, handleInvalid="keep"
            )
            stages.append(slots.fit(last))
            pairs = [(i, o) for i, o in pairs if i not in vast]

    two = [(i, o) for i, o in pairs if drop_binary and len(labels.get(i, [])) == 2]
    many = [(i, o) for i, o in pairs if (i, o) not in two]
    if two:
        stages.append(
            ColumnExpressions(
                outputs=[o for _, o in two],
                expressions=[
                    f"CAST({sql_name(text[i])} <=> {sql_literal(labels[i][1])} AS DOUBLE)" for i, _ in two
                ],
            )
        )
    if many:
        indexed = [f"{o}__ix" for _, o in many]
        stages += _indexers([labels.get(i) for i, _ in many], [text[i] for i, _ in many], indexed)
        # the extra slot for unseen values is last, and dropped
        encoder = OneHotEncoder(inputCols=indexed, outputCols=[o for _, o in many], dropLast=True)
        stages.append(encoder.fit(PipelineModel(stages).transform(df.limit(0))))
    return stages


# ---------------------------------------------------------------- column transformer


@dataclass(frozen=True)
class Block:
    """Columns sharing one chain: impute, then scale, then encode."""

    name: str
    columns: Sequence[str]
    impute: str | None = None
    fill: object = None
    scale: str | None = None
    encode: str | None = None  # onehot, ordinal, frequency, share, presence, hash
    max_categories: int = 0
    drop_binary: bool = False
    buckets: int = 32
    min_share: float = 0.001


class Preparer:
    """Blocks of columns side by side in one feature vector; other columns stay as they are."""

    def __init__(self, blocks: Sequence[Block], output: str = "features"):
        self.blocks = [b for b in blocks if b.columns]
        self.output = output

    def trimmed(self, columns: Sequence[str]) -> "Preparer":
        """The same blocks, less the columns a table does not have."""
        have = set(columns)
        return Preparer(
            [Block(**{**b.__dict__, "columns": [c for c in b.columns if c in have]}) for b in self.blocks],
            self.output,
        )

    def fit(self, df: DataFrame) -> PipelineModel:
        by_value = [b for b in self.blocks if b.encode in ("onehot", "ordinal", "frequency", "share")]
        counted = sorted({c for b in by_value for c in b.columns})
        values = value_table(df, counted).persist() if counted else None
        try:
            return PipelineModel(self._stages(df, values))
        finally:
            # lookup stages keep their own table
            if values is not None:
                values.unpersist()

    def _stages(self, df: DataFrame, values: DataFrame | None) -> list:
        fills = self._all_fills(df, values)
        measured = sorted({c for b in self.blocks if b.scale == "standard" for c in b.columns})
        stats = moments(df, measured) if measured else {}
        stages, assembled = [], []
        simple: dict[str, str] = {}
        for b in self.blocks:
            pairs = [(c, PREFIX + c) for c in b.columns]
            gap = fills[b.name]
            if b.encode == "presence":
                simple.update({o: _present(c) for c, o in pairs})
                assembled += [o for _, o in pairs]
            elif b.encode == "hash":
                out = f"{PREFIX}{b.name}_hash"
                stages += hash_stages(b.columns, out, b.buckets)
                assembled.append(out)
            elif b.encode in ("frequency", "share"):
                own = values.filter(F.col("column").isin(list(b.columns)))
                stages.append(frequency_model(own, pairs, b.encode == "share", b.min_share))
                assembled += [o for _, o in pairs]
            elif b.encode == "onehot":
                stages += one_hot_stages(values, pairs, gap, b.max_categories, b.drop_binary, df)
                assembled += [o for _, o in pairs]
            elif b.encode == "ordinal":
                own = _filled_values(values.filter(F.col("column").isin(list(b.columns))), gap)
                stages += ordinal_stages(own, pairs, _sort_types(df), {c: _spelled(df, c, gap.get(c)) for c in b.columns})
                assembled += [o for _, o in pairs]
            else:
                simple.update(self._measures(df, b, pairs, gap, stats))
                assembled += [o for _, o in pairs]
        first = [ColumnExpressions(outputs=list(simple), expressions=list(simple.values()))] if simple else []
        assembler = VectorAssembler(inputCols=assembled, outputCol=self.output)
        return [*first, *stages, assembler]

    def _all_fills(self, df: DataFrame, values: DataFrame | None) -> dict[str, dict]:
        """Fill values of all blocks, each statistic gathered once for every block needing it."""

        def shared(b: Block) -> tuple:
            counted = b.impute == "most_frequent" and b.encode in ("onehot", "ordinal")
            return (b.impute, repr(b.fill), counted)

        wanted: dict[tuple, list[str]] = {}
        for b in self.blocks:
            if b.impute:
                wanted.setdefault(shared(b), []).extend(b.columns)
        got = {}
        for b in self.blocks:
            key = shared(b)
            if b.impute and key not in got:
                known = values if key[-1] else None
                got[key] = _fills(df, list(dict.fromkeys(wanted[key])), b.impute, b.fill, known)
        return {b.name: {c: got[shared(b)].get(c) for c in b.columns} if b.impute else {} for b in self.blocks}

    @staticmethod
    def _measures(df, b: Block, pairs, gap: Mapping, stats: Mapping) -> dict[str, str]:
        if b.scale == "standard":
            out = {}
            for c, o in pairs:
                fill = gap.get(c)
                centre, var = _filled_moments(stats[c], fill.number if fill else None)
                out[o] = scaled(_filled(df, c, fill), centre, var**0.5)
            return out
        if b.scale == "robust":
            filled = df.select(*[F.expr(_filled(df, c, gap.get(c))).alias(c) for c, _ in pairs])
            learned = robust_spread(filled, [c for c, _ in pairs])
            return {o: scaled(_filled(df, c, gap.get(c)), *learned.get(c, (0.0, 1.0))) for c, o in pairs}
        return {o: f"CAST({_filled(df, c, gap.get(c))} AS DOUBLE)" for c, o in pairs}


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Slot names of a vector column; one-hot slots are ``column_value``, hashed ones ``block_hash_i``."""
    attrs = df.schema[column].metadata.get("ml_attr", {})
    named = {a["idx"]: a["name"] for kind in attrs.get("attrs", {}).values() for a in kind if "name" in a}
    size = attrs.get("num_attrs", len(named))
    if len(named) != size:
        return [f"feature_{i}" for i in range(size)]
    return [named[i].replace(PREFIX, "", 1) if named[i].startswith(PREFIX) else named[i] for i in range(size)]


def explain_prepare(preparer: Preparer, df: DataFrame) -> DataFrame:
    """Fit and run every block's stages one at a time.

    Returns (block, step, stage, output, type, rows, missing, error); a block
    stops at its first failing stage.
    """
    found = []
    for b in preparer.blocks:
        step = 0
        try:
            stages = Preparer([b], preparer.output).fit(df).stages
            current = df.select(*dict.fromkeys(b.columns))
            for step, stage in enumerate(stages):
                before = set(current.columns)
                current = stage.transform(current)
                made = [c for c in current.columns if c not in before] or [preparer.output]
                sizes = current.agg(F.count("*"), *[F.count_if(F.col(c).isNull()) for c in made if c in current.columns]).first()
                kinds = dict(current.dtypes)
                for c, missing in zip(made, sizes[1:]):
                    found.append((b.name, step, type(stage).__name__, c, kinds[c], sizes[0], missing, None))
        except Exception as e:  # the point of a diagnosis is to report it
            found.append((b.name, step, "failed", None, None, None, None, str(e).splitlines()[0]))
    schema = "block string, step int, stage string, output string, type string, rows long, missing long, error string"
    return df.sparkSession.createDataFrame(found, schema)
