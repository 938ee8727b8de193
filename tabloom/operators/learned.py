"""Fitted stages: what was learned is text (expressions) or a table (lookups)."""

from __future__ import annotations

import math
from datetime import date

from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.lookup import is_small

# By the pigeonhole rule fewer than this many values can each hold over 1/1000 of the rows.
_HOT_PARTS = 1000
_SPREAD = 4096


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_literal(value) -> str:
    """A Python value as a Spark SQL literal that reads back exactly."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return f"double('{value}')"
        return f"{value!r}D"
    if isinstance(value, date):
        return f"DATE'{value.isoformat()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


class ColumnExpressions(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds columns given as SQL expressions; the learned numbers are literals in them."""

    outputs = Param(Params._dummy(), "outputs", "names of the columns added", TypeConverters.toListString)
    expressions = Param(Params._dummy(), "expressions", "one SQL expression per output", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, outputs=None, expressions=None):
        super().__init__()
        self._setDefault(outputs=[], expressions=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        pairs = zip(self.getOrDefault(self.outputs), self.getOrDefault(self.expressions))
        return dataset.withColumns({name: F.expr(e) for name, e in pairs})


class _LookupWriter(MLWriter):
    def __init__(self, model: "LookupModel"):
        super().__init__()
        self._model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self._model, path, self.sparkSession)
        self._model.table.write.parquet(f"{path}/table")


class _LookupReader(MLReader):
    def load(self, path: str) -> "LookupModel":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = LookupModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.table = self.sparkSession.read.parquet(f"{path}/table")
        return model


class LookupModel(Model, MLReadable, MLWritable):
    """Replaces values by a learned statistic; unseen or missing ones get the default.

    ``table`` has (column, value, stat, k): value as text, k its row count in
    the fit data. A table within the broadcast bound is broadcast. A larger one
    is joined by shuffle, except for its hot values: those holding over a
    thousandth of the rows, hence under a thousand of them, are broadcast, and
    their rows are spread over the shuffle by a key that matches nothing.
    """

    inputCols = Param(Params._dummy(), "inputCols", "columns looked up", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "statistic columns", TypeConverters.toListString)
    default = Param(Params._dummy(), "default", "statistic of unseen values", TypeConverters.identity)
    sentinel = Param(Params._dummy(), "sentinel", "text a missing value is looked up as", TypeConverters.identity)
    broadcastTable = Param(Params._dummy(), "broadcastTable", "the whole table was within bounds", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, default=None, sentinel=None, broadcastTable=None):
        super().__init__()
        self._setDefault(inputCols=[], outputCols=[], default=None, sentinel=None, broadcastTable=None)
        self._set(**self._input_kwargs)
        self.table: DataFrame | None = None

    @classmethod
    def of(cls, table: DataFrame, inputs, outputs, default=None, sentinel=None) -> "LookupModel":
        model = cls(
            inputCols=list(inputs),
            outputCols=list(outputs),
            default=default,
            sentinel=sentinel,
            broadcastTable=is_small(table, ["value"]),
        )
        model.table = table
        return model

    def write(self) -> MLWriter:
        return _LookupWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LookupReader()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        small = self.getOrDefault(self.broadcastTable)
        out = dataset
        for c, o in zip(self.getOrDefault(self.inputCols), self.getOrDefault(self.outputCols)):
            learned = self.table.filter(F.col("column") == c)
            out = self._one(out, learned, c, o, small)
        return out

    def _one(self, df: DataFrame, learned: DataFrame, c: str, o: str, small: bool) -> DataFrame:
        sentinel, default = self.getOrDefault(self.sentinel), self.getOrDefault(self.default)
        key = F.col(c).cast("string")
        if sentinel is not None:
            key = F.coalesce(key, F.lit(sentinel))
        keyed = df.withColumn("__key", key)
        if small:
            table = learned.select(F.col("value").alias("__key"), F.col("stat").alias("__stat"))
            found = keyed.join(F.broadcast(table), "__key", "left")
            stat = F.col("__stat")
        else:
            rows = learned.agg(F.sum("k")).scalar()
            hot = learned.filter(F.col("k") * _HOT_PARTS > rows).select(
                F.col("value").alias("__key"), F.col("stat").alias("__hot")
            )
            cold = learned.select(F.col("value").alias("__cold"), F.col("stat").alias("__stat"))
            nowhere = F.concat(F.lit("\u0000"), (F.monotonically_increasing_id() % _SPREAD).cast("string"))
            cold_key = F.when(F.col("__hot").isNull(), F.coalesce("__key", nowhere)).otherwise(nowhere)
            found = keyed.join(F.broadcast(hot), "__key", "left").withColumn("__cold", cold_key)
            found = found.join(cold, "__cold", "left").drop("__cold")
            stat = F.coalesce("__hot", "__stat")
        if default is not None:
            stat = F.coalesce(stat, F.lit(default))
        return found.withColumn(o, stat).select(*[x for x in df.columns if x != o], o)
