"""Queries over the driver tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Checked:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Checked] = {}


def checked(sql: str | None = None) -> Callable:
    """Register a query under its function name."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if fn.__name__ in REGISTRY:
            raise ValueError(f"duplicate query {fn.__name__}")
        REGISTRY[fn.__name__] = Checked(fn, sql)
        return fn

    return register


def load_all() -> dict[str, Checked]:
    from tabloom.plans.checked import (  # noqa: F401
        column_queries,
        evaluation_queries,
        feature_queries,
        model_queries,
        preparation_queries,
        profile_queries,
        sampling_queries,
        screening_queries,
    )

    return REGISTRY
