"""Standard scaling with the population deviation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """Means and deviations per column; a constant column is only centred."""

    mean: dict[str, float]
    std: dict[str, float]

    def column(self, c: str) -> Column:
        return (F.col(c).cast("double") - F.lit(self.mean[c])) / F.lit(self.std[c] or 1.0)

    def transform(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in (columns or self.mean)})


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    stats = [F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"c{i}") for i, c in enumerate(columns)]
    row = df.agg(*stats).first()
    pairs = {c: row[f"c{i}"] for i, c in enumerate(columns)}
    return Scaler({c: p["m"] or 0.0 for c, p in pairs.items()}, {c: p["s"] or 0.0 for c, p in pairs.items()})


def standardize(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Scale with statistics of ``train`` (default: of the data itself)."""
    return fit_scaler(df if train is None else train, columns).transform(df, columns)
