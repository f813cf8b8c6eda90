"""Sinks.  All write one file per partition; none gathers data on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS"
EXACT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_csv(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    where: Column | str | None = None,
    encoding: str = "UTF-8",
    mode: str = "error",
) -> None:
    """CSV with header, optionally only some columns or rows."""
    out = df if where is None else df.where(where)
    out = out.select(*columns) if columns else out
    writer = out.write.mode(mode).option("header", True).option("encoding", encoding)
    writer.option("timestampNTZFormat", EXACT).option("timestampFormat", EXACT).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error", timestamp_format: str = ISO) -> None:
    """One JSON record per row, ISO timestamps."""
    writer = df.write.mode(mode).option("timestampNTZFormat", timestamp_format)
    writer.option("timestampFormat", timestamp_format).json(path)


def write_report(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Several tables side by side, one directory each."""
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        if fmt == "csv":
            write_csv(df, target, mode=mode)
        else:
            df.write.mode(mode).format(fmt).save(target)
