"""Session settings the operators rely on."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_CHUNK = "tagloom.rowsPerChunk"
BROADCAST_ROWS = "tagloom.broadcastRows"

_DEFAULTS = {ROWS_PER_CHUNK: 500_000, BROADCAST_ROWS: 200_000}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators assume."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # sheets and tag files come in Japanese encodings, which Spark otherwise refuses
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    _ship_package(spark)
    return spark


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tagloom-package-")) / package.name
    archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def setting(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, str(_DEFAULTS[key])))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder every executor can reach.

    Clusters name their shared folder in ``spark.checkpoint.dir``.  A machine-local
    folder is used only by a local session that names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return tempfile.mkdtemp(prefix="tagloom-")
    run_id = spark.range(1).selectExpr("uuid()").first()[0]
    return f"{base.rstrip('/')}/tagloom-{run_id}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Cuts the lineage at a point that outlives executors and stays columnar, so later
    steps still prune columns.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
