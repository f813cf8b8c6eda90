"""Run a stream over everything available now and return what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time of the row that ends an input.
_END = "9999-01-01 00:00:00"


def with_end(stream: DataFrame, ts: str = "ts") -> tuple[DataFrame, Callable[[], None]]:
    """The stream together with a folder that is empty at first, and a function that puts an end row into it.

    The end row's time lies behind all others.  It moves the watermark, so that state waiting for it is released, and
    is dropped by operators that ask for times before the year 9000.
    """
    spark = stream.sparkSession
    folder = shared_dir(spark) + "/end"
    row = spark.range(1).select(*[(F.lit(_END) if c == ts else F.lit(None)).cast(stream.schema[c].dataType).alias(c) for c in stream.columns])
    row.where("1 = 0").write.mode("append").parquet(folder)
    marks = spark.readStream.schema(stream.schema).parquet(folder)
    return stream.unionByName(marks), lambda: row.write.mode("append").parquet(folder)


def run_available(stream: DataFrame, end: Callable[[], None] | None = None) -> DataFrame:
    """Process all input in as many micro-batches as the source's limits ask for; then, with ``end``, the end of the input."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = shared_dir(spark)

    def run() -> None:
        query = (
            stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run()
    if end:
        end()
        run()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
