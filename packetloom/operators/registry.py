"""Host ids that never change while data is appended.

The registry is a folder of one table per run. A run numbers the hosts that no other run has, above the
highest stored id, and replaces its own table only, so a run that is repeated, or a streaming batch that is
delivered twice, leaves the same registry.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.graph import first_seen
from packetloom.operators.ordering import positions

SCHEMA = "ip string, node_id bigint, batch bigint"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``ip``, ``node_id``, ``batch``; empty before the first run."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def register_hosts(df: DataFrame, path: str, batch: int) -> None:
    """Add the hosts of one run, by first appearance then address; runs must not overlap in time."""
    spark = df.sparkSession
    known = read_registry(spark, path).filter(F.col("batch") != batch)
    top = known.agg(F.max("node_id")).first()[0]
    fresh = first_seen(df, []).join(known.select("ip"), "ip", "left_anti")
    numbered = positions(fresh, ["first_us", "ip"], name="node_id")
    start = 0 if top is None else top + 1
    numbered.select("ip", (F.col("node_id") + start).alias("node_id")).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def register_stream(stream: DataFrame, path: str, checkpoint: str):
    """The same for a stream of packets: one run per micro-batch, numbered by it."""
    return stream.writeStream.foreachBatch(lambda df, batch: register_hosts(df, path, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
