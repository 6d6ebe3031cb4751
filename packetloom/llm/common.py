"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from packetloom.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow form of a column list; call it on the driver."""
    return to_arrow_schema(StructType.fromDDL(schema))


def map_rows(df: DataFrame, columns: list[str], start: Callable[[], Callable[..., Iterable[tuple]]], schema: str,
             rows_out: int = 20_000) -> DataFrame:
    """Arrow-batched row function: ``start()`` runs once per task and returns the function of one row.

    The function yields output tuples; they leave in batches of at most about ``rows_out`` rows.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend(fn(*row))
                if len(out) >= rows_out:
                    yield to_batch(out, arrow)
                    out = []
            if out:
                yield to_batch(out, arrow)

    return df.select(*columns).mapInArrow(run, schema)


def to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def span_digest(spans: str, kinds: tuple[str, ...]):
    """Lowercase hex SHA-256 of ``kind:start:end`` of the spans of these kinds, in their order."""
    return F.sha2(joined_spans(F.filter(spans, lambda s: s["kind"].isin(*kinds))).cast("binary"), 256)


def joined_spans(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_kind(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
