"""Flow tables from CSV, parquet and Zeek logs, and the sinks of the batch jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.cleaning import standardize_columns
from packetloom.operators.heavy import lookup
from packetloom.session import task_slots


def csv_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line does not decode, then Latin-1."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1)
    return "ISO-8859-1" if broken.take(1) else "UTF-8"


def read_flow_csv(spark: SparkSession, paths: Sequence[str], encoding: str | None = None) -> DataFrame:
    """Vendor flow files as text columns under canonical names; headers may differ per path."""
    parts = []
    for path in paths:
        raw = (spark.read.option("header", True).option("inferSchema", False)
               .option("encoding", encoding or csv_encoding(spark, path)).csv(path))
        parts.append(standardize_columns(raw))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_projected(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet with only the named columns; the scan reads nothing else."""
    return spark.read.parquet(path).select(*columns)


def write_sorted(df: DataFrame, path: str, order: str = "ts_us", partitions: int | None = None,
                 mode: str = "errorifexists") -> None:
    """Snappy parquet in global time order: range partitions, each sorted."""
    slots = partitions or task_slots(df.sparkSession)
    (df.repartitionByRange(slots, order).sortWithinPartitions(order)
     .write.mode(mode).option("compression", "snappy").parquet(path))


def write_report(df: DataFrame, path: str) -> None:
    """Metric report as JSON lines."""
    df.write.json(path)


def read_zeek(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Named fields of many Zeek logs plus ``capture_file``.

    Every log carries its own ``#fields`` line, so lines meet the names of their own file and
    are turned into a map. The name table has one row per file; the lines of a file that holds many
    of them stay where they are read.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                         F.col("_metadata.file_name").alias("capture_file"))
    header = F.split(F.trim("_h"), "\t")
    names = lines.filter(F.col("value").startswith("#fields")).groupBy("_file").agg(F.max("value").alias("_h")).select(
        "_file", F.slice(header, F.lit(2), F.size(header)).alias("_names"))
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parsed = lookup(rows, names, ["_file"]).withColumn("_v", F.split("value", "\t"))
    n = F.least(F.size("_names"), F.size("_v"))
    record = F.map_from_arrays(F.slice("_names", 1, n), F.slice("_v", 1, n))
    return parsed.withColumn("_m", record).select(
        "capture_file", *[F.try_element_at("_m", F.lit(c)).alias(c.replace("id.", "").replace("-", "_")) for c in columns])


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files (``path``, ``content``) whose SHA-256 is not in the ledger, once per digest."""
    hashed = files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    fresh = hashed.join(ledger.select("sha256").distinct(), "sha256", "left_anti")
    return fresh.groupBy("sha256").agg(F.min("path").alias("path"))


def append_ledger(fresh: DataFrame, path: str) -> None:
    fresh.select("sha256", "path").write.mode("append").parquet(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


