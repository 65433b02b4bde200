"""Sinks of results: calibrated tables, measurements with their provenance, sharded exports, and layers read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def write_calibrated(scored: DataFrame, null: DataFrame, folder: str) -> None:
    """The entity table by falling z and the null table by rising n, as CSV files with headers."""
    scored.orderBy(F.desc_nulls_last("z"), "entity").write.csv(f"{folder}/entities", header=True)
    null.orderBy("n").write.csv(f"{folder}/null", header=True)


def write_measurement(measured: DataFrame, folder: str, metric: str, **provenance: object) -> None:
    """A measurement as Parquet beside one row of run metadata (metric, name, value)."""
    measured.write.parquet(f"{folder}/{metric}")
    rows = [(metric, str(k), str(v)) for k, v in sorted(provenance.items())]
    measured.sparkSession.createDataFrame(rows, "metric string, name string, value string").write.mode("append").parquet(f"{folder}/run_metadata")


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.aggregate(F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long")), F.lit(FNV_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME) % (1 << 32))


def write_shards(table: DataFrame, key: str, folder: str, shards: int = 128) -> None:
    """Rows in folders shard=0 .. by the hash of their key, so that a reader finds a key in one of them."""
    table.withColumn("shard", (fnv1a(F.col(key)) % shards).cast("int")).write.partitionBy("shard").parquet(folder)


def read_layers(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, DataFrame], list[str]]:
    """The Parquet layers that exist, by name, and the names of those that don't."""
    found, missing = {}, []
    for name, path in paths.items():
        try:
            found[name] = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            missing.append(name)
    return found, missing
