"""Writers: records by type, and reports under keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.session import cut_lineage


def append_records(rows: DataFrame, path: str, record_type: str) -> None:
    """Append rows to a dataset that is partitioned by record type."""
    rows.withColumn("record_type", F.lit(record_type)).write.mode("append").partitionBy("record_type").parquet(path)


def report_key(value: Column) -> Column:
    """A key of letters, digits, dashes and underscores."""
    return F.regexp_replace(value, "[^A-Za-z0-9_-]", "_")


def reports(rows: DataFrame, key: Column) -> DataFrame:
    """(`report_key`, `report`): each row as JSON under its key."""
    return rows.select(report_key(key).alias("report_key"), F.to_json(F.struct(*rows.columns)).alias("report"))


def upsert_reports(rows: DataFrame, path: str, buckets: int = 16) -> None:
    """Write reports so that those of the same keys are replaced: the touched partitions are read, merged and overwritten."""
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64("report_key"), F.lit(buckets)).cast("int")
    new = rows.withColumn("part", part)
    try:
        old = spark.read.parquet(path)
    except Exception as missing:  # the folder doesn't exist before the first write
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        old = new.limit(0)
    touched = new.select("part").distinct()
    kept = old.join(touched, "part", "left_semi").join(new.select("report_key"), "report_key", "left_anti").select(*new.columns)
    merged = cut_lineage(new.unionByName(kept))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
