"""Deliveries of register changes as a stream: each micro-batch becomes one version of the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from groupforge.operators.changes import merge_companies
from groupforge.plans.storage import Versions, cut, shared_folder


def apply_deliveries(spark: SparkSession, companies: DataFrame, folder: str, schema, day: str, root: str) -> DataFrame:
    """Reads every delivery file of folder once, oldest first, and merges each into the table at root.

    A batch that is run again after a failure merges into the newest whole version, which gives the same rows.
    """
    table = Versions(spark, root)
    table.write(companies.select("siren", "denomination", "commercial", "staff", "opened", "closed"))

    def merge(batch: DataFrame, _: int) -> None:
        table.write(merge_companies(table.read(), batch, day).drop("change"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()


def replayed(spark: SparkSession, companies: DataFrame, batch: DataFrame, day: str, times: int = 2) -> DataFrame:
    """The table after the same delivery has come `times` times."""
    base = f"{shared_folder(spark).rstrip('/')}/deliveries-{uuid.uuid4().hex[:12]}"
    batch = cut(batch)
    for _ in range(times):
        batch.coalesce(1).write.mode("append").parquet(f"{base}/in")
    return apply_deliveries(spark, companies, f"{base}/in", batch.schema, day, f"{base}/table")
