"""Streaming ingest of events: idempotent by event id and by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sluice.operators import fragments


def first_deliveries(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event_id once; ts bounds how long ids are remembered."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def _replace(rows: DataFrame, path: str, batch_id: int) -> None:
    named = rows.withColumn("batch_id", F.lit(batch_id))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def write_idempotent(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch; a batch that is run again replaces what it wrote before."""
    return events.writeStream.foreachBatch(lambda rows, n: _replace(rows, path, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record(payloads: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch of payloads (phase, payload, sequence_no, workspace_id) as events, artifacts, fragments and
    outcomes. Events come last: readers that go by them see whole batches, and a batch that is run again replaces all
    four."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        events = fragments.normalized_events(rows).dropDuplicates(["event_id"]).persist()
        artifacts = fragments.artifacts(events)
        tables = {"artifacts": artifacts, "fragments": fragments.fragments(artifacts), "outcomes": fragments.outcomes(events), "events": events}
        for name, table in tables.items():
            _replace(table, f"{folder}/{name}", batch_id)
        events.unpersist()

    return payloads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_sequence(rows: DataFrame, last: DataFrame) -> DataFrame:
    """rows (workspace_id, arrived, event_id) numbered behind the last number of their workspace (workspace_id, last)."""
    from pyspark.sql import Window

    w = Window.partitionBy("workspace_id").orderBy("arrived", "event_id")
    out = rows.withColumn("k", F.row_number().over(w)).join(last, "workspace_id", "left")
    return out.withColumn("sequence_no", (F.coalesce("last", F.lit(0)) + F.col("k")).cast("long")).drop("k", "last")
