"""Landed pages as a stream into the ticket store."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from turnstile.session import shared_dir
from turnstile.sources import pages
from turnstile.sources.store import TicketStore, checked_tenant


def start(
    spark: SparkSession,
    landing: str,
    store: TicketStore,
    tenant: str,
    checkpoint: str | None = None,
    now: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    on_counts: Callable[[dict[str, int]], None] | None = None,
    quarantine: str | None = None,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Ingest every page that has landed and stop; run it again for the next ones.

    Uniqueness is checked against the store, so the stream keeps no state and a
    batch that is replayed after a failure adds nothing. The checkpoint lies in the
    shared folder of the session unless one is given.
    """
    if checkpoint is None:
        shared = shared_dir(spark)
        if shared is None:
            raise ValueError("no checkpoint given and spark.checkpoint.dir is not set")
        checkpoint = f"{shared}/page_stream/{checked_tenant(tenant)}"
    files = (
        spark.readStream.schema(pages.PAGE)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(landing)
    )

    def into_store(batch: DataFrame, _: int) -> None:
        counts = store.ingest(tenant, pages.records(batch), now(), quarantine=quarantine)
        if on_counts is not None:
            on_counts(counts)

    return (
        pages.landed(files)
        .writeStream.foreachBatch(into_store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
