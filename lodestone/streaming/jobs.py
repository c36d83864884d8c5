"""Polling jobs on Structured Streaming: a rate source is the clock, each tick runs one batch job."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import reminders
from lodestone.plans.intake import ingest_paths
from lodestone.sources.store import Store


def _ticks(store: Store, name: str, seconds: float, job: Callable[[], None], once: bool) -> StreamingQuery:
    """``job`` once or every ``seconds``; the stream's own state is kept beside the store, which all machines share."""

    def run(_: DataFrame, __: int) -> None:
        job()

    stream = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = stream.writeStream.option("checkpointLocation", f"{store.root}/streams/{name}").foreachBatch(run)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=f"{int(seconds * 1000)} milliseconds")).start()


def watch(store: Store, roots: list[str], seconds: float = 60.0, on_change: Callable[[dict], None] = print, once: bool = False, **options) -> StreamingQuery:
    """Ingests ``roots`` again and again; ``on_change`` gets the report when something changed. The listing is compared with
    the store each time, as a file source would miss deleted and rewritten files."""

    def job() -> None:
        before = store.generation
        report = ingest_paths(store, roots, **options)
        if report["generation"] != before:
            on_change(report)

    return _ticks(store, "watch", seconds, job, once)


def notify(store: Store, fire: Callable[[list], None], seconds: float = 30.0, once: bool = False, most: int = 1000) -> StreamingQuery:
    """Fires all pending reminders that are due, in lists of up to ``most``, then marks them notified. A stop between the two
    fires some again with the next tick; none is lost."""

    def job() -> None:
        table = store.table("reminders")
        now = table.sparkSession.range(1).select(F.current_timestamp().cast("timestamp_ntz")).first()[0]
        rows = reminders.due(table, F.lit(now)).select("reminder_id", "title", "due_at")
        found = rows.toLocalIterator()
        fired = False
        while part := list(islice(found, most)):
            fire(part)
            fired = True
        if fired:
            store.commit({"reminders": reminders.set_status(table, rows.select("reminder_id", F.lit("notified").alias("status")))})

    return _ticks(store, "notify", seconds, job, once)


def due_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Of a stream of ``reminder_id, title, due_at, now`` the rows that are due, each id once within the watermark."""
    stream = events.withWatermark("now", delay)
    return stream.where(F.col("due_at") <= F.col("now")).dropDuplicatesWithinWatermark(["reminder_id"])
