"""Streams into versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weft.plans.upkeep import Table, append, checked_keys, full


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first event of each key; repeats within ``delay`` of event time go, and so do events that come later than that.

    State holds the keys of one ``delay`` of event time, whatever the length of the stream.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def load_batch(table: Table, df: DataFrame, keys: list[str], stream: str, batch: int, latest_by: str | None = None) -> bool:
    """One micro-batch of a stream into the table, once: the version that takes its rows also takes the batch's number as
    the stream's mark, and a batch that the mark covers is left out. Whether it was loaded."""
    if table.marks().get(stream, -1) >= batch:
        return False
    with table.marking(stream, batch):
        if not keys:
            append(table, df)
        elif table.exists():
            table.merge(checked_keys(df, keys, latest_by), keys)
        else:
            full(table, checked_keys(df, keys, latest_by), keys)
    return True


def upsert(stream: DataFrame, table: Table, keys: list[str], checkpoint: str, latest_by: str | None = None) -> StreamingQuery:
    """Merge every micro-batch into a table by key (append without keys), until the input at hand is read.

    A batch that is tried again, after its version was made and before Spark noted that, is not loaded twice: the query's
    id, which its checkpoint keeps, names the stream. A batch rewrites the buckets it touches. Within a batch the latest row
    of a key counts if ``latest_by`` is given; repeated keys are an error otherwise.
    """

    def batch(df: DataFrame, number: int) -> None:
        load_batch(table, df, keys, df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), number, latest_by)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
