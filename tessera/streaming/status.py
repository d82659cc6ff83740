"""Streams: changes of a job's state, and detection on texts as they come."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera import schema
from tessera.operators import pipeline


#: How long an ended job is remembered, in milliseconds, for events that come late.
REMEMBERED_MS = 86_400_000


def status_changes(events: DataFrame, remembered_ms: int = REMEMBERED_MS) -> DataFrame:
    """The stream of ``job_id, ts, status`` without what a job's last state already was.

    Only the last state of each job is kept. After an end state a job says nothing more, and after
    ``remembered_ms`` without another event it is forgotten. Within a micro-batch events go by time, then
    state. Null states are passed over.

    As jobs are forgotten by the clock, the stream runs batches even when nothing new came, so
    ``processAllAvailable`` and ``availableNow`` never end on it: ``trigger(once=True)`` does, and a stream
    that goes on wants a ``processingTime``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "status"], kind="stable")
        out = []
        for ts, status in zip(rows["ts"], rows["status"], strict=True):
            if last in schema.END_STATES:
                break
            if status is not None and status != last:
                out.append((key[0], ts, status))
                last = status
        if last is not None:
            state.update((last,))
            if last in schema.END_STATES:
                state.setTimeoutDuration(remembered_ms)
        yield pd.DataFrame(out, columns=["job_id", "ts", "status"])

    return events.select("job_id", "ts", "status").groupBy("job_id").applyInPandasWithState(step, schema.EVENT, "last string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def detected(stream: DataFrame, types: Iterable[str] = schema.TYPES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Detection on a stream: the same row-wise plan as on a table, without state."""
    return pipeline.detect_pii(stream, types, doc_id, text)


def counts_by_window(stream: DataFrame, ts: str = "ts", length: str = "1 hour", late: str = "1 hour", types: Iterable[str] = schema.TYPES, text: str = "text") -> DataFrame:
    """An extension: entities by type in tumbling windows of event time, late rows allowed for ``late``."""
    found = pipeline.with_entities(stream.withWatermark(ts, late), types, text).select(ts, F.explode("entities").alias("e"))
    return found.groupBy(F.window(ts, length), F.col("e.type").alias("pii_type")).agg(F.count("*").alias("n"))
