"""Structured Streaming forms of the incremental behaviours: log with a time to live, rescans, two-phase death."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def impact_log(stream: DataFrame, minutes: int = 120) -> DataFrame:
    """Paths of a stream(ts timestamp, path), each once within the time to live; older rows are late and dropped."""
    return stream.withWatermark("ts", f"{minutes} minutes").dropDuplicatesWithinWatermark(["path"])


def active_paths(stream: DataFrame, minutes: int = 120) -> DataFrame:
    """(window, path, n): how often each path was asked for, in hopping windows."""
    w = F.window("ts", f"{minutes} minutes", f"{minutes // 4} minutes")
    return stream.withWatermark("ts", f"{minutes} minutes").groupBy(w, "path").agg(F.count("*").alias("n"))


def two_phase_death(stream: DataFrame) -> DataFrame:
    """(id, scan, st) transitions of a stream(id, scan long, present boolean) of scan results.

    A node absent once is dead, absent twice deleted, and ok again when it is back.
    State is kept for living and dead nodes only: a deleted one is forgotten, and
    the absence of a node that no state knows says nothing.
    """

    def step(key, frames, state: GroupState):
        misses = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            for row in frame.sort_values("scan").itertuples():
                if row.present:
                    out.append((key[0], row.scan, "ok"))
                    misses = 0
                elif misses is not None:
                    misses += 1
                    out.append((key[0], row.scan, "dead" if misses == 1 else "deleted"))
                    misses = misses if misses < 2 else None
        if misses is not None:
            state.update((misses,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["id", "scan", "st"])

    return stream.groupBy("id").applyInPandasWithState(step, "id string, scan long, st string", "misses int", "append", GroupStateTimeout.NoTimeout)


def rescan(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream of changed files(path, content): each batch is extracted, then handed to upsert."""
    from strandline.sources.extract import extract

    return stream.writeStream.foreachBatch(lambda batch, n: upsert(extract(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
