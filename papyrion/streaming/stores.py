"""Streams of events kept as state: the latest job, the memory's log, and the breaker of an engine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COOLDOWN_S = 60


def appended(events: DataFrame, folder: str, checkpoint: str):
    """Streams events to a store's log as files; a restarted query writes no batch twice."""
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Events and failures of each engine by window; those later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.count_if("failed").alias("n_failed")).select(F.col("w.start").alias("start"), by, "n", "n_failed")


def stepped(failures: int, opened: float | None, failed: bool, now: float, threshold: int = 2) -> tuple[int, float | None]:
    """(failures in a row, when the breaker opened) after an outcome. The end of the cooldown doesn't reset the count, so one more failure opens it again."""
    if not failed:
        return 0, None
    failures += 1
    return failures, now if failures >= threshold else opened


def _breaker(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failures, opened = state.get if state.exists else (0, None)
    rows = pd.concat(list(batches)).sort_values(["seq"], ignore_index=True)
    out = []
    for seq, failed, at in zip(rows["seq"], rows["failed"], rows["at"], strict=True):
        failures, opened = stepped(failures, opened, bool(failed), float(at))
        out.append((key[0], int(seq), failures, opened is not None and float(at) < opened + COOLDOWN_S))
    state.update((failures, opened))
    yield pd.DataFrame(out, columns=["engine", "seq", "failures", "open"])


def breaker(outcomes: DataFrame) -> DataFrame:
    """outcomes (engine, seq, failed, at in seconds) as a stream: (engine, seq, failures, open), the state kept by engine."""
    return outcomes.groupBy("engine").applyInPandasWithState(_breaker, "engine string, seq bigint, failures int, open boolean", "failures int, opened double", "append", GroupStateTimeout.NoTimeout)
