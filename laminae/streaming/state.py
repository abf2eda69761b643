"""Stateful streams: a work ledger with claims and retries, and rows finalised below a moving floor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States of a work item, in order; a failed item may be claimed again.
QUEUED, CLAIMED, DONE, FAILED = "QUEUED", "CLAIMED", "DONE", "FAILED"


def ledger(events: DataFrame, retries: int = 8) -> DataFrame:
    """(item, state, tries) after each batch from events (item long, kind string, seq long): claim, done, fail.

    A claim of a claimed or finished item is ignored, so each item is worked on once at a time; after ``retries``
    failures an item stays FAILED. State is one small row an item.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, tries = state.get if state.exists else (QUEUED, 0)
        for frame in frames:
            for kind in frame.sort_values("seq")["kind"]:
                if kind == "claim" and now in (QUEUED, FAILED) and tries < retries:
                    now, tries = CLAIMED, tries + 1
                elif kind == "done" and now == CLAIMED:
                    now = DONE
                elif kind == "fail" and now == CLAIMED:
                    now = FAILED
        state.update((now, tries))
        yield pd.DataFrame({"item": [key[0]], "state": [now], "tries": [tries]})

    return events.groupBy("item").applyInPandasWithState(step, "item long, state string, tries int", "state string, tries int", "update", GroupStateTimeout.NoTimeout)


def finalized(rows: DataFrame, time: str, size: str, late: str) -> DataFrame:
    """(start, n, total): windows of (time, value) emitted once the floor has passed them; later rows are dropped."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "n", "total")
