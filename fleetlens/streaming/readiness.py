"""W20 on a live stream of polls: report each cluster once, when it becomes
ready or runs out of polls.

The reference polls a condition until it holds and keeps no history. Here
poll records (cluster, poll time, ok per host) arrive as a stream. A poll is
complete once the event-time watermark has passed it; rows that arrive for it
later are late and ignored by the state function. Completed polls are taken
in time order per cluster by a stateful operator (``applyInPandasWithState``),
whose state per cluster is a poll counter, a done flag and the polls still
open -- never the history.

Rows of one cluster within one micro-batch meet in one task; their number is
bounded by the batch size (``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT_SCHEMA = ("cluster string, polls long, ready_at timestamp, timed_out boolean")
STATE_SCHEMA = ("polls long, done boolean, open_ts array<long>, open_ok array<boolean>")


def _advance(max_polls: int | None):
    def fn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (cluster,) = key
        if state.exists:
            polls, done, open_ts, open_ok = state.get
            pending = dict(zip(list(open_ts), list(open_ok)))
        else:
            polls, done, pending = 0, False, {}
        watermark_us = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for pdf in batches:
                if done or pdf.empty:
                    continue
                ts = pd.to_datetime(pdf["poll_ts"]).astype("int64") // 1000  # microseconds
                ok = pdf["ok"].fillna(False).astype(bool)
                # A row older than the watermark belongs to a poll that is
                # already complete: late, ignored.
                fresh = ts >= watermark_us
                for t, v in ok[fresh].groupby(ts[fresh].values).all().items():
                    pending[int(t)] = bool(pending.get(int(t), True) and v)
        out = []
        if not done:
            for t in sorted(t for t in pending if t < watermark_us):
                v = pending.pop(t)
                polls += 1
                if v:
                    out.append((cluster, polls, pd.Timestamp(t, unit="us"), False))
                    done = True
                elif max_polls is not None and polls >= max_polls:
                    out.append((cluster, polls, None, True))
                    done = True
                if done:
                    pending = {}
                    break
        state.update((polls, done, sorted(pending), [pending[t] for t in sorted(pending)]))
        if pending:
            state.setTimeoutTimestamp(max(max(pending) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["cluster", "polls", "ready_at", "timed_out"])
    return fn


def stream_time_to_ready(polls: DataFrame, cluster: str, poll_ts: str | Column, ok: Column,
                         max_polls: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """Streaming W20. ``polls`` is a streaming DataFrame; a poll is the set of
    rows sharing (cluster, poll_ts) and holds when ``ok`` is true on all of
    them. Emits (cluster, polls, ready_at, timed_out) once per cluster, in
    append mode. ``delay`` is how late a row of a poll may arrive."""
    ts = F.col(poll_ts) if isinstance(poll_ts, str) else poll_ts
    rows = polls.select(F.col(cluster).cast("string").alias("cluster"),
                        ts.cast("timestamp").alias("poll_ts"), ok.alias("ok"))
    return (rows.withWatermark("poll_ts", delay)
            .groupBy("cluster")
            .applyInPandasWithState(_advance(max_polls), OUTPUT_SCHEMA, STATE_SCHEMA,
                                    "append", GroupStateTimeout.EventTimeTimeout))
