"""Panels of a bar stream: all instruments of one time, handed on when all have reported or when the wait is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barley.operators.spec import ID, TS


def flushed_panels(bars: DataFrame, expected: int, wait: float, fields: list[str]) -> DataFrame:
    """``(ts, instrument_id, fields..., reported, complete)``: the bars of each time, once.

    A time comes out as soon as ``expected`` instruments have reported; else ``wait`` seconds of processing time after its first bar, without any new
    input, or with the first batch that finds the watermark past it. Of an instrument's repeated bars the first counts. A time that has come
    out is closed: later bars of it are dropped. The closed mark is kept until the watermark passes the time; from then on its bars are late.

    ``bars`` is a stream with a watermark on ``ts``. The state of a time holds at most one bar per instrument.
    """
    types = dict(bars.dtypes)
    own = [ID, *fields]
    stored = ", ".join(f"{c} array<{types[c]}>" for c in own)
    given = ", ".join(f"{c} {types[c]}" for c in own)
    milliseconds = max(1, int(wait * 1000))

    def out(ts, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(**{TS: ts, "reported": len(rows), "complete": len(rows) >= expected})[[TS, *own, "reported", "complete"]]

    def hold(state: GroupState, closed: bool, since: int, columns: list) -> None:
        """An update drops the alarm, so it is set again: for what is left of the wait, or for another look at a closed time."""
        state.update((closed, since, *columns))
        state.setTimeoutDuration(milliseconds if closed else max(1, since + milliseconds - state.getCurrentProcessingTimeMs()))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, nothing = pd.Timestamp(key[0]), [[] for _ in own]
        past = state.getCurrentWatermarkMs() > ts.timestamp() * 1000
        now = state.getCurrentProcessingTimeMs()
        closed, since, *held = state.get if state.exists else (past, now, *nothing)   # the first bar of a time past the watermark is late
        if state.hasTimedOut and closed:
            if past:
                state.remove()
            else:
                hold(state, True, since, nothing)
        elif state.hasTimedOut:
            hold(state, True, since, nothing)
            yield out(ts, pd.DataFrame(dict(zip(own, map(list, held)))))
        elif closed:
            if state.exists:
                hold(state, True, since, nothing)
        else:
            fresh = pd.concat([b[own] for b in batches], ignore_index=True)
            before = pd.DataFrame(dict(zip(own, map(list, held)))).astype(fresh.dtypes.to_dict())
            rows = pd.concat([before, fresh], ignore_index=True).drop_duplicates(ID)
            if len(rows) >= expected or past:
                hold(state, True, since, nothing)
                yield out(ts, rows)
            else:
                hold(state, False, since, [rows[c].tolist() for c in own])

    schema = f"{TS} {types[TS]}, {given}, reported bigint, complete boolean"
    return bars.select(TS, *own).groupBy(TS).applyInPandasWithState(step, schema, f"closed boolean, since bigint, {stored}", "append", GroupStateTimeout.ProcessingTimeTimeout)
