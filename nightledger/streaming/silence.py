"""Silent channels as a stream: keyed state with event-time timers.

A channel that has gone silent sends no row that could tell of it, so every
channel keeps a timer at the end of its first open day. When the watermark passes
it, the days up to the watermark are closed one after another, and a run of quiet
days is given out when a day ends it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
EPOCH = dt.date(1970, 1, 1)
SCHEMA = "channel string, from_date date, to_date date, quiet_days long"


class SilentRuns(StatefulProcessor):
    """State of a channel: the next day to close, its open days' counts, the last ``window`` closed ones and the quiet run so far.

    Days are numbers since 1970 and begin ``offset`` ms after midnight UTC of the
    day before; counting starts at ``first``.
    """

    def __init__(self, first: int, window: int = 56, healthy: float = 1.0, least_days: int = 4, offset: int = 66_600_000):
        self.first, self.window, self.healthy, self.least, self.offset = first, window, healthy, least_days, offset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day int", "n long")
        self.closed = handle.getValueState("closed", "next int, counts array<long>, quiet int")

    def _state(self) -> tuple[int, list[int], int]:
        if not self.closed.exists():
            return self.first, [], 0
        now = self.closed.get()
        return now[0], list(now[1]), now[2]

    def _ends(self, day: int) -> int:
        """The instant at which a day is over."""
        return (day - 1) * DAY + self.offset + DAY

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        day, counts, quiet = self._state()
        if not self.closed.exists():
            self.closed.update((day, counts, quiet))
            self.handle.registerTimer(self._ends(day))
        for batch in rows:
            days = (batch["created_at"].astype("datetime64[ms]").astype("int64") - self.offset) // DAY + 1
            for d, n in days.value_counts().items():
                if d >= day:  # rows of a closed day are late
                    before = self.open.getValue((int(d),))[0] if self.open.containsKey((int(d),)) else 0
                    self.open.updateValue((int(d),), (before + int(n),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        day, counts, quiet = self._state()
        found = []
        while self._ends(day) <= timerValues.getCurrentWatermarkInMs():
            n = 0
            if self.open.containsKey((day,)):
                n = self.open.getValue((day,))[0]
                self.open.removeKey((day,))
            if n == 0 and counts and sum(counts) >= self.healthy * len(counts):
                quiet += 1
            else:
                if quiet >= self.least:
                    found.append((key[0], EPOCH + dt.timedelta(day - quiet), EPOCH + dt.timedelta(day - 1), quiet))
                quiet = 0
            counts, day = [*counts, n][-self.window :], day + 1
        self.closed.update((day, counts, quiet))
        self.handle.registerTimer(self._ends(day))
        if found:
            yield pd.DataFrame(found, columns=["channel", "from_date", "to_date", "quiet_days"])

    def close(self) -> None:
        pass


def silent_channels(requests: DataFrame, first: dt.date, late: str = "2 days", **rule) -> DataFrame:
    """(channel, from_date, to_date, quiet_days) of a stream of requests (channel, created_at), from the day ``first`` on.

    Needs the RocksDB state store. A run is given out when the watermark has
    passed the day that ends it; rows of days that are closed are not counted.
    """
    r = requests.where("channel is not null").select("channel", F.col("created_at").cast("timestamp").alias("created_at")).withWatermark("created_at", late)
    return r.groupBy("channel").transformWithStateInPandas(SilentRuns((first - EPOCH).days, **rule), SCHEMA, outputMode="Append", timeMode="EventTime")
