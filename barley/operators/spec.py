"""Window specifications of the two directions of a panel: along time, and across instruments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql.window import WindowSpec

ID, TS, BAR = "instrument_id", "ts", "bar"


@dataclass(frozen=True)
class Track:
    """The history of one series: rows with equal ``keys``, in ``order``."""

    keys: tuple[str, ...] = (ID,)
    order: str = TS
    #: name of the dense bar number, the regressor of the trend operators
    clock: str = BAR

    def line(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def last(self, n: int) -> WindowSpec:
        return self.line().rowsBetween(-(n - 1), 0)


@dataclass(frozen=True)
class Slice:
    """All rows with equal ``keys``: one timestamp across instruments."""

    keys: tuple[str, ...] = (TS,)

    def all(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def by(self, *order) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*order)


BY_INSTRUMENT = Track()
BY_TIME = Slice()
