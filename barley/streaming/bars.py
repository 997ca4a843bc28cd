"""Bars, factors and snapshots on live input."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barley.operators import FactorSet
from barley.operators.factorset import melt
from barley.operators.joins import as_of, reachable, spread_one
from barley.operators.spec import BAR, ID, TS
from barley.plans import quality, risk
from barley.session import dealt_over
from barley.sources.panel import densify
from barley.streaming.state import Carried, path_of

#: cells of the panel that one task of a batch takes
TASK_CELLS = 5_000
#: rows of the side data that one task takes
SIDE_ROWS = 50_000
#: a chunk of time of the side data, in seconds
SIDE_SPAN = 86_400


def live_bars(ticks: DataFrame, width: str, delay: str, key: list[str] | None = None) -> DataFrame:
    """Tumbling bars of a tick stream ``(ts, instrument_id, price, size, seq)``.

    Ticks later than ``delay`` are dropped, and so are repeated ones of equal ``key`` within that time. In append mode
    a bar comes out once, when it is complete; in update mode open bars come out whenever they change.
    """
    clean = ticks.withWatermark(TS, delay)
    if key:
        clean = clean.dropDuplicatesWithinWatermark(key)
    place = F.struct(TS, "seq")
    return clean.groupBy(F.window(TS, width).alias("w"), ID).agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", place).alias("close"), F.sum("size").alias("volume"),
        F.sum(F.col("price") * F.col("size")).alias("quote_volume")).select(
        ID, F.col("w")["start"].alias(TS), "open", "high", "low", "close", "volume", "quote_volume")


def completeness(bars: DataFrame, expected: int) -> DataFrame:
    """Instruments that reported per time; ``complete`` when all did. A panel past the watermark goes out as it is."""
    return bars.groupBy(TS).agg(F.count_distinct(ID).alias("reported")).withColumn("complete", F.col("reported") >= expected)


@dataclass
class FactorStream:
    """Evaluate a factor set on each batch of completed bars, over a bounded history that is carried from batch to batch.

    The history holds the bars of the last ``history_bars`` times; a batch reads it and its own bars, nothing older, so that its input does not depend on the age
    of the stream. Bars at or before the newest time of the history are late and dropped, and so are repeated ones. ``history_bars`` also bounds
    what unbounded operators such as ``ema`` see.

    Folders: ``bars`` (what came), ``factors``, ``ic`` (of the values of the bar before, at each new bar) and ``risk``, by batch number. A batch
    that is run again after a failure writes the same.

    A batch takes as many tasks as its panel needs, at most the session's. ``state_tasks`` is the number for the state of the stream itself, such as open bars; it is
    fixed when the stream starts for the first time. The panel of a batch, and what it can meet of the side data, are written once, to ``panel`` and
    ``side``, and read by all that follows.
    """

    factors: FactorSet
    folder: str
    history_bars: int = 500
    side: DataFrame | None = None          # (ts, instrument_id, field...) carried forward into bars
    side_fields: list[str] = field(default_factory=list)
    lead: tuple[str, str, str] | None = None  # instrument, field, new field: spread to all
    refit_every: int = 0                   # batches between risk fits, 0 for none
    after: Callable[[DataFrame, int], None] | None = None
    state_tasks: int | None = None         # the session's number of tasks where it is not given
    tasks: int | None = field(default=None, init=False)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        most = self.tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
        batch.write.mode("overwrite").parquet(path_of(self.folder, "bars", number))   # the stream's plan runs once
        batch = spark.read.schema(batch.schema).parquet(path_of(self.folder, "bars", number))
        history, values_before = Carried(self.folder, "history"), Carried(self.folder, "last_values")
        known, published = history.before(spark, number), values_before.before(spark, number)
        rows = batch.count() + (0 if known is None else known.count())
        with dealt_over(spark, min(most, -(-rows // TASK_CELLS))):
            fresh = batch.dropDuplicates([TS, ID])
            if known is not None:
                fresh = fresh.where(F.coalesce(F.col(TS) > known.agg(F.max(TS)).scalar(), F.lit(True)))
                if fresh.isEmpty():
                    history.keep(known, number)
                    values_before.keep(published, number)
                    return
            known = fresh if known is None else known.unionByName(fresh)
            # an ordered limit keeps only that many rows per task
            first = known.select(TS).distinct().orderBy(F.desc(TS)).limit(self.history_bars).agg(F.min(TS)).scalar()
            history.leave(known.where(F.col(TS) >= first), number)
            us = F.unix_micros(F.col(TS).cast("timestamp"))
            names, bars, low, high = known.agg(F.count_distinct(ID), F.count_distinct(TS), F.min(us), F.max(us)).first()
        few = min(most, -(-names * bars // TASK_CELLS))
        with dealt_over(spark, few):
            panel = densify(known)
            if self.side is not None:
                low, high = (low, high) if bars else (0, 0)   # a first batch may be empty
                side = Carried(self.folder, "side").leave(reachable(self.side, self.side_fields, low, high), number)
        # the side is as large as it is, whatever the panel
        with dealt_over(spark, few if self.side is None else min(most, few + side.count() // SIDE_ROWS)):
            if self.side is not None:
                panel = as_of(panel, side, self.side_fields, width=SIDE_SPAN)
            panel = Carried(self.folder, "panel").leave(panel, number)
        with dealt_over(spark, few):
            self._follow(panel, fresh.select(TS).distinct(), published, values_before, number)

    def _follow(self, panel: DataFrame, times: DataFrame, published: DataFrame | None, values_before: Carried, number: int) -> None:
        """All that is made from the panel of a batch; ``times`` are the new ones."""
        spark = panel.sparkSession
        if self.lead:
            panel = spread_one(panel, *self.lead)
        values = melt(self.factors.evaluate(panel), list(self.factors.factors), (TS, ID))
        values.join(times, TS, "left_semi").write.mode("overwrite").parquet(path_of(self.folder, "factors", number))
        values = spark.read.schema(values.schema).parquet(path_of(self.folder, "factors", number))
        # the values published last, and the new ones, meet the returns that the new bars complete
        both = values if published is None else published.unionByName(values)
        ic = quality.realised_ic(both, panel, panel.select(TS, BAR).distinct()).join(times, TS, "left_semi")
        ic.write.mode("overwrite").parquet(path_of(self.folder, "ic", number))
        values_before.leave(both.where(F.col(TS) == both.agg(F.max(TS)).scalar()), number)
        if self.refit_every and number % self.refit_every == 0:
            returns = risk.prepared(risk.simple_returns(panel))
            risk.covariance(returns).write.mode("overwrite").parquet(path_of(self.folder, "risk", number))
        if self.after:
            self.after(panel, number)

    def start(self, bars: DataFrame, once: bool = False, every: str = "10 seconds") -> StreamingQuery:
        self.tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        writer = bars.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/checkpoint")
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
        with dealt_over(bars.sparkSession, self.state_tasks or self.tasks):   # a query has its own copy of the session, made here
            return writer.start()

    def published(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/factors").drop("batch")


    def realised(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/ic").drop("batch")


@dataclass
class SnapshotStream:
    """Snapshots of a state that is the newest row of each key: equity, venue or account snapshots.

    Each trigger merges its rows into the state by ``key`` and ``version`` (the largest wins, so late and repeated rows change nothing) and writes
    ``make(state)``. The state holds one row per key, whatever the age of the stream.
    """

    folder: str
    key: list[str]
    version: list[str]
    make: Callable[[DataFrame], DataFrame]

    def __call__(self, batch: DataFrame, number: int) -> None:
        carried = Carried(self.folder, "state")
        before = carried.before(batch.sparkSession, number)
        rows = batch if before is None else before.unionByName(batch)
        rest = [c for c in batch.columns if c not in self.key]
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.version)).alias("x")).select(*self.key, "x.*").select(*batch.columns)
        self.make(carried.leave(newest, number)).write.mode("overwrite").parquet(path_of(self.folder, "snapshots", number))

    def start(self, rows: DataFrame, once: bool = False, every: str = "10 seconds") -> StreamingQuery:
        writer = rows.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()

    def written(self, spark) -> DataFrame:
        """All snapshots, with the number of their batch."""
        return spark.read.parquet(f"{self.folder}/snapshots")
