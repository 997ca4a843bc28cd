"""Joins of side data to a panel: as of a time, exact, one instrument to all, intervals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barley.operators.chunks import SPAN, seconds, with_last_known
from barley.operators.spec import ID, TS


def as_of(left: DataFrame, right: DataFrame, values: list[str], key: list[str] | None = None, width: float = SPAN) -> DataFrame:
    """Attach to each left row the latest known right value at or before its time.

    Both sides go through one sort per chunk of time, and only chunk ends are carried further. Works for a key of which
    one value holds most of the rows.
    """
    key = [ID] if key is None else key
    own = left.columns
    a = left.select(*own, *[F.lit(None).cast(dict(right.dtypes)[v]).alias(v) for v in values], F.lit(1).alias("_side"))
    b = right.select(*key, TS, *values).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    known = with_last_known(both, values, [TS, "_side"], key, seconds(), width)
    return known.where("_side = 1").drop("_side")


def reachable(side: DataFrame, values: list[str], low: int, high: int, key: list[str] | None = None) -> DataFrame:
    """The rows of ``side`` that an as-of join at times from ``low`` to ``high`` (microseconds) can meet, with the same result: those between the two, and of each
    key one row at ``low`` with the last known values up to then, which partial sums make before the exchange."""
    key = [ID] if key is None else key
    side, us = side.select(*key, TS, *values), F.unix_micros(F.col(TS).cast("timestamp"))
    newest = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col(TS))).alias(v) for v in values]
    at = F.timestamp_micros(F.lit(low)).cast(dict(side.dtypes)[TS]).alias(TS)
    return side.where(us <= low).groupBy(*key).agg(*newest).select(*key, at, *values).unionByName(side.where((us > low) & (us <= high)))


def attach_side(panel: DataFrame, side: DataFrame, field: str, fill: str = "ffill") -> DataFrame:
    """A slower field on the panel. ``ffill`` carries values forward and gives 0.0 to instruments without any;
    anything else joins equal timestamps only."""
    if fill != "ffill":
        return panel.join(side.select(ID, TS, field), [ID, TS], "left")
    joined = as_of(panel, side, [field])
    known = side.select(ID).distinct().withColumn("_known", F.lit(True))
    return (joined.join(known, ID, "left")
            .withColumn(field, F.when(F.col("_known"), F.col(field)).otherwise(F.lit(0.0))).drop("_known"))


def attach_bars(panel: DataFrame, other: DataFrame, field: str, out: str) -> DataFrame:
    """A field of other bars, carried forward, from the panel's own time range only; 0.0 for instruments without any."""
    low, high = panel.agg(F.min(TS)).scalar(), panel.agg(F.max(TS)).scalar()
    side = other.select(ID, TS, F.col(field).alias(out)).where(F.col(TS).between(low, high))
    return attach_side(panel, side, out)


def spread_one(panel: DataFrame, name: str, field: str, out: str) -> DataFrame:
    """One instrument's field next to every instrument. The name is exact, or else a prefix in any case."""
    exact = F.col(ID) == F.lit(name)
    like = F.lower(F.col(ID)).startswith(name.lower())
    choice = panel.where(exact | like).agg(F.min(F.struct((~exact).alias("far"), F.col(ID)))[ID]).scalar()
    line = panel.where(F.col(ID) == choice).select(TS, F.col(field).alias(out))
    return panel.join(line, TS, "left")


def attach_all(panel: DataFrame, sides: Iterable[dict]) -> DataFrame:
    """Several side fields in turn. Each entry names its ``kind``: side, bars or one."""
    for side in sides:
        kind, options = side["kind"], {k: v for k, v in side.items() if k != "kind"}
        panel = {"side": attach_side, "bars": attach_bars, "one": spread_one}[kind](panel, **options)
    return panel


def scheduled(panel: DataFrame, schedule: DataFrame, label: str, default: str = "_default") -> DataFrame:
    """The schedule entry in force at each bar; ``default`` before the first. Only the distinct times are looked up, then joined back."""
    times = panel.select(TS).distinct().withColumn("_all", F.lit(1))
    known = as_of(times, schedule.withColumn("_all", F.lit(1)), [label], key=["_all"])
    return panel.join(known.select(TS, F.coalesce(F.col(label), F.lit(default)).alias(label)), TS)


def active_at(times: DataFrame, positions: DataFrame, bucket: float = 7 * 86400) -> DataFrame:
    """Positions open at each time: ``opened <= t < closed``; one without a close is open. The latest opened wins for an instrument.

    Both sides are cut into buckets of time, which turns the range condition into an equality join. A position takes the buckets of its life
    within the range of ``times`` only.
    """
    def slot(c: str) -> Column:
        return F.floor(seconds(c) / F.lit(bucket))

    at = times.withColumn("_slot", slot("t"))
    span = F.broadcast(at.agg(F.min("_slot").alias("_low"), F.max("_slot").alias("_high")))   # one row
    first = F.greatest(slot("opened"), F.col("_low"))
    last = F.least(F.coalesce(slot("closed"), F.col("_high")), F.col("_high"))
    spread = positions.join(span).where(first <= last).withColumn("_slot", F.explode(F.sequence(first, last))).drop("_low", "_high")
    live = at.join(spread, "_slot").where((F.col("opened") <= F.col("t")) & (F.col("closed").isNull() | (F.col("t") < F.col("closed"))))
    rest = [c for c in positions.columns if c != ID]
    best = F.max_by(F.struct(*rest), F.struct("opened", *[c for c in rest if c != "opened"])).alias("p")
    return live.groupBy("t", ID).agg(best).select("t", ID, "p.*")


def aligned(factor: DataFrame, returns: DataFrame) -> DataFrame:
    return factor.join(returns, [ID, TS])


def rebalance_sets(held: DataFrame, target: DataFrame) -> DataFrame:
    """Instruments to close: held and not in the target."""
    return held.join(target.select(ID), ID, "left_anti")


def with_label(df: DataFrame, labels: DataFrame, key: str, label: str, other: str = "Other") -> DataFrame:
    """A looked-up label, with a name for what is not in the table."""
    return df.join(labels.select(key, label), key, "left").withColumn(label, F.coalesce(F.col(label), F.lit(other)))
