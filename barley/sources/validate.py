"""Checks and repairs of raw bars. ``seq`` is the order in which rows arrived."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barley.operators.chunks import seconds, with_previous
from barley.operators.spec import ID, TS
from barley.sources import io

# Column names and types of a raw bar.
RAW_COLUMNS = {"open": "double", "high": "double", "low": "double", "close": "double", "volume": "double"}
PRICES = ("open", "high", "low", "close")


def schema_issues(raw: DataFrame, columns: dict[str, str] = RAW_COLUMNS) -> DataFrame:
    """``(column, issue, count)``: missing columns, and values that do not fit the type."""
    spark = raw.sparkSession
    missing = [c for c in columns if c not in raw.columns]
    present = [c for c in columns if c in raw.columns]
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(columns[c]).isNull()).alias(c) for c in present]
    found = raw.agg(*bad).unpivot([], present, "column", "count").where("count > 0")
    found = found.select("column", F.lit("type").alias("issue"), F.col("count"))
    if not missing:
        return found
    absent = spark.createDataFrame([(c, "missing", 1) for c in missing], found.schema)
    return found.unionByName(absent)


def duplicates(raw: DataFrame) -> DataFrame:
    return raw.groupBy(ID, TS).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def gaps(raw: DataFrame, interval: float, max_gap_bars: int) -> DataFrame:
    """Holes between neighbouring bars, in bars; an error beyond ``max_gap_bars``, else a warning."""
    once = raw.select(ID, TS).distinct()
    step = with_previous(once, [TS], [TS])
    missing = F.floor((seconds() - seconds(F.col("previous")[TS])) / F.lit(interval)) - 1
    return (step.withColumn("missing", missing.cast("bigint")).where("missing > 0")
            .select(ID, F.col("previous")[TS].alias("after"), F.col(TS).alias("before"), "missing",
                    F.when(F.col("missing") > max_gap_bars, "error").otherwise("warning").alias("severity")))


def out_of_order(raw: DataFrame, width: float = 100_000) -> DataFrame:
    """Rows that arrived at or before the time of the row received just earlier."""
    step = with_previous(raw, [TS], ["seq"], position=F.col("seq"), width=width)
    return step.where(F.col(TS) <= F.col("previous")[TS]).select(ID, "seq", TS, F.col("previous")[TS].alias("earlier"))


def rules() -> dict[str, Column]:
    """Broken rules of one bar, by name."""
    o, h, l, c = (F.col(p) for p in PRICES)
    return {
        "high_below_body": h < F.greatest(o, c),
        "low_above_body": l > F.least(o, c),
        "low_above_high": l > h,
        "price_not_positive": F.least(o, h, l, c) <= 0,
        "volume_negative": F.col("volume") < 0,
    }


def _broken() -> Column:
    return F.filter(F.array(*[F.when(b, F.lit(n)) for n, b in rules().items()]), lambda x: x.isNotNull())


def value_issues(raw: DataFrame) -> DataFrame:
    """One row per broken rule of a bar."""
    return raw.select(ID, TS, "seq", F.explode(_broken()).alias("rule"))


def _written(rows: DataFrame) -> DataFrame:
    folder = f"{io.scratch(rows.sparkSession)}/rows"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def report(raw: DataFrame, interval: float, max_gap_bars: int) -> DataFrame:
    """``(issue, count)`` and whether the bars pass. With a schema error the other checks are left out.

    The bars are made once and written to the checkpoint folder; each check reads the columns it needs.
    """
    raw = _written(raw)
    schema = schema_issues(raw).agg(F.lit("schema").alias("issue"), F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    clean = raw.where(schema.select(F.col("count") == 0).scalar())
    severities = gaps(clean, interval, max_gap_bars).agg(F.count_if(F.col("severity") == "error").alias("gap_error"),
                                                         F.count_if(F.col("severity") == "warning").alias("gap_warning"))
    parts = [schema,
             duplicates(clean).agg(F.lit("duplicate").alias("issue"), F.count(F.lit(1)).alias("count")),
             severities.unpivot([], ["gap_error", "gap_warning"], "issue", "count"),
             out_of_order(clean).agg(F.lit("order").alias("issue"), F.count(F.lit(1)).alias("count")),
             clean.agg(F.lit("value").alias("issue"), F.coalesce(F.sum(F.size(_broken())), F.lit(0)).alias("count"))]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("passed", (F.col("count") == 0) | (F.col("issue") == "gap_warning"))


def drop_duplicates(raw: DataFrame, keep: str = "first", count: str | None = None) -> DataFrame:
    """One row per instrument and time, the first or the last that arrived; with ``count``, a column of that name tells how many there were."""
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in raw.columns if c not in (ID, TS)]
    rows = raw.groupBy(ID, TS).agg(pick(F.struct(*rest), F.col("seq")).alias("r"), *([F.count(F.lit(1)).alias(count)] if count else []))
    return rows.select(ID, TS, "r.*", *([count] if count else []))


def fill_gaps(bars: DataFrame, interval: float, max_fill: int) -> DataFrame:
    """Fill holes of up to ``max_fill`` bars: the close before in all prices, no volume, ``was_filled``."""
    columns = [c for c in bars.columns if c not in (ID, TS)]
    step = with_previous(bars, [TS, "close"], [TS])
    missing = (F.floor((seconds() - seconds(F.col("previous")[TS])) / F.lit(interval)) - 1).cast("int")
    holes = step.withColumn("_n", missing).where((F.col("_n") > 0) & (F.col("_n") <= max_fill))
    made = holes.select(ID, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"), F.col("previous").alias("p"))
    start = F.unix_micros(F.col("p")[TS].cast("timestamp"))
    at = F.timestamp_micros((start + F.col("_i") * F.lit(int(interval * 1_000_000))).cast("bigint"))
    value = {c: F.col("p")["close"] if c in PRICES else F.lit(0.0) for c in columns}
    made = made.select(ID, at.cast(dict(bars.dtypes)[TS]).alias(TS),
                       *[v.cast(dict(bars.dtypes)[c]).alias(c) for c, v in value.items()], F.lit(True).alias("was_filled"))
    return bars.withColumn("was_filled", F.lit(False)).unionByName(made)


def split_invalid(bars: DataFrame) -> DataFrame:
    """All bars, with the broken rules joined in ``reasons``; null for a valid bar."""
    joined = F.array_join(_broken(), ";")
    return bars.withColumn("reasons", F.when(joined != "", joined))


def repair(raw: DataFrame, interval: float, max_fill: int) -> DataFrame:
    """Drop duplicates, fill gaps, drop invalid bars."""
    filled = fill_gaps(drop_duplicates(raw), interval, max_fill)
    return split_invalid(filled).where("reasons IS NULL").drop("reasons")


def repair_log(raw: DataFrame, interval: float, max_fill: int) -> DataFrame:
    """What ``repair`` does, as ``(instrument_id, action, count)``.

    The bars without repetitions are made once, with the number of rows of each, and written to the checkpoint folder; all counts come from them.
    """
    once = _written(drop_duplicates(raw, count="_rows"))
    counts = once.groupBy(ID).agg((F.sum("_rows") - F.count(TS)).alias("count"))
    later = split_invalid(fill_gaps(once.drop("_rows"), interval, max_fill)).groupBy(ID).agg(
        F.count_if("was_filled").alias("fill"), F.count("reasons").alias("drop_invalid"))
    log = counts.select(ID, F.lit("drop_duplicate").alias("action"), "count")
    return log.unionByName(later.unpivot([ID], ["fill", "drop_invalid"], "action", "count")).where("count > 0")


def coverage(bars: DataFrame, interval: float) -> DataFrame:
    """Rows, first and last time, and the share of the expected bars, per instrument."""
    expected = F.floor((seconds(F.max(TS)) - seconds(F.min(TS))) / F.lit(interval)) + 1
    return bars.groupBy(ID).agg(
        F.count(F.lit(1)).alias("rows"), F.min(TS).alias("first"), F.max(TS).alias("last"),
        (F.count_distinct(TS) / expected).alias("share"),
        F.when(F.count_distinct(TS) == expected, "complete").otherwise("gaps").alias("status"))
