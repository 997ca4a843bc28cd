"""Readers and writers of bars, side data, ticks and factor tables."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barley.operators.spec import ID, TS
from barley.session import shared_folder

# Column layouts of the raw files.
BAR_CSV = ("timestamp bigint, open double, high double, low double, close double, volume double, quote_volume double, "
           "trades_count bigint, taker_buy_base_volume double, taker_buy_quote_volume double")
TRADE_CSV = "exchange string, symbol string, timestamp bigint, local_timestamp bigint, id string, side string, price double, amount double"
QUOTE_CSV = ("exchange string, symbol string, timestamp bigint, local_timestamp bigint, ask_amount double, ask_price double, "
             "bid_price double, bid_amount double")
#: .../<symbol>/<timeframe>/<file>
PATH = r"([^/]+)/([^/]+)/[^/]*$"


def scratch(spark: SparkSession) -> str:
    """A new folder for a table, in the shared folder."""
    return f"{shared_folder(spark)}/barley-{uuid.uuid4().hex}"


def read_bar_csv(spark: SparkSession, path: str, schema: str = BAR_CSV, header: bool = True) -> DataFrame:
    """Raw bars with the symbol and timeframe of their folder."""
    rows = spark.read.schema(schema).option("header", header).option("recursiveFileLookup", True).csv(path)
    name = F.input_file_name()
    return rows.select(F.regexp_extract(name, PATH, 1).alias("symbol"), F.regexp_extract(name, PATH, 2).alias("timeframe"), "*")


def bars_to_catalog(raw: DataFrame, path: str, price_digits: int = 2, size_digits: int = 3, venue: str = "") -> None:
    """Raw bars to a table by instrument: millisecond times to timestamps, values to the instrument's precision."""
    prices = [F.bround(c, price_digits).alias(c) for c in ("open", "high", "low", "close")]
    out = raw.select(F.concat("symbol", F.lit(venue)).alias(ID), F.timestamp_millis("timestamp").alias(TS), *prices,
                     F.bround("volume", size_digits).alias("volume"), "quote_volume")
    out.repartition(ID, F.pmod(F.month(TS), F.lit(4))).write.mode("overwrite").partitionBy(ID).parquet(path)


def _write_catalog(rows: DataFrame, path: str) -> None:
    """One folder per instrument. Folders that ``rows`` touch are replaced, so that a second run does not double them; rows of an instrument meet
    in few files (a hot one's are spread over some by their day)."""
    day = F.pmod(F.datediff(TS, F.lit("1970-01-01")), F.lit(4))
    rows.repartition(ID, day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(ID).parquet(path)


def side_to_catalog(spark: SparkSession, csv: str, path: str, field: str, instrument: str | None = None, column: str = "value",
                    time: str = "timestamp", exact: bool = False) -> None:
    """``time,value`` CSVs (funding rate, open interest, vendor metric) to a table, many instruments in one job.

    The instrument is the folder of a file (``<symbol>`` or ``symbol=<symbol>``), or ``instrument`` for all of them. ``exact`` keeps decimals as they are
    written; otherwise values are doubles.
    """
    value_type = "decimal(38,18)" if exact else "double"
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).schema(f"{time} bigint, {column} {value_type}").csv(csv)
    folder = F.regexp_extract(F.input_file_name(), r"(?:symbol=)?([^/=]+)/[^/]*$", 1)
    rows = rows.select((folder if instrument is None else F.lit(instrument)).alias(ID), F.timestamp_millis(time).alias(TS), F.col(column).alias(field))
    _write_catalog(rows, path)


def ticks_to_catalog(spark: SparkSession, csv: str, path: str, kind: str = "trades") -> None:
    """Trade or quote files (gzip or plain) with microsecond times to a table by symbol."""
    schema = TRADE_CSV if kind == "trades" else QUOTE_CSV
    rows = spark.read.schema(schema).option("header", True).csv(csv)
    rows = rows.withColumn(TS, F.timestamp_micros("timestamp")).withColumnRenamed("symbol", ID)
    _write_catalog(rows.drop("timestamp", "local_timestamp", "exchange"), path)


def definition_hash(definitions: dict) -> str:
    """Hash of a set's definition, for telling whether a stored table is still valid."""
    return hashlib.sha256(json.dumps(definitions, sort_keys=True, default=str).encode()).hexdigest()


def write_factors(values: DataFrame, path: str, key: str) -> None:
    """Store long factor values under their definition's hash."""
    values.withColumn("definition", F.lit(key)).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("definition", "factor").parquet(path)


def read_factors(spark: SparkSession, path: str, key: str, factors: list[str] | None = None) -> DataFrame:
    """Stored values of a definition. Only the folders asked for are read; none when the definition changed."""
    rows = spark.read.parquet(path).where(F.col("definition") == key).drop("definition")
    return rows if factors is None else rows.where(F.col("factor").isin(factors))


def is_stored(spark: SparkSession, path: str, key: str) -> bool:
    return not spark.read.parquet(path).where(F.col("definition") == key).limit(1).isEmpty()


def to_snapshots(values: DataFrame, factors: list[str]) -> DataFrame:
    """Long factor values to one row per time and instrument."""
    return values.groupBy(TS, ID).pivot("factor", factors).agg(F.first("value"))


def write_csv(values: DataFrame, path: str) -> None:
    values.write.mode("overwrite").option("header", True).csv(path)
