"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barley.llm.shared import drop, few, stash


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is its smallest id. No links, no rows.

    Alternates two steps until nothing changes: each node's larger neighbours move to its smallest neighbour, then each node and its smaller
    neighbours do. The number of links never grows and the rounds are logarithmic in the longest chain. Minima are partial sums, and the
    joins that hand them back may split a node with many neighbours. Each round is written to the shared folder, and takes few tasks where few
    links are left.
    """
    links = stash(few(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), links.count()), "links")
    before = _state(links)
    while before[0]:
        n, last = 2 * before[0], links
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = few(both.groupBy("a").agg(F.min("b").alias("m")), n).select("a", F.least("a", "m").alias("m"))
        large = few(both.join(least, "a"), n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = few(large.distinct(), n)
        least = few(large.groupBy("a").agg(F.min("b").alias("m")), n)
        small = few(large.join(least, "a"), n).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = stash(few(small.where("a <> b").distinct(), n), "links")
        drop(last)
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def _state(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
