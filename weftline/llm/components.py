"""Connected components of a link table, wholly on the executors.

Rounds of large-star and small-star steps: each node's larger, then smaller,
neighbours are tied to its smallest one, until nothing changes. A step is an
aggregation by node (combined before the shuffle) and an equi-join, whose skewed
keys the engine may split. Rounds grow as the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _largest(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _smallest(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of each node that links (columns a, b of one integer type) join with a smaller one. Loops and repeats are ignored."""
    e = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    while True:
        now = saved(_smallest(_largest(e)))
        dropped(e)
        row = now.agg(F.count(F.lit(1)), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))).first()
        e = now
        if tuple(row) == sign or row[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        sign = tuple(row)
