"""Pair search within shards of bounded size.

Rows that share a key form a shard. Each shard is cut into blocks of at most
`cap` rows: a row belongs to one block and asks all blocks of its shard, so every
ordered pair of a shard meets once and no task gets a whole hot shard. Shards of
one row are left out. Blocks come to the worker as sorted runs of one partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A row that its block holds and that asks it, that the block holds only, that asks only.
BOTH, HELD, ASKS = 0, 1, 2


def blocked(rows: DataFrame, key: str, item: str, cap: int) -> DataFrame:
    """rows with columns block and role, dealt out by (key, block) and sorted within partitions."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    n = F.ceil(F.col("_n") / F.lit(cap)).cast("int")
    own = F.pmod(F.xxhash64(item), n).cast("int")
    roles = F.when(F.col("_n") <= cap, F.array(F.struct(F.lit(0).alias("block"), F.lit(BOTH).alias("role")))).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("block"), F.when(k == own, BOTH).otherwise(ASKS).alias("role")))
    )
    out = rows.join(counts, key).withColumn("_at", F.explode(roles)).select(*rows.columns, "_at.block", "_at.role")
    return out.repartition(key, "block").sortWithinPartitions(key, "block", "role")


def groups(batches, names: list[str]) -> Iterator[pa.Table]:
    """Runs of equal (names) in sorted batches."""
    left: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if left is not None:
            t = pa.concat_tables([left, t]).combine_chunks()
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for name in names:
            c = t.column(name).to_numpy()
            change |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s > 1:
                yield t.slice(s, e - s)
        left = t.slice(cuts[-1])
    if left is not None and left.num_rows > 1:
        yield left


class Union:
    """Disjoint sets of small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


Worker = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
