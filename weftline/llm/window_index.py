"""Incremental substring deduplication by a log-structured index of window fingerprints.

A window is `window` consecutive words of one document. Every word goes that is
covered by a window whose words also start earlier (in a document with a smaller
id, or earlier in the same one). The index holds what earlier batches had, as
immutable runs: tables in the shared folder, dealt into buckets by fingerprint and
sorted by it within each. A new batch is dealt the same way and merge-joined with
each run, bucket by bucket, so nothing of the index is moved but the rows that
match. What matches is verified window by window, from the texts again (an index
with the words or hashes of all windows would be larger than the texts), and the
batch's own fingerprints become a further run: the first occurrence of each that no
earlier run has. So no fingerprint is in two runs, and runs of one size are compacted
by dealing them into the buckets of one, without grouping.

Fingerprints are those of anchors (see anchors): an equal window has an equal
anchor at an equal place, so the index has about an eighth of a row for each
word. A run of windows whose whole content (a 128-bit digest of its words) is in the
index earlier is repeated. Of anchors with several contents the windows of first
occurrences are compared one by one, by anchor and a hash of their bytes (128 bits together),
and those that are not the first of their kind go.

Ids must be integers. A null id comes before all others; rows with equal ids are
ordered by a hash of id and text, and equal rows are one document. Null and
wordless texts have no windows. Batches must come in the order of ids. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import merged
from .common import PLAIN, cleaned, delete, dropped, mapped, pieces_of, saved, shared_dir, text_bytes
from .repeats import BLOCK, by_document, columns, find_runs, joined, with_key, word_elements

#: Words of an anchor.
ANCHOR = 5

PLACE = ("first", "doc", "start")


def window_rows(batches, window: int):
    """A row for each window of the listed runs, with a hash of its bytes."""
    for b in batches:
        for part in pieces_of(b, BLOCK):
            _, offs, raw, (low, high) = word_elements(part)
            lists = part.column("rows")
            r = lists.flatten()
            n, start = r.field("n").to_numpy(), r.field("start").to_numpy()
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            of = np.repeat(np.arange(len(n)), n)
            start = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            at = offs[row[of]] + start
            each = b"".join([blake2b(raw[x:y], digest_size=8).digest() for x, y in zip(low[at].tolist(), high[at + window - 1].tolist(), strict=True)])
            take, of = pa.array(row[of]), pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [r.field("anchor").take(of), pa.array(np.frombuffer(each, np.int64)), part.column("id").take(take), part.column("doc").take(take), pa.array(start.astype(np.int32)), r.field("new").take(of)],
                ["anchor", "hash", "first", "doc", "start", "new"],
            )


class WindowIndex:
    """The index. Its runs lie in the shared folder, and are known to the session's catalog; `close` deletes them. buckets: into how many each run is dealt, by default as a shuffle is."""

    def __init__(self, spark: SparkSession, window: int = 20, k: int = ANCHOR, fanout: int = 2, buckets: int | None = None):
        self.spark, self.window, self.k, self.fanout = spark, window, k, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []
        self.batches: list[DataFrame] = []
        self.compactions = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def sorted_run(self, rows: DataFrame) -> tuple[str, str]:
        """Rows of unlike fingerprints as a run: (table, folder)."""
        name = f"weftline_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark).rstrip('/')}/weftline-{name}"
        dealt = rows.repartition(self.buckets, "anchor").sortWithinPartitions("anchor")
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
        plain = ", ".join(f"'{k}' '{v}'" for k, v in PLAIN.items())
        self.spark.sql(f"create table {name} ({columns}) using parquet options ({plain}) clustered by (anchor) sorted by (anchor) into {self.buckets} buckets location '{path}'")
        with cleaned(self.spark):
            dealt.write.insertInto(name)
        return name, path

    def forget(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"drop table if exists {name}")
            delete(self.spark, path)

    def remember(self, fresh: DataFrame, level: int = 0) -> None:
        """Adds a run of fingerprints that no other run has; a full level becomes one run of the next."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.sorted_run(fresh))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            # Read as plain files: a union of bucketed scans may keep its buckets apart after planning has counted on them.
            both = functools.reduce(DataFrame.unionByName, [self.spark.read.parquet(path) for _, path in old])
            self.remember(both, level + 1)
            self.compactions += 1
            self.forget(old)

    def add(self, keyed: DataFrame, more: bool = True) -> DataFrame:
        """doc, start, n: runs of windows of a new batch (id, doc, text) that start earlier. more: whether another batch will come."""
        fresh = saved(find_runs(keyed, word_elements, self.window, self.k).drop("place"))
        every, earlier = fresh.withColumn("new", F.lit(True)), []
        if self.runs():
            asked = fresh.select("anchor").distinct()
            # A run lies as the join wants it: only the new batch's anchors are dealt out and sorted.
            met = [r.join(asked.hint("merge"), "anchor", "left_semi") for r in self.runs()]
            earlier = [saved(functools.reduce(DataFrame.unionByName, met).withColumn("new", F.lit(False)))]
            every = every.unionByName(earlier[0])
        total = every.count()
        of = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("content").alias("low"), F.max("content").alias("high"), F.min("second").alias("low2"), F.max("second").alias("high2"))
        of = saved(of.where("c > 1").select("anchor", "c", ((F.col("low") != F.col("high")) | (F.col("low2") != F.col("high2"))).alias("mixed")))
        # Anchors that occur once have a null here. They only matter to later batches.
        marked = saved(joined(every, of, ["anchor"], total, "left" if more else "inner").drop("c"))
        dropped(fresh, of, *earlier)
        some = marked.where("mixed is not null")
        contents = saved(some.groupBy("anchor", "content", "second").agg(F.min(F.struct(*PLACE, "n", "new")).alias("at"), F.max("mixed").alias("mixed"), F.count(F.lit(1)).alias("c")))
        copies = joined(some.where("new"), contents.where("c > 1").select("anchor", "content", "second", "at", "c"), ["anchor", "content", "second"], total)
        copies = copies.where(F.struct(*PLACE) > F.struct(*(f"at.{c}" for c in PLACE))).select("doc", "start", "n")
        # Of each content of a mixed anchor the windows of its first occurrence. (Equal rows are one document, and have one place.)
        reps = contents.where("mixed").select("anchor", "at.doc", "at.start", "at.n", "at.new")
        known = functools.reduce(DataFrame.unionByName, [*self.batches, keyed])
        size = self.window
        windows = saved(by_document(known, reps).select("id", "doc", "text", "rows").transform(mapped, lambda it: window_rows(it, size), "anchor long, hash long, first long, doc long, start int, new boolean"))
        heads = windows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*PLACE)).alias("at")).where("c > 1")
        heads = saved(heads)
        edges = joined(windows.where("new"), heads, ["anchor", "hash"], total * self.window).where(F.struct(*PLACE) > F.col("at")).select("doc", "start", F.lit(1).alias("n"))
        out = saved(copies.unionByName(edges))
        dropped(windows, heads)
        if more:
            # What is earlier in a run has its place there.
            single = marked.where("mixed is null").select("anchor", "content", "second", *PLACE, "n")
            self.remember(single.unionByName(contents.where("at.new").select("anchor", "content", "second", *(f"at.{c}" for c in (*PLACE, "n")))))
            self.batches.append(keyed)
        dropped(marked, contents)
        return out

    def close(self) -> None:
        self.forget([r for level in self.levels for r in level])
        self.levels = []


def deduplicate(docs: DataFrame, window: int = 20, batches: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, removed (array of [start, end) word spans), kept (the other words, joined by one space) of each row. Rows go through the index in `batches` ranges of ids."""
    keyed = with_key(docs, id_col, text_col).withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))))
    cuts = sorted(set(docs.select(docs[id_col].cast("double").alias("x")).approxQuantile("x", [k / batches for k in range(1, batches)], 0.02))) if batches > 1 else []
    index = WindowIndex(docs.sparkSession, window)
    parts = []
    bounds = [None, *cuts, None]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = keyed
        if low is not None:
            part = part.where(F.col("id") > low)
        if high is not None:
            part = part.where(F.col("id") <= high)
        parts.append(index.add(part, more=high is not None))
    index.close()
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)

    def run(batches):
        for b in batches:
            data, offs = text_bytes(b)
            raw = data.tobytes()
            n, removed, kept = [], [], []
            for i in range(b.num_rows):
                r = columns(b.column("rows")[i], ["start", "n"])
                words = raw[offs[i] : offs[i + 1]].split()  # at the bytes that no word has
                found = merged(r["start"], r["start"] + r["n"] + (window - 1))
                n.append(len(words))
                removed.append([{"start": s, "end": e} for s, e in found])
                left, at = [], 0
                for s, e in found:
                    left += words[at:s]
                    at = e
                kept.append(b" ".join(left + words[at:]).decode())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("own"), pa.array(n, pa.int64()), pa.array(removed, span), pa.array(kept, pa.string())], ["id", "n_words", "removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    whole = with_key(docs, id_col, text_col).withColumnRenamed("id", "own")
    return by_document(whole, spans, "left").select("own", "text", "rows").transform(mapped, run, f"id {kind}, n_words long, removed array<struct<start:long,end:long>>, kept string")
