"""Exact substring deduplication by merging Burrows-Wheeler orders of text shards.

Every byte covered by a string of `window` bytes that also starts anywhere else
goes. Suffix orders are only worked out where a string can repeat at all: of each
window, an anchor (see anchors) tells that. Anchors that occur once are unique
text. A run of windows whose whole content occurs again is repeated; contents are
told apart by a 128-bit BLAKE2 digest of their bytes. What is left are anchors with
several contents, the edges of repeated passages; their stretches of text are the
shards whose orders are merged, byte by byte.

The merge is the iterative interleave refinement of Holt and McMillan: an
interleave of the shards' suffixes starts with all of them in one interval for
each anchor, and each round takes the symbol in front of each suffix (its entry in
the Burrows-Wheeler transform) and deals the interleave out stably by that symbol.
After h rounds the suffixes are in the order of their first h bytes, and intervals
of equal ones are known; the round in which neighbours part tells their common
prefix. Nothing is re-sorted, no rank is recomputed. As only common prefixes of
`window` bytes matter, an interval of one suffix is dropped when it arises, and of
each shard only those suffixes are followed that reach a window's start in the last
round: no shard's transform is stored as a whole.

An interval of more than `cap` stretches is split by its next symbols before it is
merged: windows that reach far behind the anchor by the bytes that follow it, the
others by the bytes before it (each window has (window - anchor) / 2 of one or the
other, and equal windows have them alike). What is still too large after that is
split by all the symbols of its windows, which are then equal or not (a 128-bit
digest, combined before the shuffle). So intervals of any size take the same steps,
and no task gets more than `cap` stretches of one interval.

Null texts are empty. Matches never cross rows; rows with equal ids are separate
texts (equal rows repeat each other). Other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import merged
from .common import dropped, mapped, saved, text_bytes
from .repeats import HOT_KEYS, by_document, byte_elements, columns, find_runs, joined, with_key

#: Bytes of an anchor.
ANCHOR = 32
#: Stretches of an interval that are merged in one task: up to 0.2 million windows.
CAP = 1024
#: Windows refined at a time.
ROUND = 1 << 19


def refined(data: np.ndarray, starts: np.ndarray, interval: np.ndarray, window: int) -> np.ndarray:
    """Which windows (at starts in data) share all their bytes with another of their interval. interval: sorted numbers."""
    order = np.arange(len(starts))
    for h in range(window):
        if not len(order):
            break
        symbol = data[starts[order] + (window - 1 - h)]
        deal = np.argsort(symbol, kind="stable")
        order, interval, symbol = order[deal], interval[deal], symbol[deal]
        parts = np.empty(len(order), bool)
        parts[0] = True
        parts[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        last = np.append(parts[1:], True)
        keep = ~(parts & last)
        interval = np.cumsum(parts)[keep]
        order = order[keep]
    out = np.zeros(len(starts), bool)
    out[order] = True
    return out


def merge_shards(batches, window: int):
    """doc, start, n of runs of windows that repeat, of the stretches that stand for themselves only. Stretches come sorted by part."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(table: pa.Table):
        n = table.column("n").to_numpy()
        anchor = table.column("part").to_numpy()
        text = table.column("text").combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks)
        _, offs, raw = text.buffers()
        o = np.frombuffer(offs, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(raw, np.uint8)
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = refined(data, o[:-1][row] + within, np.cumsum(np.append(True, anchor[1:] != anchor[:-1]))[row], window)
        found &= (table.column("c").to_numpy() == 1)[row]
        new = found & ~np.append(False, found[:-1] & (row[1:] == row[:-1]))
        at = np.flatnonzero(new)
        count = np.bincount(np.cumsum(new)[found] - 1, minlength=len(at))
        doc, start = table.column("doc").to_numpy(), table.column("start").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(doc[row[at]]), pa.array((start[row[at]] + within[at]).astype(np.int32)), pa.array(count.astype(np.int32))], ["doc", "start", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += int(b.column("n").to_numpy().sum())
        if size >= ROUND:
            t = pa.Table.from_batches(held).combine_chunks()
            anchor = t.column("part").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                yield flush(t.slice(0, cut))
                t = t.slice(cut)
            held, size = t.to_batches(), int(t.column("n").to_numpy().sum())
    if held:
        yield flush(pa.Table.from_batches(held).combine_chunks())


STRETCH = "part long, doc long, start int, n int, c long, text binary"


def stretches(batches, window: int, k: int):
    """The text of each listed run, under its anchor; a run of a crowded anchor in up to two parts, by the symbols behind the anchor or before it."""
    side = (window - k) // 2
    for b in batches:
        data, offs = text_bytes(b)
        out: list[tuple] = []
        for i in range(b.num_rows):
            r = columns(b.column("rows")[i], ["anchor", "start", "n", "place", "c", "crowded"])
            own = data[offs[i] : offs[i + 1]].tobytes()
            doc = b.column("doc")[i].as_py()
            for a, s, n, place, c, crowded in zip(*(r[x].tolist() for x in ("anchor", "start", "n", "place", "c", "crowded")), strict=True):
                if not crowded:
                    out.append((a, doc, s, n, c, own[s : s + n + window - 1]))
                    continue
                at = s + place
                # From this start on, windows hold `side` bytes behind the anchor.
                turn = min(max(at + k + side - window, s), s + n)
                for low, high, symbols in ((s, turn, b"<" + own[at - side : at]), (turn, s + n, b">" + own[at + k : at + k + side])):
                    if high > low:
                        part = xxhash.xxh64_intdigest(symbols, a & (1 << 63) - 1)
                        out.append((part - (1 << 64) * (part >> 63), doc, low, high - low, c, own[low : high + window - 1]))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        columns_ = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns_, kinds, strict=True)], ["part", "doc", "start", "n", "c", "text"])


def each_window(batches, window: int):
    """A row for each window of stretches, with a digest of its bytes."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            n = part.column("n").to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text = part.column("text").to_pylist()
            raw = b"".join([blake2b(text[r][k : k + window], digest_size=16).digest() for r, k in zip(row.tolist(), within.tolist(), strict=True)])
            h = np.frombuffer(raw, np.int64).reshape(-1, 2)
            take = pa.array(row)
            start = pa.array((part.column("start").to_numpy()[row] + within).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("part").take(take), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), part.column("doc").take(take), start, part.column("c").take(take)], ["part", "h1", "h2", "doc", "start", "times"])


def repeated_spans(keyed: DataFrame, window: int, k: int = ANCHOR, cap: int = CAP) -> DataFrame:
    """doc, start, n: runs of windows that occur elsewhere too."""
    name = ["anchor", "content", "second"]
    every = saved(find_runs(keyed, byte_elements, window, k).drop("first"))
    total = every.count()
    of = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), *(f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in ("content", "second")))
    mixed = (F.col("min_content") != F.col("max_content")) | (F.col("min_second") != F.col("max_second"))
    of = saved(of.where("c > 1").select("anchor", "c", mixed.alias("mixed")))
    some = saved(joined(every, of, ["anchor"], total).drop("c"))
    dropped(every, of)
    plain = some.where("not mixed").select("doc", "start", "n")
    mixed = some.where("mixed").drop("mixed")
    contents = saved(mixed.groupBy(*name).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "start", "n", "place")).alias("at")))
    crowd = saved(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > cap))
    reps = contents.select("anchor", F.col("c").alias("times"), "at.*").join(F.broadcast(crowd.where(F.col("c") > total // HOT_KEYS).select("anchor", F.lit(True).alias("hot"))), "anchor", "left")
    reps = reps.join(crowd.where(F.col("c") <= total // HOT_KEYS).select("anchor", F.lit(True).alias("many")), "anchor", "left")
    reps = reps.select("anchor", "doc", "start", "n", "place", F.col("times").alias("c"), F.coalesce("hot", "many", F.lit(False)).alias("crowded"))
    texts = saved(by_document(keyed, reps).select("doc", "text", "rows").transform(mapped, lambda it: stretches(it, window, k), STRETCH))
    parts = texts.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    big = saved(parts.where(F.col("c") > cap))
    # There are at most (stretches / cap) of these.
    shards = texts.join(big.select("part"), "part", "left_anti")
    edges = shards.repartition("part").sortWithinPartitions("part").transform(mapped, lambda it: merge_shards(it, window), "doc long, start int, n int")
    windows = saved(texts.join(big.select("part"), "part", "left_semi").transform(mapped, lambda it: each_window(it, window), "part long, h1 long, h2 long, doc long, start int, times long"))
    again = saved(windows.groupBy("part", "h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.sum("times").alias("sum")).where("sum > 1").drop("sum"))
    crowded = joined(windows.where("times = 1"), again, ["part", "h1", "h2"], total * window).select("doc", "start", F.lit(1).alias("n"))
    copies = joined(mixed, contents.where("c > 1").select(*name, "c"), name, total).select("doc", "start", "n")
    return plain.unionByName(edges).unionByName(crowded).unionByName(copies)


def deduplicate(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, removed (array of [start, end) byte spans), kept (the other bytes, joined) of each row."""
    keyed = with_key(docs, id_col, text_col)
    spans = repeated_spans(keyed, window)

    def run(batches):
        for b in batches:
            data, offs = text_bytes(b)
            removed, kept = [], []
            for i in range(b.num_rows):
                r = columns(b.column("rows")[i], ["start", "n"])
                own = data[offs[i] : offs[i + 1]]
                found = merged(r["start"], r["start"] + r["n"] + (window - 1))
                keep = np.ones(len(own), bool)
                for s, e in found:
                    keep[s:e] = False
                removed.append([{"start": s, "end": e} for s, e in found])
                kept.append(own[keep].tobytes())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(offs)), pa.array(removed, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return by_document(keyed, spans, "left").select("id", "text", "rows").transform(mapped, run, f"id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
