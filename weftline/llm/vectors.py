"""Near-duplicate vectors by randomised-rotation binary codes.

Each vector, scaled to unit length, is turned by a random orthogonal matrix; its
code is the signs of the turned coordinates, and its correction factor is the
inner product of the code (as a unit vector) with the turned vector. The code's
inner product with a turned query, divided by the factor, is an unbiased estimate
of the cosine, with an error bound from the factor alone. A query's turned
coordinates are rounded to a byte each, and what that may change is added to the
bound. Codes, factors and rounded coordinates are worked out once and are all that
the search moves. Only vectors with a pair whose upper confidence bound reaches
the threshold are fetched, to the block of that pair, where such pairs are
recomputed exactly, in double precision.

Equal vectors of one group collapse to one with a weight first. Pairs are looked
for in shards: `tables` further rotations give each vector a key of sign bits for
each table. Tables are as many as a pair at the threshold needs to share a key
with probability `recall`; keys widen with the logarithm of the number of
vectors, so shards stay small. A pair that shares several keys counts in the
first table only, so links are counted without listing pairs; hot shards are cut
into blocks. Groups (labels), and vectors of unlike length, never meet.

Vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null label, link with nothing; each is its own component. Rows with
equal ids are separate vectors of that id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, dropped, mapped, saved
from .components import components
from .shards import ASKS, Union, blocked, groups

#: Rows of a block.
CAP = 512
#: Standard errors that an estimate may be off by.
SPREAD = 4.0


def rotation(dim: int, seed: int) -> np.ndarray:
    def build():
        q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
        return q * np.sign(np.diag(r))

    return cached(("rotation", dim, seed), build)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at unit length, without overflow."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def codes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (+1, -1) and correction factors of turned unit vectors."""
    signs = np.where(turned >= 0, 1.0, -1.0)
    return signs, np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def estimates(signs: np.ndarray, factors: np.ndarray, asked: np.ndarray, steps: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased cosine estimates (held x asked) and their error bounds. steps: to what multiples the asked coordinates are rounded."""
    dim = signs.shape[1]
    est = signs @ asked.T / math.sqrt(dim) / factors[:, None]
    bound = SPREAD * np.sqrt(np.maximum(1 - factors**2, 0) / factors**2 / max(dim - 1, 1))
    return est, bound[:, None] + np.atleast_1d(steps)[None, :] * (math.sqrt(dim) / 2) / factors[:, None]


def packed_codes(turned: np.ndarray) -> list[bytes]:
    """Of each row the factor and the step of its rounded coordinates (4 bytes each), its signs as bits, its coordinates in steps."""
    signs, factors = codes(turned)
    steps = (np.abs(turned).max(axis=1) / 127).astype("<f4")
    rounded = np.rint(turned / steps[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
    head = np.stack([factors.astype("<f4"), steps], axis=1)
    return [h.tobytes() + b.tobytes() + r.tobytes() for h, b, r in zip(head, np.packbits(signs > 0, axis=1), rounded, strict=True)]


def unpacked_codes(rows: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signs, factors, coordinates and steps."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    head = np.ascontiguousarray(raw[:, :8]).view("<f4").astype(np.float64)
    width = -(-dim // 8)
    signs = np.unpackbits(raw[:, 8 : 8 + width], axis=1, count=dim).astype(np.float32) * 2 - 1
    # A factor as a 4-byte number is off by its last place: far less than the bound.
    return signs, head[:, 0], raw[:, 8 + width :].view(np.int8).astype(np.float32) * head[:, 1:].astype(np.float32), head[:, 1]


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a key, tables)."""
    width = min(max(4, math.ceil(math.log2(max(n, 2))) - 6), 30)
    hit = (1 - math.acos(threshold) / math.pi) ** width
    return width, math.ceil(math.log(1 - recall) / math.log1p(-hit))


def packed(v: pa.Array, group: pa.Array) -> list[bytes | None]:
    """Each vector as bytes of doubles, or None if it can link with nothing."""
    offs = v.offsets.to_numpy().astype(np.int64)
    flat = v.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).astype("<f8")
    before = lambda x: np.concatenate([[0], np.cumsum(x)])
    bad, some = before(~np.isfinite(flat)), before(flat != 0)
    a, b = offs[:-1], offs[1:]
    good = (bad[b] == bad[a]) & (some[b] > some[a]) & v.is_valid().to_numpy(zero_copy_only=False) & group.is_valid().to_numpy(zero_copy_only=False)
    return [flat[x:y].tobytes() if ok else None for x, y, ok in zip(a.tolist(), b.tolist(), good.tolist(), strict=True)]


def prepared(rows: DataFrame, id_col: str, vector_col: str, group_col: str) -> DataFrame:
    """id, grp, vec binary (doubles; null if it can link with nothing)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("g"), pa.array(packed(b.column("v"), b.column("g")), pa.binary())], ["id", "grp", "vec"])

    kinds = rows.schema[id_col].dataType.simpleString(), rows.schema[group_col].dataType.simpleString()
    return rows.select(rows[id_col].alias("id"), rows[group_col].alias("g"), rows[vector_col].alias("v")).transform(mapped, run, f"id {kinds[0]}, grp {kinds[1]}, vec binary")


def coded(nodes: DataFrame, width: int, tables: int) -> DataFrame:
    """node, code, keys (those of all tables), shard (a hash of group, length and each table's key): what the search needs of each vector."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                vecs = part.column("vec").to_pylist()
                keys = np.empty((part.num_rows, tables), np.int32)
                packs: list = [None] * part.num_rows
                sizes = np.array([len(x) // 8 for x in vecs])
                for dim in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dim)
                    v = unit(np.frombuffer(b"".join(vecs[i] for i in rows), "<f8").reshape(len(rows), dim))
                    for i, c in zip(rows.tolist(), packed_codes(v @ rotation(int(dim), 0)), strict=True):
                        packs[i] = c
                    for t in range(tables):
                        # A key may be wider than the vector: then more rotations give its bits.
                        on = np.concatenate([v @ rotation(int(dim), 1 + t * 64 + r) >= 0 for r in range(-(-width // int(dim)))], axis=1)[:, :width]
                        keys[rows, t] = on @ (1 << np.arange(width))
                few = keys.astype("<u2") if width <= 16 else keys.astype("<u4")
                every = pa.array([k.tobytes() for k in few], pa.binary())
                listed = pa.array(list(keys), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("grp"), pa.array(sizes.astype(np.int32)), pa.array(packs, pa.binary()), every, listed], ["node", "grp", "dim", "code", "keys", "ks"])

    kind = nodes.schema["grp"].dataType.simpleString()
    return nodes.select("node", "grp", "vec").transform(mapped, run, f"node long, grp {kind}, dim int, code binary, keys binary, ks array<int>")


def first_tables(keys: list[bytes], width: int):
    """A function of two arrays of rows: the first table whose keys are equal."""
    k = np.frombuffer(b"".join(keys), "<u2" if width <= 16 else "<u4").reshape(len(keys), -1)
    return lambda p, q: (k[p] == k[q]).argmax(axis=1)


def pairs_of(likely, first, t: int):
    """(held, asked) pairs, block by block of a likelihood function of asked ranges, that count in table t."""
    for i, j in likely:
        for cut in range(0, len(i), 1 << 16):
            p, q = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
            own = (p != q) & (first(p, q) == t)
            yield p[own], q[own]


def likely_pairs(codes_: list[bytes], dim: int, held: np.ndarray, n: int, threshold: float):
    """(held, asked) row numbers whose upper confidence bound reaches the threshold."""
    signs, factors, turned, steps = unpacked_codes(codes_, dim)
    for at in range(0, n, 1024):
        est, bound = estimates(signs[held], factors[held], turned[at : at + 1024], steps[at : at + 1024])
        i, j = np.nonzero(est + bound >= threshold - 1e-6)
        yield held[i], j + at


def open_rows(batches, threshold: float, width: int):
    """key, block, role, node, t, dim, code, keys of the rows that have a pair in their block which the bounds leave open."""
    for g in groups(batches, ["key", "block"]):
        n, dim, t = g.num_rows, g.column("dim")[0].as_py(), g.column("t")[0].as_py()
        held = np.flatnonzero(g.column("role").to_numpy() != ASKS)
        found = np.zeros(n, bool)
        for p, q in pairs_of(likely_pairs(g.column("code").to_pylist(), dim, held, n, threshold), first_tables(g.column("keys").to_pylist(), width), t):
            found[p] = found[q] = True
        if found.any():
            yield from g.filter(pa.array(found)).select(["key", "block", "role", "node", "t", "dim", "code", "keys"]).to_batches()


def block_links(batches, threshold: float, width: int):
    """a, b, w: of each row that a block links, its set's first member and the weight of its links that count in this table."""
    for g in groups(batches, ["key", "block"]):
        n, dim, t = g.num_rows, g.column("dim")[0].as_py(), g.column("t")[0].as_py()
        v = np.frombuffer(b"".join(g.column("vec").to_pylist()), "<f8").reshape(n, -1)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        norm = np.linalg.norm(v, axis=1)
        weight = g.column("weight").to_numpy()
        held = np.flatnonzero(g.column("role").to_numpy() != ASKS)
        w, sets = np.zeros(n, np.int64), Union(n)
        for p, q in pairs_of(likely_pairs(g.column("code").to_pylist(), dim, held, n, threshold), first_tables(g.column("keys").to_pylist(), width), t):
            near = np.einsum("ij,ij->i", v[p], v[q]) / (norm[p] * norm[q]) >= threshold
            p, q = p[near], q[near]
            np.add.at(w, q, weight[p])
            for x, y in zip(p.tolist(), q.tolist(), strict=True):
                sets.join(x, y)
        root = np.array([sets.find(x) for x in range(n)])
        out = np.flatnonzero((root != np.arange(n)) | (w > 0))
        if len(out):
            node = g.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(node[root[out]]), pa.array(w[out])], ["a", "b", "w"])


def near_duplicates(rows: DataFrame, threshold: float = 0.98, recall: float = 0.995, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """id, n_links (other rows linked directly), component_id (smallest id reachable by links)."""
    own = saved(prepared(rows, id_col, vector_col, group_col).withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("grp", "vec"))))
    nodes = saved(own.where("vec is not null").groupBy("node", "grp", "vec").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first")))
    width, tables = plan(nodes.count(), threshold, recall)
    found = saved(coded(nodes, width, tables))
    shards = found.select("node", "grp", "dim", "code", "keys", F.posexplode("ks").alias("t", "k")).withColumn("key", F.xxhash64("grp", "dim", "t", "k")).drop("grp", "k")
    open_ = saved(blocked(shards, "key", "node", CAP).transform(mapped, lambda it: open_rows(it, threshold, width), "key long, block int, role int, node long, t int, dim int, code binary, keys binary"))
    fetched = open_.join(nodes.select("node", "vec", "weight").hint("shuffle_hash"), "node").repartition("key", "block").sortWithinPartitions("key", "block", "role")
    links = saved(fetched.transform(mapped, lambda it: block_links(it, threshold, width), "a long, b long, w long"))
    dropped(found, open_)
    parts = components(links.select("a", "b"))
    sums = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
    of = nodes.join(parts, "node", "left").join(sums, "node", "left").select("node", "first", F.coalesce("component", "node").alias("part"), (F.coalesce("w", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    low = of.groupBy("part").agg(F.min("first").alias("component_id"))
    named = of.join(low, "part").select("node", "n_links", "component_id")
    linked = own.where("vec is not null").select("id", "node").join(named, "node").select("id", "n_links", "component_id")
    alone = own.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)
