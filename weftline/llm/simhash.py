"""SimHash near-duplicates by Burkhard-Keller trees.

A text's fingerprint has a bit set where over half of its shingles' hashes have
it. Distinct fingerprints (copies collapse) are put into shards that every linked
pair shares at least one of; each shard builds a BK-tree, whose children are
keyed by their integer Hamming distance to the parent, and a query follows only
the edges within the radius of its own distance. What leaves a shard is at most
one link for each query and set of already linked fingerprints, so a group of
copies costs links in proportion to its size, not to its square. Shards are
dealt out over the cluster rather than broadcast, as fingerprints grow with the
data; a hot shard is cut into blocks that all its members ask.

`exact_shards` shares a shard whenever at most `radius` bits differ: the bits are
cut into radius + k bands, of which k must agree in such a pair, so each k bands
are a key. k grows with the number of fingerprints, from 2 (21 bits of a radius of
4), so that shards of unlike fingerprints stay small. `set_keys` serves wide radii, for which no such cut is
selective: a key is made of the least hashes of the shingle set under some
permutations, which two sets share with their Jaccard similarity. A pair at the
threshold shares a key with probability 0.995, whatever the number of documents.

Near duplicates of the pipeline are joined by exact similarity: groups that the
fingerprints link are only candidates, whose shingle sets are then compared, those
of a large group block by block.

Null and wordless texts have the fingerprint zero, and link as any other.
Texts with fewer words than a shingle have one shingle. Rows with equal ids are
separate documents of that id.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, mapped, saved, texts
from .components import components
from .repeats import doc_key, with_key
from .shards import ASKS, Union, blocked, groups

#: Rows of a block.
CAP = 512
#: Least hashes of a key of a shingle set, and the probability that a pair at the threshold shares a key.
WIDTH, RECALL = 3, 0.995


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words of the lower-cased text."""
    words = WORD_BYTES.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = len(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    to, digest = (ends[size - 1 :] - 1).tolist(), xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: n - size + 1].tolist(), to, strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that over half of h have."""
    n = len(h)
    if n == 0:
        return 0
    # A byte for each bit; 255 rows at a time add up as 64-bit words without a carry between bytes.
    bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").reshape(n, 64)
    lanes = bits.view(np.uint64)
    cuts = np.arange(0, n, 255)
    sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.uint64)[0])


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the same shingle for each k (a splitmix finaliser)."""
    if k == 0:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, size: int, words: int = 1) -> bytes:
    """words * 8 bytes, the first word first, its lowest byte last."""
    h = shingle_hashes(text.encode(), size)
    return b"".join(majority(mixed(h, k)).to_bytes(8, "big") for k in range(words))


def fingerprints(docs: DataFrame, size: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp binary of each row."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, size, words) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps, pa.binary())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).transform(mapped, run, f"id {kind}, fp binary")


class BKTree:
    """A tree of fingerprints (as integers) with the caller's numbers."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    def add(self, fp: int, number: int) -> None:
        node = (fp, number, {})
        if self.root is None:
            self.root = node
            return
        at = self.root
        while True:
            d = (at[0] ^ fp).bit_count()
            nxt = at[2].get(d)
            if nxt is None:
                at[2][d] = node
                return
            at = nxt

    def within(self, fp: int, radius: int) -> list[int]:
        if self.root is None:
            return []
        found, todo = [], [self.root]
        while todo:
            value, number, children = todo.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                found.append(number)
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


def shard_links(batches, radius: int):
    """Links (a, b: node numbers) that join the fingerprints of each block within the radius."""
    for g in groups(batches, ["key", "block"]):
        fps = [int.from_bytes(x, "big") for x in g.column("fp").to_pylist()]
        nodes = g.column("node").to_pylist()
        roles = g.column("role").to_pylist()
        tree, sets, out_a, out_b = BKTree(), Union(len(fps)), [], []
        for i, (fp, role) in enumerate(zip(fps, roles, strict=True)):  # the block's own rows come first
            for j in tree.within(fp, radius):
                if sets.join(i, j):
                    out_a.append(nodes[i])
                    out_b.append(nodes[j])
            if role != ASKS:
                tree.add(fp, i)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def bands(bits: int, n: int) -> list[tuple[int, int]]:
    cuts = [bits * k // n for k in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def agreeing(n: int, radius: int) -> int:
    """How many bands a key has: the fewest whose bits number n fingerprints to some tens a shard. At most 5, as keys grow with the binomial coefficient."""
    return next((k for k in range(2, 5) if 64 * k // (radius + k) >= math.log2(max(n, 2)) - 5), 5)


def exact_shards(nodes: DataFrame, radius: int, agree: int = 2) -> DataFrame:
    """node, fp, key: 64-bit fingerprints under each choice of `agree` of radius + agree bands."""
    value = F.conv(F.hex("fp"), 16, -10).cast("long")
    masks = [sum(((1 << (b - a)) - 1) << a for a, b in some) for some in combinations(bands(64, radius + agree), agree)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("_v").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)))
    return nodes.withColumn("_v", value).select("node", "fp", F.explode(keys).alias("key"))


def set_keys(h: np.ndarray, similarity: float, recall: float, width: int) -> np.ndarray:
    """Keys of a set's sorted hashes, each made of its least hashes under `width` permutations; as many as two sets at the similarity need to share one with probability `recall`."""
    tables = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**width)))
    if not len(h):
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(7)
    flip, times = rng.integers(0, 2**64, (2, tables * width, 1), np.uint64)
    least = np.full(tables * width, ~np.uint64(0))
    for at in range(0, len(h), 4096):
        x = (h[None, at : at + 4096] ^ flip) * (times | np.uint64(1))
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(m.tobytes(), k) for k, m in enumerate(least.reshape(tables, width))], np.uint64).view(np.int64)


def classes(fps: DataFrame, radius: int) -> DataFrame:
    """id, fp, component_id (the smallest id reachable over links of at most `radius` bits) of saved rows id, fp."""
    # The fingerprint itself is the node's name.
    nodes = saved(fps.groupBy("fp").agg(F.min("id").alias("first")).withColumn("node", F.conv(F.hex("fp"), 16, -10).cast("long")))
    shards = exact_shards(nodes.select("node", "fp"), radius, agreeing(nodes.count(), radius))
    links = blocked(shards, "key", "node", CAP).transform(mapped, lambda it: shard_links(it, radius), "a long, b long")
    parts = components(links)
    of = nodes.join(parts, "node", "left").select("fp", "first", F.coalesce("component", "node").alias("part"))
    low = of.groupBy("part").agg(F.min("first").alias("component_id"))
    names = of.join(low, "part").select("fp", "component_id")
    return fps.join(names, "fp").select("id", "fp", "component_id")


def shingle_sets(docs: DataFrame, size: int, similarity: float, words: int) -> DataFrame:
    """id, doc, node (a hash of the set of shingles), fp and set_keys of the distinct shingles of each row of docs (id, doc, text)."""

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t.encode(), size)) for t in texts(b)]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            fps = [b"".join(majority(mixed(h, k)).to_bytes(8, "big") for k in range(words)) for h in sets]
            keys = pa.array([set_keys(h, similarity, RECALL, WIDTH) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("doc"), pa.array(node), pa.array(fps, pa.binary()), keys], ["id", "doc", "node", "fp", "keys"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.transform(mapped, run, f"id {kind}, doc long, node long, fp binary, keys array<long>")


def is_near(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted arrays without repeats reaches `similarity`."""
    if len(a) < len(b):
        a, b = b, a
    if len(b) < similarity * len(a) - 1:
        return False
    if not len(a):
        return True
    at = a.searchsorted(b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both) >= similarity


def verified_links(batches, similarity: float):
    """Links (a, b) that join the sets of each block whose exact similarity suffices: at most one for each set and class of already linked ones."""
    for g in groups(batches, ["part", "block"]):
        sets = [np.frombuffer(x, np.uint64) for x in g.column("shingles").to_pylist()]
        nodes, roles = g.column("node").to_pylist(), g.column("role").to_pylist()
        held: list[list[int]] = []
        out_a, out_b = [], []
        for i, role in enumerate(roles):  # the block's own rows come first
            hit, rest = [], []
            for members in held:
                j = next((j for j in members if nodes[i] != nodes[j] and is_near(sets[i], sets[j], similarity)), None)
                if j is None:
                    rest.append(members)
                    continue
                hit += members
                out_a.append(nodes[i])
                out_b.append(nodes[j])
            own = hit if role == ASKS else [*hit, i]
            held = [*rest, own] if own else rest
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def verified(docs: DataFrame, nodes: DataFrame, parts: DataFrame, size: int, similarity: float) -> DataFrame:
    """a, b: links between nodes (node, doc) of one part whose shingle sets, made anew from the rows of docs (doc, text), are similar enough."""
    member = parts.select("node", F.col("component").alias("part")).union(parts.select(F.col("component").alias("node"), F.col("component").alias("part")).distinct())
    asked = saved(blocked(member.join(nodes.select("node", "doc"), "node"), "part", "node", CAP))
    rows = docs.select("doc", "text").join(asked.hint("shuffle_hash"), "doc").dropDuplicates(["doc", "block"])

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t.encode(), size)).tobytes() for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("block"), b.column("role"), b.column("node"), pa.array(sets, pa.binary())], ["part", "block", "role", "node", "shingles"])

    sets = rows.transform(mapped, run, "part long, block int, role int, node long, shingles binary")
    dealt = sets.repartition("part", "block").sortWithinPartitions("part", "block", "role")
    return dealt.transform(mapped, lambda it: verified_links(it, similarity), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, doc (a hash of id and text), fp, component_id, kept: documents joined over pairs whose shingle sets have that Jaccard similarity. kept tells the row of the smallest id (then doc), null ids last.

    Fingerprints of words * 64 bits of the distinct shingles tell which pairs may
    have it (five standard errors allowed: in texts of few shingles the bits differ
    more often than by the angle); the sets of such groups are compared before they
    are joined.
    """
    bits = 64 * words
    cosine = 2 * similarity / (1 + similarity)
    share = math.acos(cosine) / math.pi
    radius = round(bits * share + 5 * math.sqrt(bits * share * (1 - share)))
    own = with_key(docs, id_col, text_col)
    rows = saved(shingle_sets(own, size, similarity, words))
    nodes = rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("doc").alias("doc"), F.min("keys").alias("keys")).transform(saved)
    shards = nodes.select("node", "fp", F.explode("keys").alias("key"))
    links = blocked(shards, "key", "node", CAP).transform(mapped, lambda it: shard_links(it, radius), "a long, b long")
    parts = components(verified(own, nodes, components(links), size, similarity))
    of = rows.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    low = of.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc")).alias("first"))
    return of.join(low, "part").select("id", "doc", "fp", F.col("first.id").alias("component_id"), (F.col("doc") == F.col("first.doc")).alias("kept"))


def linked(docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (8 bytes), component_id: documents joined where at most `radius` bits of the 64-bit fingerprints differ."""
    return classes(saved(fingerprints(docs, size, 1, id_col, text_col)), radius)


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near_duplicates: the one with the smallest id, null ids last. Rows are told apart by id and text, so that unlike texts of one id, or of none, stay; of rows equal in both, any one."""
    found = near_duplicates(docs, size, similarity, words, id_col, text_col)
    kept = saved(found.where("kept").groupBy(F.col("doc").alias("_kept")).agg(F.count(F.lit(1)).alias("_n")))
    keyed = docs.withColumn("_doc", doc_key(docs, id_col, text_col))
    out = keyed.join(kept.select("_kept").hint("shuffle_hash"), F.col("_doc") == F.col("_kept"), "left_semi")
    return (out.dropDuplicates(["_doc"]) if kept.where("_n > 1").limit(1).count() else out).drop("_doc")
