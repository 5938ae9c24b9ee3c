"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to a budget of character edits (a
share of its length). Cut into budget + 1 pieces, at least one piece of it then
occurs unchanged: one pass over the document with an automaton of all pieces
finds them. Around each hit, at the place where the item would lie, Myers'
bit-parallel recurrence gives the least edit distance of the item to any part of
the text; hits of one item that overlap are verified together.

Texts and items are compared lower-cased and with runs of white space as one
space. Items shorter than `shortest` characters after that have a budget of 0 and
match where they stand between word boundaries only (no letter or digit goes on at
either end). Null and empty items, and null documents, match nothing. Items with
equal ids (of any type) count as one, by their nearest match; of equally near
parts of a text the first counts. Equal rows of documents give one row of the
result. Other columns are ignored. The items are the query set: they are taken in
blocks of bounded bytes, each broadcast and held against all documents.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import latest, mapped, texts

#: Bytes of normalised items in a broadcast block.
BLOCK_BYTES = 4 << 20
#: Characters below which an item must occur unchanged, as whole words.
SHORTEST = 25


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, share: float, shortest: int = SHORTEST) -> int:
    return int(length * share) if length >= shortest else 0


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of nearly equal length."""
    n = errors + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Pattern:
    """One item for Myers' recurrence."""

    def __init__(self, item: str):
        self.m, self.bits = len(item), {}
        for i, c in enumerate(item):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def nearest(self, text: str) -> tuple[int, int]:
        """(least distance of the item to a part of the text, first end of such a part)."""
        m, bits = self.m, self.bits
        mask, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best, end = mask, 0, m, m, 0
        for i, c in enumerate(text):
            eq = bits.get(c, 0)
            v = eq | down
            h = (((eq & up) + up) ^ up) | eq
            plus = down | (mask & ~(h | up))
            minus = up & h
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
                if score < best:
                    best, end = score, i + 1
            plus <<= 1
            minus <<= 1
            up = (minus | ~(v | plus)) & mask
            down = plus & v & mask
        return best, end


class Block:
    """Items of one block, their pieces in one automaton."""

    def __init__(self, items: list[tuple[object, str]], share: float, shortest: int = SHORTEST):
        import ahocorasick

        self.items, self.errors = items, [budget(len(t), share, shortest) for _, t in items]
        self.whole = [len(t) < shortest for _, t in items]
        places = defaultdict(list)
        for k, (_, t) in enumerate(items):
            for offset, piece in pieces(t, self.errors[k]):
                places[piece].append((k, offset + len(piece) - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, at)
        if places:
            self.automaton.make_automaton()
        self.some = bool(places)
        self.patterns: dict[int, tuple[Pattern, Pattern]] = {}

    def matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Item number: (distance, start, end) of its nearest part of the normalised text within the budget, the first of equals."""
        places = defaultdict(set)
        for end, at in self.automaton.iter(text) if self.some else ():
            for k, offset in at:
                places[k].add(end - offset)
        found = {}
        for k, starts in places.items():
            item, errors = self.items[k][1], self.errors[k]
            for low, high in runs(sorted(starts), 2 * errors + 1):
                if k in found and found[k][0] == 0:
                    break
                got = self.verify(k, item, errors, text, low, high)
                if got and (k not in found or got < found[k]):
                    found[k] = got
        return found

    def verify(self, k: int, item: str, errors: int, text: str, low: int, high: int):
        if self.whole[k]:
            # An item of one piece: its hits are the places where it occurs.
            at = next((x for x in range(max(low, 0), high + 1) if text.startswith(item, x) and stands_alone(text, x, x + len(item))), None)
            return None if at is None else (0, at, at + len(item))
        if low == high and low >= 0 and text.startswith(item, low):
            return (0, low, low + len(item))
        if k not in self.patterns:
            self.patterns[k] = Pattern(item), Pattern(item[::-1])
        forth, back = self.patterns[k]
        at = max(0, low - errors)
        window = text[at : high + len(item) + errors]
        d, end = forth.nearest(window)
        if d > errors:
            return None
        # Read backwards from the end found, the item's start is where the same distance is reached first.
        _, length = back.nearest(window[:end][::-1])
        return (d, at + end - length, at + end)


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over either end of text[start:end]."""
    joined = lambda k: 0 < k < len(text) and text[k - 1].isalnum() and text[k].isalnum()
    return not joined(start) and not joined(end)


def runs(numbers: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of sorted numbers that are at most gap apart."""
    first = last = numbers[0]
    for x in numbers[1:]:
        if x - last > gap:
            yield first, last
            first = x
        last = x
    yield first, last


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for item_id, text in items.select(items[id_col], items[text_col]).where(F.col(text_col).isNotNull()).toLocalIterator():
        t = normal(text)
        if not t:
            continue
        block.append((item_id, t))
        size += len(t.encode())
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, share: float = 0.08, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shortest: int = SHORTEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, item_id, distance, start, end (in the normalised text) of each document and test item that occurs in it, one row for each two ids."""
    sc = docs.sparkSession.sparkContext
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_id].dataType)
    schema = f"id {kind}, item_id {item_kind}, distance int, start long, end long"
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = None
    for block in item_blocks(items, item_id, item_text, block_bytes):
        shared, name = sc.broadcast(block), uuid.uuid4().hex

        def run(batches, shared=shared, name=name):
            b = latest("leaks", name, lambda: Block(shared.value, share, shortest))
            for batch in batches:
                rows = {}
                for doc, t in zip(batch.column("id"), texts(batch), strict=True):
                    own = {}
                    for k, got in b.matches(normal(t)).items():
                        item = b.items[k][0]
                        if item not in own or got < own[item]:
                            own[item] = got
                    for item, got in own.items():
                        rows[len(rows)] = (doc.as_py(), item, *got)
                columns = list(zip(*rows.values(), strict=True)) or [()] * 5
                kinds = (batch.schema.field("id").type, None, pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k or item_type) for c, k in zip(columns, kinds, strict=True)], ["id", "item_id", "distance", "start", "end"])

        part = own.transform(mapped, run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    best = out.groupBy("id", "item_id").agg(F.min(F.struct("distance", "start", "end")).alias("best"))
    return best.select(F.col("id").alias(id_col), "item_id", "best.*")


def without_leaks(docs: DataFrame, items: DataFrame, share: float = 0.08, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shortest: int = SHORTEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no test item occurs, with all columns."""
    sc, at, out = docs.sparkSession.sparkContext, docs.columns.index(text_col), docs
    for block in item_blocks(items, item_id, item_text, block_bytes):
        shared, name = sc.broadcast(block), uuid.uuid4().hex

        def run(batches, shared=shared, name=name):
            b = latest("leaks", name, lambda: Block(shared.value, share, shortest))
            for batch in batches:
                keep = [not (t and b.matches(normal(t))) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.transform(mapped, run, docs.schema)
    return out
