"""Steps that both exact-repeat operators share: runs of documents, and stretches of them fetched again."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import BYTE_HASH, Rolling, runs
from .common import mapped, pieces_of, text_bytes

#: Bytes of text worked on at a time.
BLOCK = 1 << 20
#: Which bytes are a word's.
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False

RUN = "anchor long, content long, second long, doc long, first long, start int, n int, place int"


def doc_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A hash of id and text (null as empty)."""
    return F.xxhash64(docs[id_col], F.coalesce(docs[text_col], F.lit("")))


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, doc (a hash of id and text: equal rows share it), text (null as empty)."""
    return docs.select(docs[id_col].alias("id"), doc_key(docs, id_col, text_col).alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def byte_elements(part: pa.RecordBatch):
    """Elements, their offsets at each row, and the bytes that they are."""
    data, offs = text_bytes(part)
    return BYTE_HASH[data], offs, data, None


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word, a block at a time."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        if ends[at] - starts[at] > BLOCK:
            out[at] = xxhash.xxh64_intdigest(data[starts[at] : ends[at]])
            at += 1
            continue
        to = int(np.searchsorted(ends, starts[at] + BLOCK, side="right"))
        low = starts[at]
        out[at:to] = Rolling(BYTE_HASH[data[low : ends[to - 1]]], 0).of(starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def word_elements(part: pa.RecordBatch):
    """Hashes of the words, their offsets at each row, the bytes with one space between words, and where in these each word starts and ends."""
    data, offs = text_bytes(part)
    word = IS_WORD[data]
    # A word ends at its row's end too.
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner], last[inner - 1] = word[inner], word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = word.copy()
    keep[1:] |= word[:-1]
    size = ends - starts
    counts = np.searchsorted(starts, offs)
    data = np.where(word, data, np.uint8(32))[keep]
    starts = np.cumsum(keep, dtype=np.int32)[starts].astype(np.int64) - 1
    ends = starts + size
    return word_hashes(data, starts, ends), counts, data, (starts, ends)


def find_runs(keyed: DataFrame, elements, window: int, k: int) -> DataFrame:
    """RUN rows of each document; first orders documents (the id). content and second: a 128-bit digest of the run's bytes (words with one space between). place: where its anchor starts, from the run's start."""

    def run(batches):
        for b in batches:
            for part in pieces_of(b, BLOCK):
                values, offs, raw, words = elements(part)
                r = runs(values, offs, window, k)
                rows = pa.array(r["row"])
                low = offs[r["row"]] + r["start"]
                high = low + r["n"] - 1 + window
                if words:
                    low, high = words[0][low], words[1][high - 1]
                digest = np.frombuffer(b"".join([blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(low.tolist(), high.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                out = [pa.array(r["anchor"]), pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1])), part.column("doc").take(rows)]
                out.append(part.column("id").cast(pa.int64()).take(rows) if pa.types.is_integer(part.schema.field("id").type) else pa.nulls(len(rows), pa.int64()))
                out += [pa.array(r[c].astype(np.int32)) for c in ("start", "n", "place")]
                names = ["anchor", "content", "second", "doc", "first", "start", "n", "place"]
                yield pa.RecordBatch.from_arrays(out, names)

    return keyed.transform(mapped, run, RUN)


def by_document(keyed: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """keyed with `rows` (columns doc and others) as a list of structs at each document."""
    names = [c for c in rows.columns if c != "doc"]
    lists = rows.groupBy("doc").agg(F.collect_list(F.struct(*names)).alias("rows"))
    return keyed.join(lists.hint("shuffle_hash"), "doc", how)


#: A key of more rows is hot; there are at most HOT_KEYS of them.
HOT, HOT_KEYS = 2000, 100_000


def joined(rows: DataFrame, heads: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with saved heads (one row for each of some keys; column c: how many of rows have it), of which only hot keys are broadcast, so that no task gets a hot key's rows.

    total: the number of rows, or a bound of it. Keys of more than total / HOT_KEYS rows are hot: at most HOT_KEYS.
    how: inner, or left to keep rows of other keys.
    """
    least = max(HOT, total // HOT_KEYS)
    if not heads.where(F.col("c") > least).limit(1).count():
        return rows.join(heads, keys, how)
    hot = F.broadcast(heads.where(F.col("c") > least))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(heads.where(F.col("c") <= least), keys, how)
    return rows.join(hot, keys).unionByName(rest)


def columns(value, names: list[str]) -> dict[str, np.ndarray]:
    """A list<struct> value (or null) as arrays."""
    if value is None or not value.is_valid:
        return {c: np.zeros(0, np.int64) for c in names}
    flat = value.values
    return {c: flat.field(c).to_numpy(zero_copy_only=False) for c in names}
