"""Byte-level BPE encoding and decoding with a local rank file.

The tiktoken library encodes each match of the split pattern by the ranks of a
local file. Long texts are cut first, at places that the pattern always splits:
before a space or line break that follows a letter or digit and stands before a
letter. Decoding joins the raw bytes of the ids, so any text comes back whole.

Nulls count as empty texts (no ids); special strings are ordinary text; rows
with equal ids or texts are treated one by one; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cached, mapped, texts

#: Texts longer than this many characters are cut into pieces of about that size.
PIECE = 65_536
#: A space between a letter and a letter: the pattern ends a match before it, whatever stands further off.
SAFE = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


def load(path: str, pattern: str):
    """The encoding of a rank file: lines of base64 bytes and a rank."""
    import tiktoken

    def build():
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return cached(("bpe", path, pattern), build)


def cuts(text: str, piece: int = PIECE) -> list[str]:
    """The text in pieces of about `piece` characters, cut at safe places only; where there is none, a piece is longer."""
    if len(text) <= piece:
        return [text]
    out, at = [], 0
    while len(text) - at > piece:
        found = SAFE.search(text, at + piece)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


def encode(enc, text: str, piece: int = PIECE) -> list[int]:
    if len(text) <= piece:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in cuts(text, piece):
        ids += enc.encode_ordinary(part)
    return ids


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """id, ids array<int> of each whole text."""

    def run(batches):
        enc = load(path, pattern)
        for b in batches:
            ids = [encode(enc, t, piece) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).transform(mapped, run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, data binary: the bytes that the ids stand for; null ids give no bytes."""

    def run(batches):
        enc = load(path, pattern)
        for b in batches:
            data = [enc.decode_bytes(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(data, pa.binary())], ["id", "data"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(rows[id_col].alias("id"), rows[ids_col].alias("ids")).transform(mapped, run, f"id {kind}, data binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 in one pass: texts are encoded, the ids decoded, and only digests leave the worker."""

    def run(batches):
        enc = load(path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in texts(b):
                ids = encode(enc, t, piece)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).transform(mapped, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
