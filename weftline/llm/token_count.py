"""Token counts of whole texts by a sentencepiece model, in Arrow functions that return lengths only.

Merges of a piece vocabulary whose pieces hold the space mark at their front
only never cross from a non-space to a space. A text is therefore cut before
each run of spaces (the safe boundaries), every distinct cut is encoded once per
batch, and its length is counted as often as it occurs. A long stretch without a
space is also cut between two characters that stand side by side in no piece, as
no merge can join them. Batches are cut by bytes, so that a task holds a bounded
text at a time however long single rows are. What goes to the encoder at once is
long only where a text neither has a space nor such a pair for long (one letter
over and over, say), or has the character NUL. A model without the first property
is applied to whole texts.

Null texts have no tokens. Equal rows are counted one by one; other columns are
ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cached, mapped, pieces_of, texts

#: Bytes of text encoded at a time.
BATCH_BYTES = 4 << 20
#: Distinct cuts whose lengths a worker remembers.
REMEMBERED = 400_000

#: Characters without a space from which on a stretch is cut between letters.
LONG = 2048

MARK = "▁"
#: Put before a cut that starts within a word, so that the model's own space doesn't meet it.
GUARD = "\n"
CUT = re.compile(r" *[^ ]+| +")


class Counter:
    """Lengths of texts under one model."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [self.sp.encode(x) for x in ("a", "a b", " a", "a  b")]
        marks = all(MARK not in x.lstrip(MARK) for x in names)
        # The space mark stands for each space and is put before the first word.
        kept = plain[3] != plain[1] and self.sp.encode("a")[0] == self.sp.encode("b a")[-1]
        self.safe = marks and kept and self.sp.normalize("ﬁ é") == MARK + "ﬁ" + MARK + "é"
        self.mark = len(self.sp.encode("a ")) - len(plain[0])
        self.guard = len(self.sp.encode(GUARD))
        self.pairs = {x[i : i + 2] for x in names for i in range(len(x) - 1)}
        # Unknown characters are bytes (else neighbours of them are one token), and nothing joins the guard.
        self.within = self.safe and self.sp.unk_id() not in self.sp.encode("\u0378") and not any(GUARD in x for x in self.pairs)
        self.known: dict[str, int] = {}

    def split(self, word: str) -> list[str]:
        """word, or if it is long its parts, the first of which has no guard."""
        if len(word) <= LONG or not self.within:
            return [word]
        word = word.replace(" ", MARK)
        out, at, n = [], 0, len(word)
        while at < n:
            to = at + LONG
            while to < n and word[to - 1 : to + 1] in self.pairs:
                to += 1
            out.append((GUARD if at else "") + word[at:to])
            at = to
        return out

    def cuts(self, text: str) -> list[str]:
        """Cuts to encode each by itself: the one space that the model puts before a text is taken off all but the first."""
        found = CUT.findall(text)
        return found[:1] + [x[1:] for x in found[1:]]

    def lengths(self, batch: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.sp.encode(batch, num_threads=1)]
        whole = [i for i, t in enumerate(batch) if "\0" in t]
        # A mark in a text is to the model what a space is.
        words = [[] if "\0" in t else self.cuts(t.replace(MARK, " ")) for t in batch]
        parts = [[y for x in w for y in self.split(x)] if len(t) > LONG else w for w, t in zip(words, batch, strict=True)]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        known[""] = self.mark
        new = list({x for p in parts for x in p if x not in known})
        known.update(zip(new, map(len, self.sp.encode(new, num_threads=1)), strict=True))
        out = [sum(map(known.__getitem__, p)) - self.guard * (len(p) - len(w)) for p, w in zip(parts, words, strict=True)]
        for i in whole:
            out[i] = len(self.sp.encode(batch[i], num_threads=1))
        return out


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of docs."""

    def run(batches):
        counter = cached(("pieces", path), lambda: Counter(path))
        for b in batches:
            for part in pieces_of(b, batch_bytes):
                t = texts(part)
                n = counter.lengths(t)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(x.encode()) for x in t], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    ["id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).transform(mapped, run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
