"""Language-model scores by a weighted backoff automaton over smoothed n-grams.

Tokens are lower-cased words and one end for each text. States are the root and
one for each history of 1 to order - 1 tokens that training has (a text's begin
counts as a token there). A state has an arc for each token seen behind its
history, weighted with its absolutely discounted probability interpolated with the
shorter history's, and a failure arc to the state of the shorter history, weighted
with the mass that discounting frees. The root has an arc for each token,
(c + a) / (N + a (V + 1)), where one share is for all unknown tokens; so what each
state can reach sums to 1. A text is read once from left to right: the state
carried along takes its arc, or follows failure arcs to the first state that has
one; log10 weights add up, and the arc leads to the state of the longest history.

Counts cover all training rows, singletons too, and grow with them, so the
automaton is never broadcast. Texts are packed into chunks of bounded bytes as
the tasks of the scan meet them (equal rows do not gather), written once. Then for
each order a chunk sends the counts of its distinct n-grams to the buckets of
their histories; a bucket adds up all chunks and answers each with what it asked
for, in the order it asked. A chunk and a bucket exchange a row only where they
have an n-gram in common, so rows never outnumber the chunks' n-grams.

A frequent history would make a bucket too large. Orders are counted one after the
other, so a history's own count is known before what follows it is asked for: one
that occurs more than `split` times is dealt over several buckets by what follows
it, and its number of followers is added up over them. There are at most
(tokens / split) such histories, and `split` grows so that they stay under a
million: that bounds the table which is broadcast.

Words are told apart by 64-bit hashes, and numbered with the first order's answers;
n-grams are told apart by their words' numbers. Null texts have the end only. Rows with equal
ids, and equal rows, are scored one by one. A single text longer than a chunk is a
chunk of its own. Other columns are ignored. Without training rows every count is
0 and every text takes root arcs only.
"""

from __future__ import annotations

import itertools
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD_BYTES, dropped, mapped, saved, text_bytes

#: Text bytes of a chunk, and tokens that a bucket serves.
CHUNK, BUCKET = 6 << 20, 1 << 20
BEGIN, END = 1, 2
#: Split histories that are broadcast at most.
MOST_SPLIT = 1 << 20

#: A chunk; its tokens are numbers of its words. What a chunk asks of a bucket.
CHUNK_ROW = "chunk long, ids array<{kind}>, learned array<boolean>, sizes array<int>, words binary, tokens binary, n long"
#: A chunk whose words have been answered: their numbers and counts stand for their hashes.
NUMBERED_ROW = "chunk long, ids array<{kind}>, learned array<boolean>, sizes array<int>, numbers binary, tokens binary"
CELL = "chunk long, bucket int, payload binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned numbers, each array as planes of bytes, the lowest first, without planes of zeros at the end; all compressed."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        head += [len(a), width]
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), 8)[:, :width].T).tobytes())
    plain = b"".join([np.array([len(arrays), *head], "<i8").tobytes(), *body])
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    data = bytes(data)
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    m = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 2 * m, 8).tolist()
    out, at = [], 8 + 16 * m
    for n, width in zip(head[::2], head[1::2], strict=True):
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        out.append(a.view("<u8").reshape(n))
        at += n * width
    return out


def chunk_rows(batches, size: int, ids_type: pa.DataType):
    """Rows of packed texts: their distinct words' hashes, and each token as a word's number."""
    task, number = TaskContext.get().partitionId(), 0

    def fresh():
        return [], [], array("i"), array("I"), defaultdict(itertools.count().__next__), 0

    ids, learned, sizes, tokens, numbers, held = fresh()

    def row():
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        # Frequent words get small numbers, which pack well.
        flat = np.frombuffer(tokens, np.uint32)
        by = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[by] = np.arange(len(words), dtype=np.uint32)
        words = words[by]
        n = sum(sizes)
        columns = [pa.array([(task << 32) + number]), pa.array([ids], pa.list_(ids_type)), pa.array([learned], pa.list_(pa.bool_())), pa.array([np.frombuffer(sizes, np.int32)], pa.list_(pa.int32()))]
        packed = [pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([pack(rank[flat])], pa.binary()), pa.array([n], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *packed], ["chunk", "ids", "learned", "sizes", "words", "tokens", "n"])

    for b in batches:
        data, offs = text_bytes(b)
        raw = data.tobytes()
        for i, (doc, learn) in enumerate(zip(b.column("id").to_pylist(), b.column("learned").to_pylist(), strict=True)):
            found = WORD_BYTES.findall(raw[offs[i] : offs[i + 1]].lower())
            if ids and held + offs[i + 1] - offs[i] > size:
                yield row()
                ids, learned, sizes, tokens, numbers, held = fresh()
                number += 1
            tokens.extend(map(numbers.__getitem__, found))
            ids.append(doc)
            learned.append(learn)
            sizes.append(len(found) + 1)
            held += int(offs[i + 1] - offs[i])
    if ids:
        yield row()


class Chunk:
    """The positions of a chunk's texts, their words, and their n-grams of each order."""

    def __init__(self, row: pa.Table, order: int):
        value = {c: row.column(c)[0] for c in row.column_names}
        self.number = value["chunk"].as_py()
        self.sizes = value["sizes"].values.to_numpy().astype(np.int64)
        learned = value["learned"].values.to_numpy(zero_copy_only=False)
        n = int(self.sizes.sum())
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        #: Numbers and counts in training and besides of the words, once they are known; before that their hashes.
        self.known = unpack(value["numbers"].as_buffer()) if "numbers" in value else None
        self.words = None if self.known else np.concatenate([np.frombuffer(value["words"].as_buffer(), "<u8"), np.array([END, BEGIN], np.uint64)])
        width = len(self.known[0] if self.known else self.words)
        end = width - 2
        self.token = np.full(n, end, np.int64)
        inside = np.ones(n, bool)
        inside[self.ends - 1] = False
        self.token[inside] = unpack(value["tokens"].as_buffer())[0]
        train = np.repeat(learned, self.sizes)
        # Order 1: the words themselves. grams[k]: each position's n-gram (-1: its history goes beyond the text).
        self.grams: list[np.ndarray] = [self.token]
        self.histories: list[np.ndarray] = [np.zeros(width, np.int64)]
        self.last = [np.arange(width)]
        self.trained = [np.bincount(self.token[train], minlength=width)]
        self.trained[0][-1] = int(learned.sum())
        self.occur = [np.bincount(self.token, minlength=width)]
        self.occur[0][-1] = len(self.sizes)
        # What stands before each position: the shorter n-gram that ends there.
        before = np.empty(n, np.int64)
        before[1:] = self.token[:-1]
        before[self.starts] = width - 1
        for k in range(2, order + 1):
            ok = before >= 0
            key = before[ok] * width + self.token[ok]
            kinds, at = np.unique(key, return_inverse=True)
            gram = np.full(n, -1, np.int64)
            gram[ok] = at
            history, last = kinds // width, kinds % width
            self.grams.append(gram)
            self.histories.append(history)
            self.last.append(last)
            self.trained.append(np.bincount(at, train[ok], len(kinds)).astype(np.int64))
            self.occur.append(np.bincount(at, minlength=len(kinds)))
            before = np.full(n, -1, np.int64)
            before[1:] = gram[:-1]
            before[self.starts] = -1


    def spelled(self, k: int, which: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """The numbers of the words of some n-grams of k tokens, the last word first."""
        out = []
        for j in range(k - 1, -1, -1):
            out.append(ids[self.last[j][which]])
            which = self.histories[j][which]
        return out


def parts_of(load: np.ndarray, buckets: int, split: int) -> np.ndarray:
    """Over how many buckets histories of some loads (how often they occur at all) are dealt."""
    return np.clip(-(-load // split), 1, buckets)


def arranged(chunk: Chunk, k: int, ids: np.ndarray | None, load: np.ndarray | None, buckets: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a chunk asks for its n-grams of k + 1 tokens, and the bounds of each bucket in it. ids: of its words; load: of each history. Words are asked for by their hashes."""
    if k:
        which = np.arange(len(chunk.trained[k - 1]))
        name = np.zeros(len(which), np.uint64)
        for x in chunk.spelled(k, which, ids):
            name = mix(name * np.uint64(0x9E3779B97F4A7C15) + x + np.uint64(1))
        parts = parts_of(load, buckets, split).astype(np.uint64)
        own = chunk.histories[k]
        bucket = (name % np.uint64(buckets))[own]
        spread = np.flatnonzero(parts[own] > 1)
        bucket[spread] = (bucket[spread] + mix(ids[chunk.last[k][spread]]) % parts[own[spread]]) % np.uint64(buckets)
    else:
        bucket = mix(chunk.words) % np.uint64(buckets)
    # N-grams come sorted by history, and stay so within a bucket.
    bucket = bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def runs_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def asks(chunk: Chunk, k: int, ids: np.ndarray | None, load: np.ndarray | None, buckets: int, split: int) -> pa.Table:
    """A row for each bucket. Of words: hashes, counts in training and besides. Of longer n-grams: each history's number of followers and of buckets; the followers, counts in training and besides; the words of each history."""
    order, cuts = arranged(chunk, k, ids, load, buckets, split)
    where, payload = np.flatnonzero(np.diff(cuts)), []
    for b in where:
        at = order[cuts[b] : cuts[b + 1]]
        counts = chunk.trained[k][at], chunk.occur[k][at] - chunk.trained[k][at]
        if not k:
            payload.append(pack(chunk.words[at], *counts))
            continue
        own = chunk.histories[k][at]
        new = runs_of(own)
        h = own[new]
        payload.append(pack(np.diff(np.append(new, len(own))), parts_of(load[h], buckets, split), ids[chunk.last[k][at]], *counts, *chunk.spelled(k, h, ids)))
    return pa.table({"chunk": pa.array([chunk.number] * len(where), pa.int64()), "bucket": pa.array(where, pa.int32()), "payload": pa.array(payload, pa.binary())})


ANSWERS = "k int, chunk long, bucket int, payload binary, name string, followers long, tokens long, kinds long, texts long"


def table_of(k: int, bucket: int, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    rows = [{"k": k, "bucket": bucket, **r} for r in rows]
    return pa.table({c: pa.array([r.get(c) for r in rows], kinds[t]) for c, t in (x.split() for x in ANSWERS.split(", "))})


def number_words(table: pa.Table, buckets: int) -> pa.Table:
    """One bucket's answers about words: counts in training and besides, and a number, small for frequent words, that only this word has. A further row has the sums of training."""
    asked = [unpack(x) for x in table.column("payload").to_pylist()]
    words, of = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    trained, other = (np.bincount(of, np.concatenate([a[i] for a in asked]).astype(np.float64), len(words)).astype(np.int64) for i in (1, 2))
    bucket = table.column("bucket")[0].as_py()
    ids = np.empty(len(words), np.int64)
    ids[np.argsort(-(trained + other), kind="stable")] = np.arange(len(words)) * buckets + bucket
    cuts = np.cumsum([0, *(len(a[0]) for a in asked)])
    rows = [{"chunk": c, "payload": pack(trained[of[x:y]], other[of[x:y]], ids[of[x:y]])} for c, x, y in zip(table.column("chunk").to_pylist(), cuts[:-1], cuts[1:], strict=True)]
    begin = words == BEGIN
    rows.append({"tokens": int(trained[~begin].sum()), "kinds": int((trained[~begin] > 0).sum()), "texts": int(trained[begin].sum())})
    return table_of(0, bucket, rows)


def sorted_by(columns_: np.ndarray, bits: int) -> np.ndarray:
    """An order by numbers of at most `bits` bits, the last row first."""
    if bits * len(columns_) > 64:
        return np.lexsort(columns_)
    key = np.zeros(columns_.shape[1], np.uint64)
    for c in columns_[::-1]:
        key = (key << np.uint64(bits)) | c
    return np.argsort(key)


def numbered(columns_: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each distinct column, and one place of each number."""
    order = sorted_by(columns_, bits)
    same = (columns_[:, order[1:]] == columns_[:, order[:-1]]).all(axis=0)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(np.append(True, ~same)) - 1
    return of, order[np.flatnonzero(np.append(True, ~same))]


def add_up(table: pa.Table, k: int) -> pa.Table:
    """One bucket's answers about n-grams of k + 1 tokens: counts in training and besides, and of each history its kinds of followers in training. A further row for each history dealt over several buckets has its followers in this one."""
    asked = [unpack(x) for x in table.column("payload").to_pylist()]
    column = lambda i: np.concatenate([a[i] for a in asked])
    spelled = np.stack([column(i) for i in range(5, 5 + k)])
    p_w = column(2)
    bits = max(int(spelled.max()), int(p_w.max())).bit_length()
    h_of, some = numbered(spelled, bits)
    n = len(some)
    p_h = np.repeat(h_of, column(0).astype(np.int64))
    order = sorted_by(np.stack([p_w, p_h.astype(np.uint64)]), max(bits, n.bit_length()))
    new = np.append(True, (p_h[order][1:] != p_h[order][:-1]) | (p_w[order][1:] != p_w[order][:-1]))
    at = np.flatnonzero(new)
    trained, other = (np.add.reduceat(column(i).astype(np.int64)[order], at) for i in (3, 4))
    followers = np.bincount(p_h[order][at], trained > 0, n).astype(np.int64)
    p_of = np.empty(len(p_w), np.int64)
    p_of[order] = np.cumsum(new) - 1
    rows, i, j = [], 0, 0
    for chunk, a in zip(table.column("chunk").to_pylist(), asked, strict=True):
        own = p_of[j : j + len(a[2])]
        rows.append({"chunk": chunk, "payload": pack(trained[own], other[own], followers[h_of[i : i + len(a[0])]])})
        i, j = i + len(a[0]), j + len(a[2])
    for h in np.flatnonzero(column(1)[some] > 1):
        rows.append({"name": " ".join(map(str, spelled[:, some[h]])), "followers": int(followers[h])})
    return table_of(k, table.column("bucket")[0].as_py(), rows)


NO_ANSWERS = pa.table({"k": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})


class Counts:
    """What a chunk was answered: the numbers of its words; of each n-gram of its own its counts in training and besides, of each history its kinds of followers."""

    def __init__(self, chunk: Chunk, answers: pa.Table, orders: int, buckets: int, split: int, spread: list[dict[str, int]]):
        self.trained, self.load, self.followers, self.ids = [], [], [None], None
        level, bucket, payload = answers.column("k").to_numpy(), answers.column("bucket").to_numpy(), answers.column("payload").to_pylist()
        for k in range(orders):
            if not k and chunk.known:
                self.ids = chunk.known[0]
                self.trained.append(chunk.known[1].astype(np.int64))
                self.load.append(self.trained[0] + chunk.known[2].astype(np.int64))
                continue
            rows = np.flatnonzero(level == k)
            got = [unpack(payload[r]) for r in rows[np.argsort(bucket[rows])]]
            load = self.load[k - 1] if k else None
            order, cuts = arranged(chunk, k, self.ids, load, buckets, split)
            columns = [np.zeros(len(order), np.int64) for _ in range(2 if k else 3)]
            for i, c in enumerate(columns):
                if len(order):
                    c[order] = np.concatenate([g[i] for g in got]).astype(np.int64)
            self.trained.append(columns[0])
            self.load.append(columns[0] + columns[1])
            if not k:
                self.ids = columns[2].astype(np.uint64)
                continue
            followers = np.zeros(len(chunk.trained[k - 1]), np.int64)
            for g, b in zip(got, np.flatnonzero(np.diff(cuts)), strict=True):
                own = chunk.histories[k][order[cuts[b] : cuts[b + 1]]]
                followers[own[runs_of(own)]] = g[2]
            many = np.flatnonzero(load > split)
            for h, name in zip(many, zip(*chunk.spelled(k, many, self.ids), strict=True), strict=True):
                followers[h] = spread[k].get(" ".join(map(str, name)), followers[h])
            self.followers.append(followers)


class Automaton:
    """A chunk's part of the automaton. States of level j are histories of j tokens; level 0 is the root.

    For each order k (from 0): arc[k], the log10 weight of each n-gram's arc from its
    history's state (nan: training has no such arc); fail[k], of each history of k
    tokens, the log10 weight of its failure arc (nan: training has no such state).
    """

    def __init__(self, chunk: Chunk, counts: Counts, totals: tuple[int, int, int], a: float, discount: float):
        tokens, kinds, _ = totals
        p = (counts.trained[0] + a) / (tokens + a * (kinds + 1))
        self.arc, self.fail = [np.log10(p)], [None]
        suffix = None
        for k in range(1, len(counts.trained)):
            c, history = counts.trained[k], counts.trained[k - 1]
            free = discount * counts.followers[k] / np.maximum(history, 1)
            # The n-gram without its first token: its probability is what the failure arc leads to.
            suffix = np.zeros(len(c), np.int64)
            here = chunk.grams[k] >= 0
            suffix[chunk.grams[k][here]] = chunk.grams[k - 1][here]
            h = chunk.histories[k]
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(c > 0, (c - discount) / np.maximum(history[h], 1) + free[h] * p[suffix], np.nan)
                self.arc.append(np.log10(p))
                self.fail.append(np.where(history > 0, np.log10(free), np.nan))

    def walk(self, chunk: Chunk) -> np.ndarray:
        """The sum of weights on each text's way through the automaton."""
        top = len(self.arc) - 1
        out = np.empty(len(chunk.sizes))
        nan = np.append(np.nan, 0)[:1]
        arc = [np.append(w, nan)[g] for w, g in zip(self.arc, chunk.grams, strict=True)]
        begin = len(chunk.trained[0]) - 1
        fail: list = [None]
        for k in range(1, top + 1):
            # The failure weight of the state that is left at a position: its history ends just before.
            held = np.full(len(chunk.token), begin if k == 1 else -1, np.int64)
            held[1:] = chunk.grams[k - 1][:-1]
            held[chunk.starts] = begin if k == 1 else -1
            fail.append(np.append(self.fail[k], nan)[held])
        for n, (a, b) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True)):
            arcs, fails = [x[a:b].tolist() for x in arc], [None, *(x[a:b].tolist() for x in fail[1:])]
            total, level = 0.0, min(1, top)
            for i in range(b - a):
                # No such state: the longest history that training has.
                while level and fails[level][i] != fails[level][i]:
                    level -= 1
                w = arcs[level][i]
                while w != w:
                    total += fails[level][i]
                    level -= 1
                    w = arcs[level][i]
                total += w
                level = min(level + 1, top)
            out[n] = total
        return out


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", a: float = 0.1, discount: float = 0.75, order: int = 3, chunk_bytes: int = CHUNK, bucket_tokens: int = BUCKET, split: int = BUCKET) -> DataFrame:
    """id, learned, n_tokens, n_known, train_tokens, base_score, score of each row; `train` tells the rows to learn from. base_score: the root's arcs alone. Most of the work is done when this is called; the result is written to the shared folder."""
    field, kind = docs.schema[id_col], docs.schema[id_col].dataType.simpleString()
    own = docs.select(docs[id_col].alias("id"), F.coalesce(train, F.lit(False)).alias("learned"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    id_type = to_arrow_type(field.dataType)
    chunks = saved(own.transform(mapped, lambda it: chunk_rows(it, chunk_bytes, id_type), CHUNK_ROW.format(kind=kind)))
    every = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets, split = max(1, -(-every // bucket_tokens)), max(split, every // MOST_SPLIT)
    spread: list[dict[str, int]] = [{}]
    answers: DataFrame | None = None
    parts: list[DataFrame] = []

    def answered(left: pa.Table, right: pa.Table, orders: int, shared) -> tuple[Chunk, Counts]:
        chunk = Chunk(left, min(orders + 1, order))
        return chunk, Counts(chunk, right, orders, buckets, split, shared.value)

    def asker(k: int, shared):
        def ask(left: pa.Table, right: pa.Table | None) -> pa.Table:
            if not left.num_rows:
                return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
            if not k:
                return asks(Chunk(left, 1), 0, None, None, buckets, split)
            chunk, counts = answered(left, right, k, shared)
            return asks(chunk, k, counts.ids, counts.load[k - 1], buckets, split)

        return ask

    def adder(k: int):
        return (lambda t: add_up(t, k)) if k else (lambda t: number_words(t, buckets))

    def renumbered(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows:
            counts = Counts(Chunk(left, 1), right, 1, buckets, split, [])
            numbers = [pack(counts.ids, counts.trained[0], counts.load[0] - counts.trained[0])]
        else:
            numbers = []
        columns_ = {c: left.column(c) for c in ("chunk", "ids", "learned", "sizes")}
        return pa.table({**columns_, "numbers": pa.array(numbers, pa.binary()), "tokens": left.column("tokens")})

    shared = None
    for k in range(order):
        ask = asker(k, shared)
        if k > 1:
            asked = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask, CELL)
        else:
            # What words and bigrams are asked needs nothing but the chunk.
            asked = chunks.transform(mapped, lambda it, ask=ask: (x for b in it for i in range(b.num_rows) for x in ask(pa.Table.from_batches([b.slice(i, 1)]), NO_ANSWERS).to_batches()), CELL)
        got = saved(asked.groupBy("bucket").applyInArrow(adder(k), ANSWERS))
        if k:
            parts.append(got)
        if k == 0:
            sums = got.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds", "texts"))).first()
            totals = tuple(int(x) for x in sums)
        else:
            names = got.where("name is not null").groupBy("name").agg(F.sum("followers").alias("followers"))
            spread.append({r["name"]: r["followers"] for r in names.collect()})
        if shared is not None:
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(list(spread))
        now = got.where("chunk is not null").select("k", "chunk", "bucket", "payload")
        if k == 0:
            packed = saved(chunks.groupBy("chunk").cogroup(now.groupBy("chunk")).applyInArrow(renumbered, NUMBERED_ROW.format(kind=kind)))
            dropped(chunks, got)
            chunks = packed
        else:
            answers = now if answers is None else answers.unionByName(now)

    names = ["id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, kinds, strict=True)})
        chunk, counts = answered(left, right, order, shared)
        machine = Automaton(chunk, counts, totals, a, discount)
        sums = lambda x: np.add.reduceat(x[chunk.token], chunk.starts)
        known = sums((counts.trained[0] > 0).astype(np.int64))
        values = [left.column("ids")[0].values, left.column("learned")[0].values, chunk.sizes, known, np.full(len(chunk.sizes), totals[0]), sums(machine.arc[0]), machine.walk(chunk)]
        return pa.table({c: v if isinstance(v, pa.Array) else pa.array(v, t) for c, v, t in zip(names, values, kinds, strict=True)})

    schema = f"id {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if answers is None:  # the root alone
        answers = chunks.limit(0).selectExpr("0 as k", "chunk", "0 as bucket", "tokens as payload")
    out = saved(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(read, schema))
    dropped(chunks, *parts)
    return out.withColumnRenamed("id", id_col)
