"""Language identification by prediction by partial matching.

For each language a context tree over bytes holds, for contexts of 0 to `order`
bytes, how often each byte followed. A text's code length under a language is
exact for frozen statistics: from the longest context of the tree that is known,
each byte costs -log2 of count / (total + kinds), or an escape
of kinds / (total + kinds) to the next shorter context, in which the bytes of
the longer one are excluded; what no context knows costs its share of the bytes
left. The language with the shortest code wins; the score is its posterior
probability under equal priors, tempered by the text's length.

Contexts never span texts. As a longer context's bytes are a subset of those of
its suffix, exclusion needs one number per context (what is left of the suffix's
total), so texts are scored by array lookups of all their positions at once.

Every language of the labels is learned. Training takes at most `per_language`
labelled documents of each (those whose hashed ids are smallest) and `train_bytes`
bytes; with many languages the bytes of each shrink so that all together stay
within `model_bytes`, which bounds the model that is broadcast. Nulls and texts
without a letter are `und` with score 0. Of languages with equal code lengths the
first by name wins. Repeated rows are predicted one by one, and in training count
once. Rows without a label are not learned from; with no labelled row every text
is `und`. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, pieces_of, text_bytes

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes scored at a time.
BLOCK = 1 << 18


def grams(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the last n bytes up to and with it as a number, and whether they lie within one text. n from 0 to 7."""
    key = np.zeros(len(data), np.uint64)
    for k in range(n):
        key[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    ok = np.ones(len(data), bool)
    for k in range(n - 1):
        at = starts + k
        ok[at[at < len(data)]] = False
    return key, ok


class Table:
    """Sorted distinct keys found by hashing: slots of open addressing, probed for all asked keys at once."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(len(keys) * 2.5).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = np.uint64(size - 1)
        self.slots = np.full(size, -1, np.int32)
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        left = np.arange(len(keys))
        at = self.slot(keys)
        while len(left):
            free = self.slots[at] < 0
            # Of the keys that want one free slot, the last written stays.
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + np.uint64(1)) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self.slot(keys)
        row = self.slots[at]
        bad = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(bad):
            at[bad] = (at[bad] + np.uint64(1)) & self.mask
            row[bad] = self.slots[at[bad]]
            r = row[bad]
            bad = bad[(r >= 0) & (self.keys[r] != keys[bad])]
        return row


class Model:
    """Context trees of several languages. For each order k: symbols (k + 1 bytes) with log2 counts, contexts (k bytes) with log2 denominators."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = 4):
        if order > 6:
            raise ValueError("contexts of more than 6 bytes don't fit a key")
        self.langs, self.order = sorted(samples), order
        n = len(self.langs)
        self.levels = []
        counted = []
        for k in range(order + 1):
            per = []
            for lang in self.langs:
                data = np.frombuffer(b"".join(samples[lang]), np.uint8)
                starts = np.cumsum([0, *map(len, samples[lang])])[:-1]
                key, ok = grams(data, starts, k + 1)
                per.append(np.unique(key[ok], return_counts=True))
            counted.append(per)
        for k in range(order + 1):
            keys = np.unique(np.concatenate([x[0] for x in counted[k]]))
            contexts = np.unique(keys >> np.uint64(8))
            # Keys hold the newest byte lowest; a context is the key without it.
            logs = np.full((len(keys), n), np.nan, np.float32)
            total, kinds, rest = (np.zeros((len(contexts), n)) for _ in range(3))
            for j in range(n):
                key, count = counted[k][j]
                logs[np.searchsorted(keys, key), j] = np.log2(count)
                c = np.searchsorted(contexts, key >> np.uint64(8))
                total[:, j] = np.bincount(c, count, len(contexts))
                kinds[:, j] = np.bincount(c, minlength=len(contexts))
                if k:  # counts that the suffix context has of this context's bytes
                    short, short_count = counted[k - 1][j]
                    tail = key & np.uint64((1 << 8 * k) - 1)
                    rest[:, j] = np.bincount(c, short_count[np.searchsorted(short, tail)], len(contexts))
            self.levels.append({"keys": keys, "contexts": contexts, "logs": logs, "total": total, "kinds": kinds, "rest": rest})
        self.finish()

    def finish(self) -> None:
        """Costs in bits: `plain` of a context entered first, `after` of one entered by an escape from a longer one, indexed by the longer one."""
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, v in enumerate(self.levels):
                v["known"] = v["kinds"] > 0
                den = v["total"] + v["kinds"]
                v["plain_den"] = np.where(v["known"], np.log2(den), 0).astype(np.float32)
                v["plain_esc"] = np.where(v["known"], np.log2(den) - np.log2(v["kinds"]), 0).astype(np.float32)
                if k:
                    # The suffix context's totals without this context's bytes.
                    up = self.levels[k - 1]
                    at = np.searchsorted(up["contexts"], v["contexts"] & np.uint64((1 << 8 * (k - 1)) - 1))
                    total = up["total"][at] - v["rest"]
                    kinds = up["kinds"][at] - v["kinds"]
                    den = total + kinds
                    v["after_den"] = np.where(v["known"] & (kinds > 0), np.log2(den), 0).astype(np.float32)
                    v["after_esc"] = np.where(v["known"] & (kinds > 0), np.log2(den) - np.log2(kinds), 0).astype(np.float32)
            base = self.levels[0]
            self.last = np.log2(np.maximum(256 - base["kinds"][0], 1)).astype(np.float32) if len(base["keys"]) else np.full(len(self.langs), 8, np.float32)
        for v in self.levels:
            for name in ("total", "kinds", "rest"):
                del v[name]
            v["symbol"], v["context"] = Table(v["keys"]), Table(v["contexts"])
            del v["keys"], v["contexts"]
            # One row more: what is not in the table.
            v["logs"] = np.vstack([v["logs"], np.full(len(self.langs), np.nan, np.float32)])
            v["known"] = np.vstack([v["known"], np.zeros(len(self.langs), bool)])
            for name in ("plain_den", "plain_esc", "after_den", "after_esc"):
                if name in v:
                    v[name] = np.vstack([v[name], np.zeros(len(self.langs), np.float32)])

        # What a byte costs depends on it and the `order` bytes before it: worked out once for all such runs that training saw.
        top = self.levels[-1]["symbol"]
        full = top.keys[:-1]
        self.costs = self.walk(full, np.full(len(full), self.order + 1))
        self.whole = top

    def walk(self, key: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Cost under each language of the last byte of each key, of which the last depth bytes belong to the text."""
        n, m = len(key), len(self.langs)
        cost = np.zeros((n, m), np.float32)
        open_ = np.ones((n, m), bool)  # not coded yet
        above = None  # rows of the longer context, and whether an escape came from it
        for k in range(self.order, -1, -1):
            v = self.levels[k]
            part = key & np.uint64((1 << 8 * (k + 1)) - 1)
            ok = depth > k
            row, crow = v["symbol"].find(part), v["context"].find(part >> np.uint64(8))
            row[~ok] = -1
            crow[~ok] = -1
            log, known = v["logs"][row], v["known"][crow]
            if above is None:
                den, esc = v["plain_den"][crow], v["plain_esc"][crow]
            else:
                up, came = above
                u = self.levels[k + 1]
                den = np.where(came, u["after_den"][up], v["plain_den"][crow])
                esc = np.where(came, u["after_esc"][up], v["plain_esc"][crow])
            found = open_ & ~np.isnan(log)
            cost += np.where(found, den - np.nan_to_num(log), np.where(open_, esc, 0))
            open_ &= ~found
            above = (crow, known)
        return cost + np.where(open_, self.last, 0)

    def bits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length of each byte under each language."""
        key, ok = grams(data, starts, self.order + 1)
        row = self.whole.find(key)
        row[~ok] = -1
        cost = self.costs.take(row, axis=0, mode="wrap")
        new = np.flatnonzero(row < 0)
        if len(new):
            depth = np.full(len(data), self.order + 1)
            for k in range(self.order - 1, -1, -1):
                at = starts + k
                at = at[at < len(data)]
                depth[at] = np.minimum(depth[at], k + 1)
            # Each distinct unseen run once.
            some, back = np.unique(key[new] << np.uint64(3) | depth[new].astype(np.uint64), return_inverse=True)
            cost[new] = self.walk(some >> np.uint64(3), (some & np.uint64(7)).astype(np.int64))[back]
        return cost

    def lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language; texts are cut into blocks that see the bytes before them."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        at = 0
        while at < len(data):
            to = min(at + BLOCK, len(data))
            low = max(0, at - self.order)
            inside = offs[(offs >= low) & (offs < to)] - low
            b = self.bits(data[low:to], inside)[at - low :]
            cuts = np.unique(np.append(offs[(offs > at) & (offs < to)], at)) - at
            owners = np.searchsorted(offs, cuts + at, side="right") - 1
            sums = [np.add.reduceat(np.ascontiguousarray(b[:, j], np.float64), cuts) for j in range(b.shape[1])]
            np.add.at(out, owners, np.stack(sums, axis=1))
            at = to
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, per_language: int = 400, train_bytes: int = 1_000_000, model_bytes: int = 32_000_000) -> Model | None:
    """The model of a bounded sample of the labelled rows of docs: of each language the rows with the smallest hashed ids, whole texts, up to the bounds."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("lang is not null and text is not null")
    keyed = rows.withColumn("key", F.xxhash64("id", "text"))
    # Keys and lengths only: which texts are fetched is settled before any text moves. Parts of a language are
    # cut first, then fewer and larger ones, so that no task gets all rows of a frequent language.
    ranked = keyed.select("lang", "key", F.octet_length("text").alias("n")).distinct()
    for parts in (4096, 16, 1):
        first = Window.partitionBy("lang", F.pmod("key", F.lit(parts))).orderBy("key", "n")
        ranked = ranked.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language).drop("rank")
    listed = sorted(ranked.select("lang", "key", "n").collect())
    share = min(train_bytes, model_bytes // max(1, len({r["lang"] for r in listed})))
    chosen: list[tuple[int, str]] = []
    size: dict[str, int] = {}
    for r in listed:
        have = size.get(r["lang"], 0)
        if not have or have + r["n"] <= share:
            size[r["lang"]] = have + r["n"]
            chosen.append((r["key"], r["lang"]))
    if not chosen:
        return None
    spark = docs.sparkSession
    wanted_rows = F.broadcast(spark.createDataFrame(chosen, "key long, lang string"))
    picked = keyed.join(wanted_rows, ["key", "lang"], "left_semi").dropDuplicates(["key", "lang"])
    samples: dict[str, list[bytes]] = {}
    for r in sorted(picked.select("key", "lang", "text").collect(), key=lambda r: r["key"]):
        # A single text longer than the share counts by its first bytes.
        samples.setdefault(r["lang"], []).append(r["text"].encode()[:share])
    samples = {k: v for k, v in samples.items() if any(v)}
    return Model(samples, order) if samples else None


def posterior(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probability of each language. Bytes are not independent draws: the gaps count by the root of the length."""
    gap = (bits - bits.min(axis=1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
    p = np.exp2(-np.minimum(gap, 500))
    return p / p.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, bits_per_byte of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in pieces_of(batch, 8 << 20):
                data, offs = text_bytes(part)
                n = np.diff(offs)
                if m is None:
                    got = [(UNKNOWN, 0.0, None)] * len(n)
                else:
                    bits = m.lengths(data, offs)
                    p, best = posterior(bits, n), bits.argmin(axis=1)
                    raw = data.tobytes()
                    # An ASCII letter shows at once; others are looked for in the text.
                    got = [
                        (m.langs[k], float(p[i, k]), float(bits[i, k] / n[i])) if n[i] and LETTER.search(raw[offs[i] : offs[i + 1]].decode()) else (UNKNOWN, 0.0, float(bits[i, k] / n[i]) if n[i] else None)
                        for i, k in enumerate(best)
                    ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.float64())],
                    ["id", "lang_pred", "score", "bits_per_byte"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).transform(mapped, run, f"id {kind}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("id", id_col)


def known_language(docs: DataFrame, model: Model | None, text_col: str = "text", languages: frozenset[str] | None = None, most_bits: float = 8.0) -> DataFrame:
    """The rows of docs whose text is of a learned language (or of one of `languages`), with all columns.

    Null texts and texts without a letter go, and those that no language's model codes in fewer than
    most_bits bits a byte, which is what unseen bytes cost. Without a model every row goes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            if m is None:
                continue
            for part in pieces_of(batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]), 8 << 20, f"c{at}"):
                data, offs = text_bytes(part, f"c{at}")
                raw, bits = data.tobytes(), m.lengths(data, offs)
                keep = bits.min(axis=1) < most_bits * np.diff(offs)
                keep &= np.array([LETTER.search(raw[a:b].decode()) is not None for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], bool)
                if languages is not None:
                    keep &= np.array([m.langs[k] in languages for k in bits.argmin(axis=1)], bool)
                yield part.filter(pa.array(keep)).rename_columns(batch.schema.names)

    return docs.transform(mapped, run, docs.schema)
