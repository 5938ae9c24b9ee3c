"""Operators that compare texts or vectors with one another, each against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import ngram_lm, queries, repeats, shards, simhash, suffix_merge, vectors, window_index
from weftline.llm.common import WORD, crc_mod
from weftline.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(-50, 400, (260, 2))] + [(7, 7)] + [(i, i + 1) for i in range(500, 560)]
    sets = Sets()
    for a, b in links:
        sets.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: sets.find(x) for a, b in links for x in (a, b) if sets.find(x) != x}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tree_finds_all_within_radius():
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 2**20, 300)]
    tree = simhash.BKTree()
    for i, x in enumerate(fps):
        tree.add(x, i)
    for q in fps[:40]:
        assert sorted(tree.within(q, 4)) == [i for i, x in enumerate(fps) if (x ^ q).bit_count() <= 4]


def plain_fingerprint(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + size]).encode(), 42) for k in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("cap", [512, 3])
def test_simhash_links_equal_brute_force(docs, rows, cap, monkeypatch):
    monkeypatch.setattr(simhash, "CAP", cap)
    for radius in (4, 9):
        fps = {i: plain_fingerprint(t, 4) for i, t, _ in rows}
        sets = Sets()
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= radius:
                    sets.join(i, j)
        got = {r.id: (bytes(r.fp).hex(), r.component_id) for r in simhash.linked(docs, radius=radius).collect()}
        assert got == {i: (format(fps[i], "016x"), sets.find(i)) for i in fps}
        assert len({c for _, c in got.values()}) < len(fps) - 3


@pytest.mark.parametrize("agree", [2, 3, 5])
def test_every_close_pair_shares_a_shard(spark, agree):
    assert [simhash.agreeing(n, 4) for n in (10, 1 << 26, 1 << 27, 1 << 33, 1 << 40)] == [2, 2, 3, 4, 5]
    rng = np.random.default_rng(agree)
    rows = []
    for k in range(60):
        x = int(rng.integers(0, 2**63))
        y = x
        for b in rng.choice(64, 4, replace=False):
            y ^= 1 << int(b)
        rows += [(2 * k, x.to_bytes(8, "big")), (2 * k + 1, y.to_bytes(8, "big"))]
    keys = defaultdict(set)
    for r in simhash.exact_shards(spark.createDataFrame(rows, "node long, fp binary"), 4, agree).collect():
        keys[r.node].add(r.key)
    assert all(keys[2 * k] & keys[2 * k + 1] for k in range(60))


def test_near_copies_keep_one_of_each(docs, rows, none):
    shingles = {}
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    for i, a in shingles.items():
        for j, b in shingles.items():
            if i < j and len(a | b) and len(a & b) / len(a | b) >= 0.9:
                assert not {i, j} <= kept
    far = [i for i, a in shingles.items() if all(i == j or not a & b for j, b in shingles.items()) and a]
    assert len(far) > 5 and set(far) <= kept
    assert simhash.one_of_each(docs).columns == docs.columns and simhash.one_of_each(none).count() == 0
    # Of rows that share the smallest id one stays.
    assert simhash.one_of_each(docs.union(docs)).count() == len(kept)


def shingles_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("cap", [512, 3])
def test_near_copies_are_joined_by_exact_similarity(spark, cap, monkeypatch):
    """Templated texts of similarity 0.6 to 0.78, and unlike texts with much-repeated boilerplate, all stay."""
    monkeypatch.setattr(simhash, "CAP", cap)
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows, base = [], word(400)
    for k in range(12):  # a tail of its own each: similarity (396 - tail) / (396 + tail)
        tail = 52 + 4 * k
        rows.append((len(rows), " ".join(base[: 400 - tail] + word(tail))))
    for _ in range(4):
        rows.append((len(rows), " ".join(word(200) + "the same line again and again ".split() * 60)))
    for _ in range(3):  # copies with a changed tail of 20 words: similarity 0.9
        rows.append((len(rows), " ".join(base[:380] + word(20))))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, rows[14][1])]
    sets = {i: shingles_of(t) for i, t in rows}
    joined = Sets()
    for i in sets:
        for j in sets:
            if jaccard(sets[i], sets[j]) >= 0.8:
                joined.join(i, j)
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.component_id for r in found} == {i: joined.find(i) for i in sets}


@pytest.mark.parametrize("length", [9, 40, 400])
def test_near_copies_at_the_threshold_are_found(spark, length):
    """Recall against brute force of pairs whose exact similarity is 0.8 or just above."""
    rng = np.random.default_rng(length)
    rows, pairs = [], 150
    for k in range(pairs):
        w = [f"w{x}" for x in rng.integers(0, 10**9, length)]
        n = length - 4  # shingles; the other text lacks a fifth of them at the end
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: length - n // 5]))]
    sets = {i: shingles_of(t) for i, t in rows}
    assert all(0.8 <= jaccard(sets[2 * k], sets[2 * k + 1]) < 0.81 for k in range(pairs))
    found = {r.id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[2 * k + 1] == 2 * k for k in range(pairs)) >= 0.97 * pairs
    assert all(found[i] // 2 == i // 2 for i in found)


def test_unlike_texts_of_one_id_or_none_stay(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(30))
    rows = [(1, text(0)), (1, text(1)), (None, text(2)), (None, text(3)), (2, text(0)), (None, text(1)), (1, text(4)), (0, text(4)), (None, text(3))]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=lambda r: r[1]) == [(1, text(0)), (1, text(1)), (None, text(2)), (None, text(3)), (0, text(4))]


def removed_bytes(texts, window=200):
    count = Counter(b[i : i + window] for b in texts for i in range(len(b) - window + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("cap", [1024, 2])
def test_suffix_dedup_equals_brute_force(docs, rows, cap, monkeypatch, none):
    monkeypatch.setattr(suffix_merge.repeated_spans, "__defaults__", (suffix_merge.ANCHOR, cap))
    monkeypatch.setattr(suffix_merge, "ROUND", 3000)
    got = {r.id: r for r in suffix_merge.deduplicate(docs.unionByName(docs.where("doc_id = 7").selectExpr("*"))).collect()}
    twice = rows + [r for r in rows if r[0] == 7]
    gone = removed_bytes([(t or "").encode() for _, t, _ in twice])
    for (i, t, _), g in zip(twice, gone, strict=True):
        data = np.frombuffer((t or "").encode(), np.uint8)
        assert bytes(got[i].kept) == data[~g].tobytes() and got[i].n_bytes == len(data)
        assert len(got[i].removed) == int((g & ~np.append(False, g[:-1])).sum())
    assert sum(g.sum() for g in gone) > 5000
    monkeypatch.setattr(repeats, "HOT", 3)
    hot = {r.id: bytes(r.kept) for r in suffix_merge.deduplicate(docs).collect()}
    alone = removed_bytes([(t or "").encode() for _, t, _ in rows])
    assert hot == {i: np.frombuffer((t or "").encode(), np.uint8)[~g].tobytes() for (i, t, _), g in zip(rows, alone, strict=True)}
    assert suffix_merge.deduplicate(none).count() == 0


def test_refinement_rounds():
    data = np.frombuffer(b"xabcabcdyabcabcdzabcabcq", np.uint8)
    starts = np.arange(len(data) - 4)
    got = suffix_merge.refined(data, starts, np.zeros(len(starts), np.int64), 5)
    texts = [data[s : s + 5].tobytes() for s in starts]
    assert got.tolist() == [texts.count(t) > 1 for t in texts]


def kept_words(rows, window):
    seen, out = set(), {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone[k : k + window] = [True] * window
            seen.add(x)
        out[i] = (len(w), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_window_index_equals_brute_force(docs, rows, batches, none, monkeypatch):
    if batches == 3:
        monkeypatch.setattr(repeats, "HOT", 2)
    got = {r.id: (r.n_words, r.kept) for r in window_index.deduplicate(docs, batches=batches).collect()}
    assert got == kept_words(rows, 20)
    if batches == 1:
        assert window_index.deduplicate(none).count() == 0


def test_index_compacts(docs):
    keyed = window_index.with_key(docs, "doc_id", "text")
    index = window_index.WindowIndex(docs.sparkSession, fanout=2)
    for k in range(4):
        index.add(keyed.where(f"id >= {k * 30} and id < {k * 30 + 30}"))
    assert [len(level) for level in index.levels] == [0, 0, 1] and index.compactions == 3
    run = index.runs()[0]
    assert run.count() == run.select("anchor", "content", "second").distinct().count()
    # A batch meets the run without moving it.
    fresh = window_index.find_runs(keyed.where("id = 70"), window_index.word_elements, 20, 5)
    plan = run.join(fresh.select("anchor").distinct().hint("merge"), "anchor", "left_semi")._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("SortMergeJoin") :].split("HashAggregate")[0]
    assert "Bucketed: true" in left and "Exchange" not in left
    index.close()
    assert not index.runs()


def test_no_fingerprint_is_in_two_runs(docs):
    """So a compaction only deals rows out, and groups none."""
    keyed = window_index.with_key(docs, "doc_id", "text")
    index = window_index.WindowIndex(docs.sparkSession, fanout=9)
    for k in range(0, 120, 20):
        index.add(keyed.where(f"id >= {k} and id < {k + 20}"))
    every = index.runs()[0]
    for r in index.runs()[1:]:
        every = every.unionByName(r)
    want = window_index.find_runs(keyed, window_index.word_elements, 20, 5).groupBy("anchor", "content", "second").agg(F.min(F.struct("first", "doc", "start")).alias("at"))
    got = every.select("anchor", "content", "second", F.struct("first", "doc", "start").alias("at"))
    assert len(index.runs()) == 6 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    index.close()


@pytest.mark.parametrize("name", ["op3_secret_scan", "op4_suffix_dedup", "op6_window_dedup"])
def test_queries_equal_their_sql(spark, docs, name, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duck.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert sum(bool(r.spans) for r in got) >= 2 if name.startswith("op3") else sum(r.n_removed > 0 for r in got) > 20


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(3)
    out = []
    centres = rng.standard_normal((12, 16))
    for i in range(160):
        c = centres[i % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2])
        out.append((i, [float(x) for x in c.astype(np.float32)], int(i % 2)))
    out += [(200, None, 0), (201, [], 0), (202, [0.0] * 16, 0), (203, [1.0, None] + [0.0] * 14, 0), (204, [float("nan")] * 16, 1), (205, [float("inf")] * 16, 1), (206, out[4][1], None)]
    out += [(207, out[4][1], 0), (208, out[4][1], 0), (209, [2 * x for x in out[4][1]], 0), (210, out[4][1][:8], 0)]
    return out


@pytest.mark.parametrize("cap", [512, 4])
def test_vector_links_equal_brute_force(spark, vector_rows, cap, monkeypatch):
    monkeypatch.setattr(vectors, "CAP", cap)
    df = spark.createDataFrame([(*r, "x") for r in vector_rows], "vec_id long, embedding array<float>, label int, node string")
    good = [(i, np.array(v), g) for i, v, g in vector_rows if g is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    sets, n = Sets(), Counter()
    for i, v, g in good:
        for j, w, h in good:
            if i != j and g == h and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                n[i] += 1
                sets.join(i, j)
    got = {r.id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, recall=0.99999).collect()}
    assert got == {i: (n[i], sets.find(i)) for i, _, _ in vector_rows}
    assert sum(n.values()) > 300
    if cap == 512:
        assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    v = vectors.unit(rng.standard_normal((400, 64)))
    turned = v @ vectors.rotation(64, 0)
    est, bound = vectors.estimates(*vectors.codes(turned), turned)
    true = v @ v.T
    off = ~np.eye(400, dtype=bool)
    assert abs((est - true)[off].mean()) < 0.002
    assert (np.abs(est - true) <= bound)[off].mean() > 0.999


@pytest.mark.parametrize("order", [3, 2, 4])
@pytest.mark.parametrize("size", [1 << 24, 900])
def test_scores_equal_brute_force(docs, rows, size, order, none):
    """Backoff over n-grams, written plainly. Small sizes deal frequent histories over several buckets."""
    small = {"chunk_bytes": size * 5, "bucket_tokens": size, "split": min(size, 60)}
    docs = docs.unionByName(docs.where("doc_id = 65"))
    twice = [*rows, next(r for r in rows if r[0] == 65)]
    found = ngram_lm.score(docs, crc_mod("doc_id", 10) != 0, order=order, **small).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(twice)
    import zlib

    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t, _ in twice]
    learned = [ts for i, ts in tokens if zlib.crc32(str(i).encode()) % 10]
    c = Counter(x for ts in learned for x in ts)
    total, kinds = sum(c.values()), len(c)
    count = Counter()
    for ts in learned:
        full = [0, *ts]
        for n in range(2, order + 1):
            count.update(tuple(full[k : k + n]) for k in range(len(full) - n + 1))
    behind, follow = Counter(), Counter()
    for g, k in count.items():
        behind[g[:-1]] += k
        follow[g[:-1]] += 1

    def p(history, x):
        if not history:
            return (c[x] + 0.1) / (total + 0.1 * (kinds + 1))
        if not behind[history]:
            return p(history[1:], x)
        return max(count[(*history, x)] - 0.75, 0) / behind[history] + 0.75 * follow[history] / behind[history] * p(history[1:], x)

    for i, ts in tokens:
        r = got[i]
        assert (r.learned, r.n_tokens, r.n_known, r.train_tokens) == (bool(zlib.crc32(str(i).encode()) % 10), len(ts), sum(c[x] > 0 for x in ts), total)
        assert r.base_score == pytest.approx(sum(math.log10(p((), x)) for x in ts))
        full = [0, *ts]
        assert r.score == pytest.approx(sum(math.log10(p(tuple(full[max(0, k - order + 1) : k]), full[k])) for k in range(1, len(full))))
    # What a state reaches adds up to one, the unknown's share included.
    state = max((h for h in behind if len(h) == order - 1), key=behind.get)
    assert sum(p(state, x) for x in c) + p(state, "never seen") == pytest.approx(1)
    if size == 900 and order == 3:
        assert ngram_lm.score(none, crc_mod("doc_id", 10) != 0).count() == 0
        alone = ngram_lm.score(docs.where("doc_id = 3"), crc_mod("doc_id", 10) > 100).first()
        assert alone.n_known == 0 and alone.train_tokens == 0 and alone.score == pytest.approx(alone.base_score)


def test_blocks_meet_once(spark):
    df = spark.createDataFrame([(k % 3, i) for i, k in enumerate(range(40))], "key long, node long").where("key < 2 or node = 2")
    out = shards.blocked(df, "key", "node", 4).collect()
    for key in (0, 1):
        held = {(r.block, r.node) for r in out if r.key == key and r.role != shards.ASKS}
        asks = {(r.block, r.node) for r in out if r.key == key and r.role != shards.HELD}
        nodes = {r.node for r in df.where(f"key = {key}").collect()}
        assert {n for _, n in held} == nodes and len(held) == len(nodes)
        assert asks == {(b, n) for b in {b for b, _ in held} | {b for b, _ in asks} for n in nodes}
    assert not [r for r in out if r.key == 2]


def test_pipeline_on_small_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "bpe_encoding"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        before = after
    texts = {r.doc_id: r.text for r in before.collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == set(texts) and 0.7 * docs.count() < len(out) <= docs.count()
    for text in texts.values():
        assert re.search(r"[^\W\d_]", text) and not re.search(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", text)
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts.values()]
    assert len(set(digests)) == len(digests)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        assert not [i for i, t in texts.items() if " ".join(r.text.lower().split()) in " ".join(t.lower().split())]
