"""The queries opN_<name>: each applies its operator with production parameters to whole tables and derives the digest columns."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, ngram_lm, secrets, simhash, suffix_merge, token_count, vectors, window_index
from .common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = language.train(docs.where(~held_out))
    out = language.predict(docs, model)
    return out.withColumn("held_out", held_out)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.linked(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def span_digest(df: DataFrame) -> DataFrame:
    """The digest columns of secret spans."""
    base = [r.kind for r in secrets.BASE]
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    own = F.filter("spans", lambda x: x["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return df.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(text(own), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_merge.deduplicate(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op6_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = window_index.deduplicate(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op8_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = ngram_lm.score(docs, crc_mod("doc_id", 10) != 0)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_window_dedup": op6_window_dedup,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_backoff_scores": op8_backoff_scores,
    "op9_decontaminate": op9_decontaminate,
    "op10_bpe_codec": op10_bpe_codec,
}

def either_case(pattern: str) -> str:
    """pattern with each ASCII letter as a class of both its cases."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


#: Rules of a secret for SQL: kind, expression, and the group that must have at least so many characters.
SECRETS_SQL = (
    ("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0, 0),
    ("forge_token", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)


def secrets_sql() -> str:
    """A match's start is the length of all that stands before it: matches, and what is between them."""
    legs = []
    for rank, (kind, pattern, group, least) in enumerate(SECRETS_SQL):
        e = "'" + pattern.replace("'", "''") + "'"
        legs.append(f"select doc_id, '{kind}' as kind, {rank} as rank, regexp_extract_all(text, {e}) as m, regexp_extract_all(text, {e}, {group}) as v, {least} as least, regexp_split_to_array(text, {e}) as gaps from texts")
    return f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(legs)}),
each as (select doc_id, kind, rank, least, unnest(m) as m, unnest(v) as v, unnest(gaps[1:len(m)]) as gap, unnest(range(len(m))) as k from found where len(m) > 0),
placed as (select *, sum(length(gap) + length(m)) over (partition by doc_id, rank order by k) as stop from each),
spans as (select doc_id, kind, rank, stop - length(m) as start, kind || ':' || (stop - length(m)) || ':' || stop as span from placed where length(v) >= least)
select t.doc_id, count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access, count(*) filter (where rank = 2) as n_hex,
  sha256(coalesce(string_agg(span, ',' order by start, rank) filter (where rank < 3), '')) as base_sha256, coalesce(string_agg(span, ',' order by start, rank), '') as spans
from texts t left join spans using (doc_id) group by t.doc_id"""


#: Where SQL says the same. The others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_secret_scan": secrets_sql(),
    "op4_suffix_dedup": """
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
places as (select doc_id, unnest(list_transform(range(len(h) // 2), lambda i: substr(h, 2 * i + 1, 2))) as b, unnest(range(len(h) // 2)) as pos from texts),
windows as (
  select *, case when count(*) over f = 200 then string_agg(b, '') over f end as s
  from places window f as (partition by doc_id order by pos rows between current row and 199 following)
),
repeats as (select doc_id, pos, b, s is not null and count(*) over (partition by s) > 1 as again from windows),
covered as (select *, bool_or(again) over (partition by doc_id order by pos rows between 199 preceding and current row) as gone from repeats),
edges as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by pos), false) as opens from covered)
select t.doc_id, count(e.b) as n_bytes, count(*) filter (where e.gone) as n_removed, count(*) filter (where e.opens) as n_spans,
  sha256(unhex(coalesce(string_agg(e.b, '' order by e.pos) filter (where not e.gone), ''))) as kept_sha256
from texts t left join edges e using (doc_id) group by t.doc_id""",
    "op6_window_dedup": r"""
with lists as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as l from documents),
words as (select doc_id, unnest(l) as word, unnest(range(len(l))) as pos from lists),
windows as (
  select *, case when count(*) over f = 20 then string_agg(word, ' ') over f end as s
  from words window f as (partition by doc_id order by pos rows between current row and 19 following)
),
repeats as (select *, s is not null and row_number() over (partition by s order by doc_id, pos) > 1 as later from windows),
covered as (select *, bool_or(later) over (partition by doc_id order by pos rows between 19 preceding and current row) as gone from repeats)
select l.doc_id, count(c.word) as n_words, count(*) filter (where c.gone) as n_removed, sha256(coalesce(string_agg(c.word, ' ' order by c.pos) filter (where not c.gone), '')) as kept_sha256
from lists l left join covered c using (doc_id) group by l.doc_id""",
    "op7_vector_dedup": """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
reached as (select vec_id as a, vec_id as b from v union select r.a, l.b from reached r join links l on r.b = l.a)
select vec_id, (select count(*) from links where a = vec_id) as n_links, low as component_id, vec_id = low as kept
from v join (select a, min(b) as low from reached group by a) on a = vec_id""",
}
