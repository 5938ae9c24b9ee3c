"""Helpers that the operators share: Arrow text buffers, checkpoints, caches."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the digest contracts: runs of anything but space and \t \n \v \f \r.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
#: Removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for tokenizers and compiled automata."""
    import pyspark

    return pyspark.__dict__.setdefault("_weftline_cache", {})


def cached(key, build):
    cache = worker_cache()
    if key not in cache:
        cache[key] = build()
    return cache[key]


def latest(kind: str, name, build):
    """As cached, but a worker keeps one of a kind only."""
    cache = worker_cache()
    if cache.get(kind, (None,))[0] != name:
        cache[kind] = (name, build())
    return cache[kind][1]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, named in spark.checkpoint.dir. Where that is unset, a local master gets a folder of this process's own; a cluster gets an error, as machines don't see each other's disks."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        path = cached("checkpoints", lambda: tempfile.mkdtemp(prefix="weftline-checkpoints-"))
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


#: Columns of hashes are written as they are: a dictionary of their values takes time and saves nothing.
PLAIN = {f"parquet.enable.dictionary#{c}": "false" for c in ("anchor", "content", "second", "hash")}


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and reread, so that lineage ends there and later readers don't compute it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weftline-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.options(**PLAIN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def cleaned(spark: SparkSession):
    """The shuffle files behind what is written here go with the query that made them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*frames: DataFrame) -> None:
    """Deletes what saved() wrote for these frames."""
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/weftline-" in f:
                delete(df.sparkSession, f)


#: Bytes of an Arrow batch that a worker gets at a time.
BATCH = "8m"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT = "67108864b"


def mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow(f, schema) in batches of bounded bytes, so that a worker's memory doesn't depend on how long texts are. A session's own setting holds."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, BATCH_DEFAULT) == BATCH_DEFAULT:
        conf.set(BATCH_BYTES, BATCH)
    return df.mapInArrow(f, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list:
    """The batch's strings, null as empty."""
    return [x if x is not None else "" for x in batch.column(column).to_pylist()]


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy: row i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def pieces_of(batch: pa.RecordBatch, limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of at most limit text bytes each (a longer row stands alone)."""
    _, offs = text_bytes(batch, column)
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n
