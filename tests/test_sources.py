"""File and JDBC sources, and the event windows over a batch and a stream."""

import importlib.util
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.functions.conditions import eq
from weftline.operators.query import Database
from weftline.plans import model as M
from weftline.sources.tables import catalog, directory
from weftline.streaming.events import sessions, windowed


@pytest.fixture(scope="module")
def model():
    m = M.Model()
    m.entity("t", "id", id=M.integer(), name=M.text())
    return m


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_directory(spark, model, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    df.write.format(kind).options(header=True).save(f"{tmp_path}/t.{kind}")
    read = directory(spark, str(tmp_path), kind, header=True, inferSchema=True)
    assert [r["name"] for r in Database(spark, model, read).t.where(lambda t: eq(t.id, 1)).to_list()] == ["a"]


def test_catalog(spark, model):
    spark.createDataFrame([(1, "a")], "id int, name string").createOrReplaceTempView("t")
    assert Database(spark, model, catalog(spark)).t.count() == 1


ON_A_CLUSTER = """
import json, sys
from pyspark.sql import SparkSession
from weftline.plans import registry
from weftline.sources import tables
spark = SparkSession.builder.config(map=json.loads(sys.argv[1])).getOrCreate()
said = {"query": registry.QUERIES["jdbc_round_trip"](spark, "/root/testdata/sf0.001").collect()}
tables.BYTES_AT_ONCE, tables.ROWS_WEIGHED = 1, 3
url = "jdbc:derby:memory:more;create=true"
rows = spark.range(0, 7, 1, 3).selectExpr("id", "case when id <> 4 then 'n' || id end as name", "timestamp'2024-01-01' + make_dt_interval(id) as at")
read = lambda name: [[r[0], r[1], r[2].isoformat()] for r in tables.jdbc(spark, url, "id", (2, 5), 2)(name).collect()]
for mode in ("overwrite", "append", "ignore", "overwrite", "error"):
    try:
        tables.jdbc_sink(rows, url, "many", mode)
        said[mode] = [*said.get(mode, []), read("many")]
    except Exception as e:
        said[mode] = "already exists" in str(e)
tables.jdbc_sink(rows.limit(0), url, "hollow", "ignore")
said["hollow"] = read("hollow")
print("SAID" + json.dumps(said))
spark.stop()
"""


def test_a_database_of_the_drivers_process_where_executors_are_others(tmp_path):
    home = tmp_path / "home"  # Spark's, with a folder of its own for the executors
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    conf = {
        "spark.master": "local-cluster[1,2,1024]", "spark.executor.memory": "600m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{tmp_path}/shared", "spark.sql.warehouse.dir": f"{tmp_path}/warehouse",
    }
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")} | {
        "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": f"{tmp_path}/local", "PYTHONPATH": str(Path(__file__).parents[1]), "PYSPARK_PYTHON": sys.executable, "TZ": "UTC",
    }
    run = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, json.dumps(conf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "SAID" in run.stdout, [x for x in run.stderr.splitlines() if "Error" in x or "Exception" in x][:5]
    said = json.loads(run.stdout.partition("SAID")[2].splitlines()[0])
    rows = [[i, None if i == 4 else f"n{i}", f"2024-01-0{i + 1}T00:00:00"] for i in range(7)]
    assert sorted(said["query"]) == [[0, "AFRICA"], [1, "AMERICA"], [2, "ASIA"], [3, "EUROPE"], [4, "MIDDLE EAST"], [9, "NINE"]]
    assert [sorted(x, key=str) for x in said["overwrite"]] == [rows, rows] and said["error"] is True and said["hollow"] == []
    assert sorted(said["append"][0], key=str) == sorted(said["ignore"][0], key=str) == sorted(rows + rows, key=str)


EVENTS = [("2024-01-01 00:01:00", "a"), ("2024-01-01 00:04:00", "a"), ("2024-01-01 00:12:00", "b"), ("2024-01-01 00:13:00", "a")]


def test_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    want = sorted(windowed(df, "ts", "10 minutes", keys=("kind",)).select("window.start", "kind", "n").collect())
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = windowed(stream, "ts", "10 minutes", keys=("kind",), late="1 minute").select("window.start", "kind", "n")
    q = out.writeStream.format("memory").queryName("windows_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("windows_out").collect()) == want and [r.n for r in want] == [2, 1, 1]


def test_sessions(spark):
    df = spark.createDataFrame(EVENTS, "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in sessions(df, "ts", "5 minutes", ("kind",)).collect()) == [1, 1, 2]
