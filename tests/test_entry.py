"""The driver contract, and streams against their batch forms."""

import random

from pyspark.sql import functions as F

from loomery.operators import crdt
from loomery.plans import catalog
from loomery.streaming import state

CELL = "soul string, key string, vtype string, v_text string, v_num double, v_bool boolean, v_link string, state double"


def test_catalog_is_consistent():
    names, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 200


def test_stream_merge_equals_batch_merge(spark, tmp_path):
    rng = random.Random(3)
    ops = [(f"s{rng.randrange(4)}", f"k{rng.randrange(3)}", "text", rng.choice(["a", "b", "cc", "dd", "eee"]), None, None, None, float(rng.randrange(5))) for _ in range(120)]
    for i in range(0, 120, 40):
        spark.createDataFrame(ops[i : i + 40], CELL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ops")
    stream = spark.readStream.schema(CELL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ops")
    state.run_available(state.ham_stream(stream), "parquet", f"{tmp_path}/out", f"{tmp_path}/check")
    cols = ("soul", "key", "v_text", "state")
    last = crdt.ham(spark.read.parquet(f"{tmp_path}/out")).select(*cols)
    batch = crdt.ham(spark.createDataFrame(ops, CELL)).select(*cols)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_eviction_spares_pinned_rows(spark):
    access = spark.createDataFrame([(f"s{i}", i) for i in range(12)], "soul string, last long")
    pinned = spark.createDataFrame([("s0",)], "soul string")
    assert [r[0] for r in crdt.evict(access, 11, pinned).orderBy("soul").collect()] == ["s1", "s2"]
    assert crdt.evict(access, 12, pinned).count() == 0


def test_documents_stop_at_circles(spark):
    rows = [("a", "x", "link", None, None, None, "b", 1.0), ("b", "y", "link", None, None, None, "a", 1.0), ("b", "n", "num", None, 2.0, None, None, 1.0)]
    cells = spark.createDataFrame(rows, CELL)
    got = crdt.documents(cells, cells.select("soul").distinct().filter(F.col("soul") == "a"), 3).head()["document"]
    assert got == '{"x":{"n":2,"y":{"#":"a"}}}'
