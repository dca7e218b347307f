import os

from pyspark.sql import functions as F

from mosaiq.llm import prefix, store


def test_written_tables_are_read_back_and_released(spark):
    one = store.materialize(spark.range(5), "t")
    two = store.materialize(spark.range(0).withColumn("x", F.lit("a")), "t")
    assert one.count() == 5 and two.columns == ["id", "x"] and two.count() == 0
    folder = store.shared_dir(spark).removeprefix("file://")
    assert any(p.startswith("t-") for p in os.listdir(folder))
    assert store.release(spark) >= 2
    assert not any(p.startswith("t-") for p in os.listdir(folder)) and store.release(spark) == 0


def test_running_sums_of_hot_null_and_tied_groups(spark):
    rows = [("hot", k, k % 7) for k in range(3000)] + [(None, 1, 5), (None, 1, 5), ("one", 9, 2)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(3)
    out = prefix.running(df, "g", ["k", "v"], F.col("v"), "before", least=16)
    assert out.columns == ["g", "k", "v", "before"]
    for g in ("hot", None, "one"):
        own = sorted(((r.before, r.v) for r in out.collect() if r.g == g))
        at = 0
        for before, v in sorted(own, key=lambda x: (x[0], x[1])):
            assert before == at or v == 0
            at = max(at, before + v)
        assert at == sum(v for gg, _, v in rows if gg == g)
