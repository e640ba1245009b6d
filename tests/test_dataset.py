import pytest
from pyspark.sql import functions as F

from voltide.operators import visibility
from voltide.sources import dataset


def test_records(spark, tmp_path):
    rows = [("1", f"t{i}", "f", "ab"[i % 2], "s", "p", "a", True, "d") for i in range(5)]
    df = spark.createDataFrame(rows, dataset.RECORD)
    folder = f"file://{tmp_path}/data"
    m = dataset.write_records(df.repartition(3), folder)
    assert m["records"] == 5 and m["by_metric"] == {"a": 3, "b": 2}
    assert sorted(map(tuple, dataset.read_records(spark, folder).collect())) == sorted(rows)
    with pytest.raises(ValueError):
        dataset.write_records(df.union(df), f"{folder}2")
    with pytest.raises(ValueError):
        dataset.write_records(df.withColumn("verified", F.lit(False)), f"{folder}3")


def test_trajectories(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "x", ""), ("a", 1, "x", ""), ("b", 1, "x", "")], dataset.EVENT)
    dataset.write_trajectories(df, f"file://{tmp_path}/t")
    assert spark.read.json(f"file://{tmp_path}/t").count() == 3
    assert [r.task_id for r in dataset.broken_trajectories(df).collect()] == ["b"]


def test_public_view(spark):
    df = spark.createDataFrame([(1, 2)], "id int, rng_seed int")
    with pytest.raises(ValueError):
        visibility.public_view(df, ["id", "rng_seed"], {"rngseed"})
