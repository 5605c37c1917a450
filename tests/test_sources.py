"""Files, slices, the database writer and shared datasets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from starpath.operators.datasets import Datasets, keep, spread
from starpath.session import cut_lineage, shared_folder
from starpath.sources import jdbc, lines, tables


def ratings(spark):
    return spark.range(1000).select(
        F.col("id").alias("user_id"), F.lit(3.0).alias("rating"),
        F.when(F.col("id") < 600, "winter").otherwise("summer").alias("season"),
        F.when(F.col("id") % 2 == 0, "NV").otherwise("QC").alias("state"))


def test_slices_are_pruned(spark, tmp_path):
    path = str(tmp_path / "ratings")
    tables.write_slices(ratings(spark), path)
    assert tables.read_slice(spark, path, "winter").count() == 600
    one = tables.read_slice(spark, path, "summer", "QC")
    assert one.count() == 200
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "summer" in filters and "QC" in filters


def test_lines_and_appended_records(spark, tmp_path):
    path = str(tmp_path / "lines")
    lines.write_lines(spark.createDataFrame([("0::1::5::1",)], "value string"), path)
    lines.write_lines(spark.createDataFrame([("0::2::4::1",)], "value string"), path, "append")
    assert sorted(row.value for row in lines.read_lines(spark, path).collect()) == ["0::1::5::1", "0::2::4::1"]


def test_tuples_as_text(spark, tmp_path):
    path = str(tmp_path / "tuples")
    df = spark.createDataFrame([("Montreal", "autumn", "a1", 'Chez "Z", Fils')], "c string, s string, i string, n string")
    lines.write_tuples(df, path)
    back = spark.read.option("escape", '"').csv(path, schema=df.schema)
    assert back.collect() == df.collect()


def test_jdbc_writer_options(spark, monkeypatch):
    """No database is started here; the options a save would use are recorded instead."""
    seen = {}

    class Recorder:
        def format(self, name):
            seen["format"] = name
            return self

        def mode(self, name):
            seen["mode"] = name
            return self

        def option(self, key, value):
            seen[key] = value
            return self

        def save(self):
            seen["saved"] = True

    class Frame:
        write = Recorder()

    jdbc.write_jdbc(Frame(), "jdbc:x:y", "stores", "org.example.Driver", connections=3)
    assert seen == {"format": "jdbc", "mode": "overwrite", "driver": "org.example.Driver", "numPartitions": 3,
                    "batchsize": 10_000, "url": "jdbc:x:y", "dbtable": "stores", "saved": True}


def test_datasets_are_built_once_and_released(spark):
    calls = []

    def build(n):
        calls.append(n)
        return keep(spark.range(n))

    with Datasets() as shared:
        assert shared.get(build, 5) is shared.get(build, 5)
        shared.get(build, 6)
        assert calls == [5, 6] and len(shared) == 2
        kept = shared.get(build, 5)
        assert kept.storageLevel.useMemory
    assert not kept.storageLevel.useMemory and len(shared) == 0


def test_unpersisted_datasets_are_refused(spark):
    with pytest.raises(ValueError):
        Datasets().get(lambda: spark.range(3))


def test_spread(spark):
    assert spread(spark.range(10), 3).rdd.getNumPartitions() == 3
    assert spread(spark.range(10)).count() == 10


def test_checkpoints_go_to_the_shared_folder(spark):
    folder = shared_folder(spark)
    assert folder and cut_lineage(spark.range(3)).count() == 3
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or folder == configured
