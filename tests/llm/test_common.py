"""The shared folder and joins of groups."""

import os

import pyarrow as pa
import pytest

from jobsift.llm import common
from jobsift.llm.common import join_groups, settle, shared_dir, stage, sweep, unstage

from pyspark.sql import functions as F


def test_stages_lie_in_the_shared_folder(spark):
    where = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == where
    df = stage(spark.range(3), "t")
    files = [f.removeprefix("file://") for f in df.inputFiles()]
    assert all(f.startswith(where.removeprefix("file://")) for f in files) and df.count() == 3
    unstage(df)
    assert not any(os.path.exists(f) for f in files)


def test_join_groups(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i % 40}", i) for i in range(80)] + [("alone", 1), (None, 2)], "k string, i int")
    groups = stage(rows.filter("k is not null and k <> 'alone'").groupBy("k").agg(F.count("*").alias("n")), "g")
    for total in (rows.count(), 10**6):  # with and without hot groups
        left = join_groups(rows, groups, "k", "n", total, "left")
        assert left.columns == ["k", "i", "n"] and left.count() == rows.count()
        assert {(r.k, r.n) for r in left.collect()} == {("hot", 500), ("alone", None), (None, None), *((f"k{i}", 2) for i in range(40))}
        assert join_groups(rows, groups, "k", "n", total).count() == 580


def test_settle_and_sweep_delete_what_was_staged(spark):
    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    sweep(spark)
    out = settle(lambda: stage(spark.range(3), "half"), "whole")
    assert [x for x in os.listdir(where) if x.startswith(("half", "whole"))] == [out._jobsift_path.rpartition("/")[2]] and out.count() == 3
    assert sweep(spark) == 1 and not [x for x in os.listdir(where) if x.startswith("whole")]


def test_cluster_without_shared_folder_is_refused(monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, *other: "file:/tmp/warehouse" if "warehouse" in key else None)

        class sparkContext:
            master = "yarn"
            getConf = staticmethod(lambda: Cluster.conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
    monkeypatch.setattr(Cluster.conf, "get", staticmethod(lambda key, *other: "hdfs://n/w" if "warehouse" in key else None))
    assert shared_dir(Cluster) == "hdfs://n/w/_stages"


def test_slices_are_bounded_by_rows_and_bytes(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 2000)], names=["t"])
    assert [b.num_rows for b in common.slices([batch])] == [512, 512, 512, 464]
    monkeypatch.setattr(common, "BATCH_BYTES", 10_000)
    assert max(b.num_rows for b in common.slices([batch])) == 9 and sum(b.num_rows for b in common.slices([batch])) == 2000
    monkeypatch.setattr(common, "BATCH_BYTES", 10)
    assert {b.num_rows for b in common.slices([batch])} == {1} and not list(common.slices([batch.slice(0, 0)]))
