import os

import pytest

from tickloom.plans import storage


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError):
        storage._local_dir("spark://host:7077")
    assert os.path.isdir(storage._local_dir("local[2]").removeprefix("file://"))


def test_tables_go_to_the_named_folder_and_keep_their_types(spark):
    df = spark.range(5).selectExpr("id", "CAST(NULL AS array<double>) AS v")
    back = storage.materialise(df, "test")
    assert back.dtypes == df.dtypes and back.count() == 5
    assert spark.conf.get("spark.checkpoint.dir").removeprefix("file://") in back.inputFiles()[0]


def test_intermediate_tables_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(storage, "_made", [])
    path = storage.materialise(spark.range(5), "test").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    storage.drop_intermediate(spark)
    assert not os.path.exists(path) and not storage._made
