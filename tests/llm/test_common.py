import os
from contextlib import nullcontext

import pytest

from fleetlens.llm import common
from fleetlens.session import AROUND_JOB


def test_written_tables_are_read_back_and_dropped(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    back = common.saved(df, "test")
    assert sorted(r.x for r in back.collect()) == list(range(10)) and back.dtypes == df.dtypes
    path = common._written[-1]
    assert os.path.isdir(path.removeprefix("file:"))
    keep, common._written[:] = common._written[:-1], [path]
    common.drop_written(spark)
    common._written[:] = keep
    assert not os.path.exists(path.removeprefix("file:"))


def test_tables_of_a_job_go_with_it(spark):
    before = common.saved(spark.range(2), "before")
    for fails in (False, True):
        with pytest.raises(KeyError) if fails else nullcontext(), common.job_tables(spark):
            common.saved(spark.range(3), "inside")
            path = common._written[-1].removeprefix("file:")
            assert os.path.isdir(path)
            if fails:
                raise KeyError
        assert not os.path.exists(path) and before.count() == 2
    assert common.job_tables in AROUND_JOB


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
