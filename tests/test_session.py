"""Session settings and the shared folder."""

import pytest

from tidemark import session


def test_sizing():
    assert session.sizing(100 * 10**12)["spark.sql.shuffle.partitions"] == "372530"
    assert session.sizing(1)["spark.sql.shuffle.partitions"] == "200"


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default):
        return self.value if key == "spark.checkpoint.dir" and self.value else default


class _Session:
    """Only what the choice of the folder reads from a session."""

    def __init__(self, master, value=None):
        self.conf = _Conf(value)
        self.sparkContext = type("C", (), {"master": master, "applicationId": "a", "getCheckpointDir": lambda self: None})()


def test_shared_folder_of_a_cluster():
    assert session.shared_dir(_Session("yarn", "hdfs://x/check/")) == "hdfs://x/check"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session("yarn"))


def test_local_session_gets_one_folder():
    local = _Session("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)


def test_materialize(spark):
    df = spark.range(5)
    copy = session.materialize(df, "copy")
    assert copy.dtypes == df.dtypes and copy.count() == 5
    assert session.new_path(spark, "x") != session.new_path(spark, "x")
