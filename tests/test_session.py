"""Intermediate tables and the folder they lie in."""

import os

import pytest

from textloom import session


class Unset:
    """A session whose checkpoint folder is not set."""

    def __init__(self, spark):
        self.sparkContext, self.read = spark.sparkContext, spark.read
        self.conf = self

    def get(self, key, default):
        return default


def test_folder_of_the_session_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or session.shared_folder(spark) == named.rstrip("/")


def test_own_folder_where_none_is_set(spark):
    a, b = session.shared_folder(Unset(spark)), session.shared_folder(Unset(spark))
    assert a == b and a.startswith("file:///") and os.path.isdir(a.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster(Unset):
        def __init__(self, spark):
            super().__init__(spark)
            self.sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster(spark))


def test_workspace(spark):
    work = session.Workspace(Unset(spark), "test")
    made = work.save(spark.range(5).repartition(2), "five")
    assert made.count() == 5
    folder = work.path("five").removeprefix("file://")
    assert os.path.isdir(folder)
    work.remove("five")
    assert not os.path.exists(folder)


def test_workers_find_the_package_from_any_folder(tmp_path):
    """Neither the working folder nor PYTHONPATH tells the workers where the package is."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from textloom.session import local_session\nfrom textloom import queries\n"
        "print('rows', queries.QUERIES['document_variety'](local_session(2), '/root/testdata/sf0.001').count(),"
        " queries.QUERIES['heuristics_window'](local_session(2), '/root/testdata/sf0.001').agg({'word_entropy': 'max'}).first()[0] > 0)"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("PYSPARK_GATEWAY")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 200 True" in done.stdout, done.stderr[-2000:]
