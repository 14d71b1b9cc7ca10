"""Written tables of operators: kept, dropped and cleared; a cluster needs a shared folder."""

import os

import pytest

from brinework import checkpoint


def files(root):
    path = root.removeprefix("file://")
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_workspace(spark):
    work = checkpoint.Workspace(spark, "test")
    one, two = work.cut(spark.range(3), "one"), work.cut(spark.range(4), "two")
    assert one.count() == 3 and two.count() == 4 and files(work.root) == ["one", "two"]
    work.drop("one")
    assert files(work.root) == ["two"]
    assert checkpoint.clear(spark) >= 1 and files(work.root) == [] and checkpoint.clear(spark) == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="shar"):
        checkpoint.shared_dir(Session())
