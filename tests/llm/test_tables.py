"""Tables between jobs: where they are written, and that they go."""

import os
from types import SimpleNamespace

import pytest

from tidemark.llm import common


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master, setCheckpointDir=lambda d: None))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"])
def test_several_machines_need_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session(master))
    assert common.shared_dir(session(master, "hdfs:///shared/")) == "hdfs:///shared"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_jvm_takes_a_temporary_folder(master):
    assert common.shared_dir(session(master)).startswith("file://")


def test_written_tables_can_be_removed(spark):
    table, other = (common.staged(spark.range(n), "test-tables") for n in (3, 5))
    at = table._staged_at.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(at) and table.count() == 3
    common.discard(table)
    common.discard(table)
    common.discard(spark.range(1))
    assert not os.path.isdir(at) and other.count() == 5
