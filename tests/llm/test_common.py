from __future__ import annotations

from types import SimpleNamespace

import pytest

from skein.llm.common import shared_dir


def session(master: str, at: str | None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: at or default), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    assert shared_dir(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    for master in ("local", "local[8]", "local[*]"):
        assert shared_dir(session(master, None)).startswith("file://")
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master, None))
