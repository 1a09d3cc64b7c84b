import types

import pyarrow as pa
import pytest

from creditloom.llm import bytesops


def session(master, folder=None):
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: context.__dict__.get("set"), setCheckpointDir=lambda x: context.__dict__.update(set=x))
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda key, other: folder or other))


def test_a_cluster_must_name_its_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            bytesops.shared_dir(session(master))
        assert bytesops.shared_dir(session(master, "hdfs:///shared")) == "hdfs:///shared"
    assert bytesops.shared_dir(session("local[4]")) and bytesops.shared_dir(session("local", "/x")) == "/x"


def test_parts_by_bytes_keep_rows_and_order():
    column = pa.array([b"a" * 10, None, b"b" * 5_000, b"", b"c" * 900, b"d" * 900], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), column], ["i", "x"])
    parts = list(bytesops.by_bytes(iter([batch, batch.slice(0, 0)]), 1, 1_500))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(6)) and len(parts) >= 3
    assert all(p.num_rows == 1 or sum(len(x or b"") for x in p.column(1).to_pylist()) <= 1_500 for p in parts)
