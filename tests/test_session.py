from types import SimpleNamespace

import pytest

from evispark import session
from evispark.operators.once import once_each


def test_a_cluster_needs_a_shared_folder():
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf={}))
    used = []
    sc.setCheckpointDir = used.append
    session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf={"spark.checkpoint.dir": "/shared"}))
    assert used == ["/shared"]


def test_repeated_rows_once(spark):
    rows = [("a", None, "x"), ("a", None, "x"), ("a", None, "y"), (None, 1, None), (None, 1, None), ("b", 2, "")]
    df = spark.createDataFrame(rows, "id string, n int, text string")
    assert sorted(map(str, (tuple(r) for r in once_each(df).collect()))) == sorted(map(str, set(rows)))
    assert once_each(df.limit(0)).count() == 0
