"""Where work tables go on a cluster."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from wayfare.llm import common
from wayfare.operators import tables


def on_cluster(spark, own: dict, given: str | None = None):
    """The session as one of a standalone cluster, whose machines are all this one."""
    real = spark.sparkContext
    context = SimpleNamespace(master="spark://host:7077", defaultParallelism=3, applicationId="app", getCheckpointDir=lambda: given, _jvm=real._jvm, _jsc=real._jsc)
    return SimpleNamespace(conf=own, sparkContext=context, range=spark.range, read=spark.read)


@pytest.mark.parametrize("work_root", [tables.work_root, common.work_root])
def test_shared_folder_of_a_cluster(spark, tmp_path, work_root):
    """A folder that all machines see counts, whatever its name begins with; nothing stays behind in it."""
    for scheme in ("file://", ""):
        assert work_root(on_cluster(spark, {"spark.checkpoint.dir": f"{scheme}{tmp_path}/a/"})) == f"{scheme}{tmp_path}/a"
        assert work_root(on_cluster(spark, {}, f"{scheme}{tmp_path}/b")) == f"{scheme}{tmp_path}/b"
        assert work_root(on_cluster(spark, {"spark.sql.warehouse.dir": f"{scheme}{tmp_path}/c"})) == f"{scheme}{tmp_path}/c/_work"
    assert not [p for p in tmp_path.rglob("*") if not p.is_dir()]


@pytest.mark.parametrize("work_root", [tables.work_root, common.work_root])
def test_local_folder_of_a_cluster(spark, tmp_path, monkeypatch, work_root):
    """If the driver doesn't find what the tasks wrote, the folder is refused."""
    monkeypatch.setattr(tables, "_SHARED", {})
    own = on_cluster(spark, {"spark.checkpoint.dir": f"file://{tmp_path}"})
    empty = str(tmp_path / "of-another-machine")
    spark.range(0).write.parquet(empty)
    own.read = SimpleNamespace(schema=lambda kind: SimpleNamespace(parquet=lambda path: spark.read.schema(kind).parquet(empty)))
    with pytest.raises(ValueError, match="all executors share"):
        work_root(own)
