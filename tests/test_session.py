"""Session helpers: checkpoint folder, scratch paths, local shuffle sizing."""

from __future__ import annotations

from clickrank.session import CHECKPOINT_CONF, ensure_checkpoint_dir, scratch_path


def test_checkpoint_dir_and_scratch(spark):
    base = ensure_checkpoint_dir(spark)
    assert spark.conf.get(CHECKPOINT_CONF) == base
    assert spark.sparkContext.getCheckpointDir() is not None
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(base.rstrip("/") + "/x-")
