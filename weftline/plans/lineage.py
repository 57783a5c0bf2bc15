"""Cutting lineage in loops: a reliable checkpoint in the folder the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame

_own: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in ``spark.checkpoint.dir``, in the checkpoint folder set before, or in one of our own where there is none and the master is local (tests)."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own.append(tempfile.mkdtemp(prefix="weftline-loop-"))
        atexit.register(shutil.rmtree, _own[-1], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{_own[-1]}")
    return df.checkpoint()
