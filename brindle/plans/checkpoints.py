"""Cutting lineage in loops: checkpoint() to the shared folder; our own folder only where all runs in one process."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        place = sc.getConf().get("spark.checkpoint.dir", None)
        if not place and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="brindle-"))
    return df.checkpoint()
