"""Tables that are computed once and kept in the folder all machines share."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df computed and kept in the shared folder that the cluster names (on a single machine, if it names none, our own)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lodeframe-checkpoints"))
    return df.checkpoint()
