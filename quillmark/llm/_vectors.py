"""Dense count vectors, summed in a tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

FAN = 32


def tree_sum(vectors: DataFrame, lanes: int, *, fan: int = FAN) -> DataFrame:
    """(slot, counts) from rows (slot, lane, counts): counts are 64-bit vectors as bytes, equally long within a slot, lanes count from 0.

    Each round adds up to ``fan`` neighbouring lanes of a slot, so that no task holds more than that many vectors, however
    many tasks counted. Rows of one lane and slot are added as well; an empty table gives no rows.
    """

    def add(batch: pa.Table) -> pa.Table:
        total = None
        for x in batch.column("counts"):
            v = np.frombuffer(x.as_py(), np.int64)
            total = v.copy() if total is None else total + v
        return pa.table({"slot": batch.column("slot")[:1], "lane": batch.column("lane")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    while True:
        vectors = vectors.select("slot", F.floor(F.col("lane") / fan).alias("lane"), "counts").groupBy("slot", "lane").applyInArrow(add, "slot int, lane bigint, counts binary")
        lanes = -(-lanes // fan)
        if lanes <= 1:
            return vectors.select("slot", "counts")
