"""Sums over a whole table by one pass: every task adds up its own batches in
numpy and sends one array, the arrays are added in rounds over Spark, the driver gets the total."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 64                 # arrays added by one task


def blocks(df: DataFrame, pack: Callable[[pd.DataFrame], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """One row for each batch of ``df``: the bytes of the arrays ``pack`` makes of it.
    Passes over the blocks read numbers as they lie, no row is taken apart again."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                made = pack(b)
                yield pd.DataFrame({c: [np.ascontiguousarray(made[c]).tobytes()] for c in names})

    return df.mapInPandas(run, ", ".join(f"{c} binary" for c in names))


def total(df: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``part(batch)`` (arrays of ``size`` doubles) over all batches of
    ``df``, a checkpointed frame.  The arrays are bounded by the model, not by the rows."""
    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(size)
        for b in batches:
            acc += part(b)
        yield pd.DataFrame({"part": [acc.tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = sum((np.frombuffer(b) for b in pdf["part"]), np.zeros(size))
        return pd.DataFrame({"part": [acc.tobytes()]})

    tasks = df.rdd.getNumPartitions()
    sums = df.mapInPandas(own, "part binary")
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        sums = (sums.withColumn("to", F.pmod(F.spark_partition_id(), F.lit(tasks)))
                .groupBy("to").applyInPandas(lambda pdf: added(pdf[["part"]]), "part binary"))
    # one job for all tasks (an iterator over partitions would run them one after the other); at most FAN_IN arrays come
    return sum((np.frombuffer(r["part"]) for r in sums.collect()), np.zeros(size))
