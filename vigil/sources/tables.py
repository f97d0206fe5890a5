"""Driver tables and their mapping onto the sensor-run model.

``events``  : run = user_id, order = (ts, event_id), sensors = value and the
              ``k`` field of ``props``, label 0 = view/click, 1 = signup,
              2 = purchase, 3 = error.
``lineitem``: run = l_suppkey, order = (l_shipdate, l_orderkey, l_linenumber),
              sensors = quantity, price, discount, tax, label = l_returnflag.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.columns import epoch_seconds
from vigil.operators.timeline import Timeline

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Label id of each event type (the event stream's "attack id").
EVENT_LABEL_IDS = {"view": 0, "click": 0, "signup": 1, "purchase": 2, "error": 3}
EVENT_LABEL_NAMES = {0: "normal", 1: "signup", 2: "purchase", 3: "error"}


def event_label(c="event_type"):
    e = F.col(c)
    return (F.when(e == "signup", 1).when(e == "purchase", 2)
            .when(e == "error", 3).otherwise(0)).cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with typed sensor ``k``, ``label`` and seconds ``t``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        event_label().alias("label"),
        epoch_seconds("ts").alias("t"),
    )


EVENTS_TL = Timeline(run="user_id", order=("ts", "event_id"), t="t", label="label",
                     sensors=("value", "k"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("t", epoch_seconds("l_shipdate"))


LINEITEM_TL = Timeline(run="l_suppkey", order=("l_shipdate", "l_orderkey", "l_linenumber"),
                       t="t", label="l_returnflag",
                       sensors=("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
