"""A stream made by polling (S8): ``spark.readStream.format("vigil_poll")``.

Each poll calls ``reader(poll number, argument)``, named by the option ``reader``
("module:function"), and gives its readings, one row each with the number of the
poll.  A poll that fails is tried again; after ``retries`` failures it gives one
row with null readings, so a gap in the polls is seen and the stream goes on.
Offsets are poll numbers, kept in the checkpoint: a restarted query goes on where
it was, and polls of a batch that is run again are asked for again by their number.

Options: reader, argument, schema (of a reading, DDL), polls (how many there are;
default without end), batch (polls of one micro-batch, default 1), retries
(default 3), wait (seconds between tries, default 0.2).
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Poll(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PollReader(DataSourceStreamReader):
    def __init__(self, options: dict, fields: int):
        self.options, self.fields = dict(options), fields
        self.polls, self.batch = int(options.get("polls", -1)), int(options.get("batch", 1))
        self.next = None

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        """One batch further each time it is asked, up to the last poll."""
        self.next = self.batch if self.next is None else self.next + self.batch
        if self.polls >= 0:
            self.next = min(self.next, self.polls)
        return {"poll": self.next}

    def partitions(self, start: dict, end: dict) -> list[Poll]:
        self.next = max(self.next or 0, end["poll"])              # after a restart: go on from the checkpoint
        return [Poll(n) for n in range(start["poll"], end["poll"])]

    def read(self, partition: Poll) -> Iterator[tuple]:
        module, _, name = self.options["reader"].partition(":")
        reader = getattr(importlib.import_module(module), name)
        for attempt in range(int(self.options.get("retries", 3))):
            if attempt:
                time.sleep(float(self.options.get("wait", 0.2)))
            try:
                rows = list(reader(partition.number, self.options.get("argument")))
            except Exception:  # noqa: BLE001  whatever the endpoint raises is a failed poll
                continue
            yield from ((partition.number, *r) for r in rows)
            return
        yield (partition.number, *[None] * self.fields)

    def commit(self, end: dict) -> None:
        pass


class PollSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vigil_poll"

    def schema(self) -> str:
        return f"poll bigint, {self.options['schema']}"

    def streamReader(self, schema: T.StructType) -> PollReader:
        return PollReader(self.options, len(schema.fields) - 1)


def polled(spark: SparkSession, reader: str, schema: str, argument: str = "", **options):
    """The stream of the polls of ``reader``."""
    spark.dataSource.register(PollSource)
    s = spark.readStream.format("vigil_poll").option("reader", reader).option("schema", schema).option("argument", argument)
    for k, v in options.items():
        s = s.option(k, str(v))
    return s.load()


def snapshot(number: int, folder: str) -> Iterator[tuple]:
    """Readings of the snapshot ``folder``/poll=<number>, JSON lines (a recorded
    endpoint): raises where there is none.  The folder may be in any store Arrow can open."""
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(folder)
    files = [f.path for f in store.get_file_info(fs.FileSelector(f"{path}/poll={number}")) if f.path.endswith(".json")]
    for file in sorted(files):
        with store.open_input_stream(file) as f:
            for line in f.read().decode().splitlines():
                row = json.loads(line)
                yield row["event_id"], row["user_id"], row.get("value")
