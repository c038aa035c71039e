"""Progress of running jobs: the latest state and the last log lines of each key, over a table or a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Log lines that are kept for each key.
LINES = 20
PROGRESS = "key string, seq long, status string, log array<string>"


def progress(events: DataFrame, lines: int = LINES) -> DataFrame:
    """key, seq, status, log: of each key the last event's number and status, and the last lines' details in order. events: key, seq, status, detail (null: no line).

    A batch keeps a list of each key's details while it aggregates; streams keep no more than lines of them."""
    logged = F.array_sort(F.collect_list(F.when(F.col("detail").isNotNull(), F.struct("seq", "detail"))))
    rows = events.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("status", "seq").alias("status"), logged.alias("l"))
    return rows.select("key", "seq", "status", F.transform(F.slice("l", F.greatest(F.size("l") - lines + 1, F.lit(1)), lines), lambda x: x["detail"]).alias("log"))


class Latest(StatefulProcessor):
    """Keeps the last status and lines of a key; events may come in any order."""

    def __init__(self, lines: int):
        self.lines = lines

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, status string")
        self.log = handle.getValueState("log", "seqs array<long>, details array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seq, status = self.last.get() if self.last.exists() else (None, None)
        held = list(zip(*self.log.get(), strict=True)) if self.log.exists() else []
        for part in rows:
            for n, said, detail in part.sort_values("seq")[["seq", "status", "detail"]].itertuples(index=False, name=None):
                if seq is None or n >= seq:
                    seq, status = int(n), said
                if detail is not None:
                    held.append((int(n), detail))
        held = sorted(held)[-self.lines :]
        self.last.update((seq, status))
        self.log.update(([n for n, _ in held], [d for _, d in held]))
        yield pd.DataFrame({"key": [key[0]], "seq": [seq], "status": [status], "log": [[d for _, d in held]]})

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, lines: int = LINES) -> DataFrame:
    """progress() of a stream: a row for each key that a batch brings news of. The session needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(Latest(lines), PROGRESS, "Update", "None")
