"""The gate before a company's next period, kept across the micro-batches of a stream of filings.

Each company's state is its last period and, of what was let in, the periods and the content hashes. A filing comes in if it is the company's first or if it
follows the last period by one step; otherwise it is refused with a reason, and nothing is kept of it, so it can come again:

* ``no_dates``: it has no period;
* ``repeated``: the same content came in before;
* ``occupied``: its period is there, with other content;
* ``late``: its period lies before the last one and was never there;
* ``not_contiguous``: a period is missing before it.

A company's state grows with its own periods only. What one batch brings for a company is decided in the order of periods, then of hashes.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISIONS = "company string, period_end date, sha string, decision string, last date"


def months_after(later: datetime.date, earlier: datetime.date) -> int:
    """Whole months between two month ends."""
    return (later.year - earlier.year) * 12 + later.month - earlier.month


class Gate(StatefulProcessor):
    def __init__(self, step: int):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "period_end date")
        self.periods = handle.getMapState("periods", "period_end date", "sha string")
        self.contents = handle.getMapState("contents", "sha string", "period_end date")

    def decide(self, end: datetime.date | None, sha: str, last: datetime.date | None) -> str:
        if end is None:
            return "no_dates"
        if self.contents.containsKey((sha,)):
            return "repeated"
        if last is None or months_after(end, last) == self.step:
            return "accepted"
        if self.periods.containsKey((end,)):
            return "occupied"
        return "late" if end < last else "not_contiguous"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = [(None if pd.isna(end) else end, sha) for part in rows for end, sha in zip(part["period_end"], part["sha"], strict=True)]
        out = []
        for end, sha in sorted(found, key=lambda r: (r[0] is not None, r[0] or datetime.date.min, r[1])):
            last = self.last.get()[0] if self.last.exists() else None
            decision = self.decide(end, sha, last)
            if decision == "accepted":
                self.last.update((end,))
                self.periods.updateValue((end,), (sha,))
                self.contents.updateValue((sha,), (end,))
            out.append((key[0], end, sha, decision, last))
        yield pd.DataFrame(out, columns=["company", "period_end", "sha", "decision", "last"])

    def close(self) -> None:
        pass


def gated(filings: DataFrame, step: int = 3) -> DataFrame:
    """filings(company, period_end, sha), a stream -> the same with decision, and the last period that the company had before it."""
    return filings.select("company", "period_end", "sha").groupBy("company").transformWithStateInPandas(Gate(step), DECISIONS, "Append", "None")


def run(spark: SparkSession, path: str, out: str, checkpoint: str, step: int = 3, partitions: int | None = None) -> DataFrame:
    """Decide on what has arrived below ``path`` since the last call with this checkpoint; all decisions so far, with the number of their batch.

    A batch that is run again after a failure replaces what it wrote. ``partitions`` is the number of parts that companies' states are spread over, each a task
    with a store of its own in every batch; the checkpoint's first run fixes it. By default it is the session's number for shuffles.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER}  # keyed state of several variables needs it
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        arrived = spark.readStream.schema("company string, period_end date, sha string").parquet(path)
        gated(arrived, step).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(DECISIONS + ", batch int").option("basePath", out).parquet(out)
