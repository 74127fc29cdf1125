"""Whole files from a stream of their lines: state per file and event-time timers (S-6).

``close_files`` gives each file once, when its last line is in or when it has been silent for a
while; ``open_files`` reads the files that wait in the state of a stopped stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CLOSED = "file_id long, text string, n_lines long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_UNITS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def interval_ms(text: str) -> int:
    """Milliseconds of an interval such as ``30 minutes``."""
    m = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", text)
    if not m:
        raise ValueError(f"not an interval: {text}")
    return int(m[1]) * _UNITS[m[2]]


def joined(lines: list[tuple[int, str]]) -> tuple[str, int]:
    """Text and number of lines; of a line that came twice the greater text counts."""
    by_number = dict(sorted(lines))
    return "\n".join(by_number[n] for n in sorted(by_number)), len(by_number)


class FileCloser(StatefulProcessor):
    """Lines of one file in a list state, a timer for its silence, a mark once it is closed.

    The mark goes when it is ``forget`` ms old, so the state of files long closed takes no room;
    lines that come between close and mark's end don't fire a second event.
    """

    def __init__(self, silence: int, forget: int):
        self.silence, self.forget = silence, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "line_no int, line string")
        self.closed = handle.getValueState("closed", "closed boolean")
        self.last = handle.getValueState("last", "line_no int")

    def _set_timer(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            at = max(at, t)
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def _close(self, key, now: int):
        import pandas as pd
        text, n = joined([(r[0], r[1]) for r in self.lines.get()])
        self.lines.clear()
        self.last.clear()
        self.closed.update((True,))
        self._set_timer(now + self.forget)
        return pd.DataFrame({"file_id": [key[0]], "text": [text], "n_lines": [n]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        newest = None
        for pdf in rows:
            if self.closed.exists():
                continue
            self.lines.appendList([(int(n), x) for n, x in zip(pdf["line_no"], pdf["line"], strict=True)])
            top = int(pdf["ms"].max())
            newest = top if newest is None else max(newest, top)
            marked = pdf.loc[pdf["is_last"], "line_no"]
            if len(marked):
                self.last.update((int(marked.iloc[0]),))
        if newest is None:
            return
        if self.last.exists() and len({r[0] for r in self.lines.get()}) > self.last.get()[0]:
            yield self._close(key, newest)
        else:
            self._set_timer(newest + self.silence)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.closed.exists():
            self.closed.clear()
        else:
            yield self._close(key, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def close_files(lines: DataFrame, silence: str, watermark: str, last_col: str | None = None, forget: str = "7 days") -> DataFrame:
    """``(file_id, text, n_lines)`` of each file once, from a stream of (file_id, line_no, line, ts).

    Needs the RocksDB state store, which is set here for the session's next streams.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    last = F.coalesce(F.col(last_col), F.lit(False)) if last_col else F.lit(False)
    rows = lines.select(F.col("file_id").cast("long").alias("file_id"), F.col("line_no").cast("int").alias("line_no"), "line", "ts",
                        F.unix_millis("ts").alias("ms"), last.alias("is_last"))
    return rows.withWatermark("ts", watermark).groupBy("file_id").transformWithStateInPandas(
        FileCloser(interval_ms(silence), interval_ms(forget)), CLOSED, "append", "eventTime")


def open_files(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Files that still wait in the state a stream has committed."""
    rows = spark.read.format("statestore").option("stateVarName", "lines").load(checkpoint)
    rows = rows.select("key.file_id", "list_element.line_no", "list_element.line")
    once = rows.groupBy("file_id", "line_no").agg(F.max("line").alias("line"))
    grouped = once.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return grouped.select("file_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"),
                          F.size("l").cast("long").alias("n_lines"))
