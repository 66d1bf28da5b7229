"""Streaming forms of batch findings (X1-X3). The same functions take a streaming or a batch DataFrame where Spark allows it.

X1 and X2 keep their state in typed variables of the state store (transformWithStateInPandas on RocksDB, which lies on disk): a key's rows
of a batch are read slice by slice, and what must outlast a slice is a value, a list or a timer of the store."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALERT = "entity long, test string, ts timestamp, kind string, rule string"
OUTCOME = "conv_id long, turns int, complaint string, ended string"
TURN = "conv_id long, turn int, role string, text string, ended string"
#: Fixed value: the state store whose keys and lists lie on disk, which typed state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Turns that are taken from the store at a time.
KEPT_ROWS = 10_000


class Alerts(StatefulProcessor):
    """X1 for one series: the state is its last time and value."""

    def __init__(self, low: float, high: float, per_day: float):
        self.low, self.high, self.per_day = low, high, per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import numpy as np
        import pandas as pd

        times, values = [], []
        for slice_ in rows:  # of a slice 16 bytes a row stay: time and value
            times.append(slice_["ts"].to_numpy("datetime64[us]").astype(np.int64))
            values.append(slice_["value"].to_numpy(float))
        ts, value = np.concatenate(times), np.concatenate(values)
        order = np.argsort(ts, kind="stable")
        ts, value = ts[order], value[order]
        known = self.last.exists()
        before_ts, before = self.last.get() if known else (int(ts[0]), float("nan"))
        days = np.maximum(1, np.diff(ts, prepend=before_ts) // 86_400_000_000)
        rate = np.diff(value, prepend=before) / days
        if not known:
            rate[0] = np.nan
        self.last.update((int(ts[-1]), float(value[-1])))
        kinds = np.where(value < self.low, "Low", np.where(value > self.high, "High", "")), np.where(np.abs(rate) >= self.per_day, np.where(rate > 0, "High", "Low"), "")
        for kind, rule in zip(kinds, ("bounds", "rate")):
            hit = kind != ""
            if hit.any():
                yield pd.DataFrame({"entity": key[0], "test": key[1], "ts": pd.to_datetime(ts[hit], unit="us"), "kind": kind[hit], "rule": rule})

    def close(self) -> None:
        pass


def critical_alerts(df: DataFrame, low: float, high: float, per_day: float, late: str = "1 hour") -> DataFrame:
    """Alerts for values beyond bounds and for changes per day of per_day or more since the
    series' last value. Rows later than the watermark are dropped. A batch's rows of one series are put in time order and compared with
    their neighbours at once; the source bounds the batch (maxFilesPerTrigger)."""
    timed = df.select("entity", "test", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", late)
    return timed.groupBy("entity", "test").transformWithStateInPandas(statefulProcessor=Alerts(low, high, per_day), outputStructType=ALERT, outputMode="append", timeMode="EventTime")


class Outcomes(StatefulProcessor):
    """X2 for one conversation: its turns as a list of the store, how many there are and the first complaint as a value, its end as a timer."""

    def __init__(self, stop: tuple[str, ...], timeout_ms: int, turns: bool):
        self.stop, self.timeout_ms, self.turns = stop, timeout_ms, turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("turns", "turn int, role string, text string")
        self.seen = handle.getValueState("seen", "turns int, complaint_turn int, complaint string, last_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        turns, first, complaint, last = self.seen.get() if self.seen.exists() else (0, None, None, 0)
        ended = False
        for slice_ in rows:
            said = slice_["text"].fillna("").str.strip()
            spoke = (slice_["role"] == "user") & (said != "")
            turns += len(slice_)
            last = max(last, int(slice_["ts"].max().timestamp() * 1000))
            if spoke.any():
                at = slice_["turn"][spoke].idxmin()
                if first is None or slice_["turn"][at] < first:
                    first, complaint = int(slice_["turn"][at]), said[at]
                ended = ended or bool(said[spoke].str.lower().str.rstrip(".!").isin(self.stop).any())
            if self.turns:
                self.kept.appendList([(int(t), r, x) for t, r, x in zip(slice_["turn"], slice_["role"], slice_["text"])])
        self.seen.update((turns, first, complaint, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ended:
            yield from self.end(key, "stop")
        else:
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        yield from self.end(key, "timeout")

    def end(self, key, how: str) -> Iterator:
        import pandas as pd

        if self.turns:
            some: list = []
            for turn in self.kept.get():
                some.append((key[0], *turn, how))
                if len(some) == KEPT_ROWS:
                    yield pd.DataFrame(some, columns=["conv_id", "turn", "role", "text", "ended"])
                    some = []
            if some:
                yield pd.DataFrame(some, columns=["conv_id", "turn", "role", "text", "ended"])
        else:
            turns, _, complaint, _ = self.seen.get()
            yield pd.DataFrame([(key[0], turns, complaint, how)], columns=["conv_id", "turns", "complaint", "ended"])
        self.kept.clear()
        self.seen.clear()

    def close(self) -> None:
        pass


def conversation_outcomes(df: DataFrame, stop: tuple[str, ...], late: str = "10 minutes", timeout_ms: int = 3_600_000, turns: bool = False) -> DataFrame:
    """When a user turn is a stop phrase, or when event time passes timeout_ms beyond the last turn, an outcome row: count of turns, first complaint (of the least turn), how it ended. With
    turns, instead a row for each turn that the conversation had, whatever batch brought it."""
    timed = df.select("conv_id", "turn", "role", "text", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=Outcomes(stop, timeout_ms, turns), outputStructType=TURN if turns else OUTCOME, outputMode="append", timeMode="EventTime")


def tumbling_means(df: DataFrame, width: str = "30 days", late: str = "1 day") -> DataFrame:
    """Means of tumbling windows per series; a window is emitted once the watermark has passed it (append mode)."""
    timed = df.select("entity", "test", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", late)
    g = timed.groupBy("entity", "test", F.window("ts", width)).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return g.select("entity", "test", F.col("window.start").cast("timestamp_ntz").alias("start"), "mean", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drive a stream over what its source has now, into parquet files."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination())
