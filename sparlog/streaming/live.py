"""Structured Streaming over tool events: loop alerts, usage by window, session roll-ups.

Spark's file source reads each file once, so a log that grows has to be rolled
into new files; every new file is picked up by the next batch.
"""

from __future__ import annotations

import os
import uuid
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import logs

LINE_SCHEMA = "value string"
ALERTS = "session_id string, tool_name string, input_hash string, ts timestamp, hits long"
_STATE = "tools array<string>, hashes array<string>, times array<long>, alerted array<string>, last_alerts array<long>"


def stream_lines(spark: SparkSession, root: str, files_a_batch: int = 1000) -> DataFrame:
    """New log lines below ``root`` as a stream (file_path, mtime, block, line) (ST1); ``in_order`` completes each batch."""
    raw = spark.readStream.schema(LINE_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_a_batch).text(root)
    return raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def in_order(batch: DataFrame) -> DataFrame:
    """A batch of ``stream_lines`` in the form of ``logs.read_lines``; streams themselves have no row numbers."""
    return batch.withColumn("ord", F.struct("block", F.monotonically_increasing_id().alias("row"))).drop("block")


def chosen_tools(events: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Events of the tools to watch; a list of tools to include outweighs one to exclude (ST4)."""
    if include:
        return events.where(F.col("tool_name").isin(*include))
    return events.where(~F.col("tool_name").isin(*exclude)) if exclude else events


def stream_loops(events: DataFrame, window_s: int = 60, least: int = 3, debounce_s: int = 30) -> DataFrame:
    """Alerts of a stream (session_id, tool_name, input_hash, ts): ``least`` equal calls within the window (ST2, ST3, ST5).

    State is kept for a session, since each group of a batch costs a call: of
    each of its tools, the calls of the last ``window_s`` seconds and the time
    of the last alert. An alert clears its input's calls;
    within ``debounce_s`` seconds of one, a second for the same session and
    tool is swallowed. Events behind the watermark of two windows are ignored,
    and state ends when the watermark passes it. Rows with a null time or
    session are left out. Calls in a batch are taken in order of time.
    """
    window, debounce = window_s * 1_000_000, debounce_s * 1_000_000
    begins = -(2**62)

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tools, hashes, times, alerted, last_alerts = state.get if state.exists else ([], [], [], [], [])
        calls: defaultdict[str, list] = defaultdict(list)
        for f in frames:
            for tool, t, h in zip(f["tool_name"], f["us"], f["input_hash"], strict=True):
                calls[tool].append((int(t), h))
        before: defaultdict[str, list] = defaultdict(list)
        for tool, t, h in zip(tools, times, hashes, strict=True):
            before[tool].append((t, h))
        lasts = dict(zip(alerted, last_alerts, strict=True))
        behind = state.getCurrentWatermarkMs() * 1000
        out, kept = [], []
        for tool in calls.keys() | before.keys():
            recent: defaultdict[str, deque[int]] = defaultdict(deque)  # of each input, oldest first
            for t, h in sorted(before[tool]):
                recent[h].append(t)
            newest, last = max((t for t, _ in before[tool]), default=begins), lasts.get(tool, begins)
            for t, h in sorted(calls[tool]):
                if t < behind:
                    continue
                own, newest = recent[h], max(newest, t)
                own.append(t)
                while own[0] <= t - window:
                    own.popleft()
                if (hits := len(own)) >= least:
                    own.clear()
                    if t - last >= debounce:
                        out.append((key[0], tool, h, t, hits))
                        lasts[tool] = last = t
            kept += [(tool, t, h) for t, h in sorted((t, h) for h, own in recent.items() for t in own if t > newest - window)]
        state.update(([x for x, _, _ in kept], [h for _, _, h in kept], [t for _, t, _ in kept], list(lasts), list(lasts.values())))
        until = max([t for _, t, _ in kept] + [t + debounce for t in lasts.values()], default=begins) + window
        state.setTimeoutTimestamp(max(until, behind + 1000) // 1000 + 1)
        if out:
            found = pd.DataFrame(out, columns=["session_id", "tool_name", "input_hash", "ts", "hits"])
            found["ts"] = pd.to_datetime(found["ts"], unit="us", utc=True)
            yield found

    rows = events.where("ts is not null and session_id is not null").withWatermark("ts", f"{2 * window_s} seconds").withColumn("us", F.unix_micros("ts"))
    return rows.select("session_id", "tool_name", "input_hash", "ts", "us").groupBy("session_id").applyInPandasWithState(step, ALERTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_usage(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, tool_name, calls) in tumbling windows of a stream or table (session_id, tool_name, ts) (ST7)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), "tool_name").agg(F.count("*").alias("calls")).select(F.col("w.start").alias("start"), "tool_name", "calls")


def bursts(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(session_id, start, end, calls) of runs of calls with no pause of ``gap`` (ST7); a run ends at its last call plus the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("calls")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def roll_up_sessions(lines: DataFrame, where: str, checkpoint: str):
    """Start the job that re-reads the sessions a batch touches and writes snapshot after snapshot below ``where`` (ST6).

    A snapshot is complete: the table before it with the touched files'
    sessions replaced. A batch that is run again after a failure starts from
    the snapshot before it and so gives the same rows.
    """

    def replace(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        new = logs.sessions(logs.parse_events(in_order(batch)))
        out = new if k == 0 else logs.upsert(spark.read.parquet(f"{where}/{k - 1}"), new, "file_path")
        out.write.mode("overwrite").parquet(f"{where}/{k}")

    return lines.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, where: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote below ``where``."""
    out = os.path.join(where, uuid.uuid4().hex)
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{out}/rows")).outputMode("complete").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
