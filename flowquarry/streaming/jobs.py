"""Structured Streaming forms of the stateful operators; each shares its definition with the batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.alerts import cooldown_fold
from ..sources.feeds import put_snapshot

FLOW = "flow_id long, ts_us long, src_ip string, dst_ip string, bytes_out long"


def flow_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Flow records from Parquet files as they come."""
    return spark.readStream.schema(FLOW).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.timestamp_micros("ts_us"))


def windows(flows: DataFrame, width: str = "1 day", late: str = "0 seconds") -> DataFrame:
    """Tumbling destination windows under a watermark; distinct sources by two chained aggregations."""
    w = flows.withWatermark("ts", late)
    inner = w.groupBy(F.window("ts", width), "dst_ip", "src_ip").agg(F.count("*").alias("n"), F.sum("bytes_out").alias("b"))
    return inner.groupBy(F.window(F.window_time("window"), width), "dst_ip").agg(F.sum("n").alias("pkts"), F.sum("b").alias("bytes"), F.count("*").alias("unique_src"))


def sessions(flows: DataFrame, idle: str = "6 hours", late: str = "0 seconds") -> DataFrame:
    return flows.withWatermark("ts", late).groupBy(F.session_window("ts", idle), "src_ip").agg(F.count("*").alias("records"))


def cooldown_stream(alerts: DataFrame, us: int, rise: float) -> DataFrame:
    """Alerts (src_ip, ts_us, confidence) left by the cooldown; state is the last emitted one of a source, kept for its cooldown."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts_us")
        last = [state.get] if state.exists else []
        times = [x[0] for x in last] + rows.ts_us.tolist()
        scores = [x[1] for x in last] + rows.confidence.tolist()
        keep = cooldown_fold(times, scores, us, rise)[len(last) :]
        out = rows[keep]
        if len(out):
            state.update((int(out.ts_us.iloc[-1]), float(out.confidence.iloc[-1])))
        if state.exists:
            state.setTimeoutTimestamp(max((state.get[0] + us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield out[["src_ip", "ts_us", "confidence"]]

    return alerts.groupBy("src_ip").applyInPandasWithState(step, "src_ip string, ts_us long, confidence double", "ts_us long, confidence double", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is there in append mode and stop."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tail_lines(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """JSON lines as they are appended in files: the record's columns, null for a malformed line, and ``malformed``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    full = StructType([*schema.fields, StructField("_malformed", StringType())])
    r = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    bad = F.col("r").isNull() | F.col("r._malformed").isNotNull()
    return lines.select(r.alias("r")).select(*[F.when(~bad, F.col(f"r.`{f.name}`")).alias(f.name) for f in schema.fields], bad.alias("malformed"))


def recent_hits(alerts: DataFrame, hits: DataFrame, ttl: str = "60 seconds", late: str = "0 seconds") -> DataFrame:
    """Stream-stream join of alerts (alert_id, ts, src_ip, dst_ip) with hits (hit_id, ts, key) not older than ``ttl``; the
    watermarks let the state of both sides expire. ``p`` ranks the key: pair, destination, source."""
    keys = F.array(F.struct(F.lit(0).alias("p"), F.concat_ws(">", "src_ip", "dst_ip").alias("key")), F.struct(F.lit(1).alias("p"), F.col("dst_ip").alias("key")), F.struct(F.lit(2).alias("p"), F.col("src_ip").alias("key")))
    a = alerts.withWatermark("ts", late).select("alert_id", F.col("ts").alias("a_ts"), F.explode(keys).alias("k")).select("alert_id", "a_ts", "k.p", F.col("k.key").alias("a_key"))
    h = hits.withWatermark("ts", late).select("hit_id", F.col("ts").alias("h_ts"), F.col("key").alias("h_key"))
    return a.join(h, F.expr(f"a_key = h_key AND h_ts <= a_ts AND a_ts < h_ts + interval {ttl}")).select("alert_id", "p", F.col("a_key").alias("key"), "hit_id", "a_ts", "h_ts")


def persistence_stream(rows: DataFrame, decay: float = 0.35) -> DataFrame:
    """(key, persistence, streak) after each batch of (key, ts_us, hit): the exponential persistence with its state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, k = state.get if state.exists else (0.0, 0)
        for hit in pd.concat(list(frames)).sort_values("ts_us")["hit"]:
            k = k + 1 if hit else max(0, k - 1)
            s = s * decay + (min(1.0, k / 3) if hit else 0.0) * (1 - decay)
        state.update((s, k))
        yield pd.DataFrame({"key": [key[0]], "persistence": [s], "streak": [k]})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, persistence double, streak int", "s double, k int", "update", GroupStateTimeout.NoTimeout)


def forward(df: DataFrame, send: Callable[[list[dict]], None], checkpoint: str, most: int = 10_000) -> dict[str, int]:
    """Hand each batch's rows to ``send`` in portions, off the path of everything else: a portion that fails is counted, not tried again."""
    counts = {"sent": 0, "failed": 0}

    def push(batch: DataFrame, _: int) -> None:
        portion: list[dict] = []

        def out() -> None:
            try:
                send(portion)
                counts["sent"] += len(portion)
            except Exception:  # whatever a sender raises is a failed delivery
                counts["failed"] += len(portion)

        for row in batch.toLocalIterator():
            portion.append(row.asDict(recursive=True))
            if len(portion) >= most:
                out()
                portion = []
        if portion:
            out()

    df.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return counts


def snapshots(df: DataFrame, path: str, checkpoint: str) -> None:
    """Replace the latest-state file after every batch by the batch's newest row (by ``timestamp``)."""

    def put(batch: DataFrame, _: int) -> None:
        newest = batch.orderBy(F.desc("timestamp")).limit(1)
        if not newest.isEmpty():
            put_snapshot(batch.sparkSession, newest, path)

    df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
