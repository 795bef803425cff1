"""Capture and streaming queries; they need files or state, so they have no oracle and are tested against batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..streaming import jobs
from . import adapters as A
from .registry import query


def _scratch(spark: SparkSession) -> str:
    """A folder all executors share: below spark.checkpoint.dir, or the warehouse; a temporary one only where the executors are the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='flowquarry-')}"
    return f"{base.rstrip('/')}/flowquarry/{uuid.uuid4().hex}"


def _flow_files(spark: SparkSession, sf: str) -> str:
    path = _scratch(spark)
    A.flows(spark, sf).select("flow_id", "ts_us", "src_ip", "dst_ip", "bytes_out").repartitionByRange(3, "ts_us").write.parquet(path)
    return path


@query("STR-01", "STR-02", "STR-15", "SRC-05", sql=A.oracle("""SELECT ts_us // 86400000000 * 86400 AS start_s, dst_ip, count(*) AS pkts, CAST(sum(bytes_out) AS BIGINT) AS bytes, count(DISTINCT src_ip) AS unique_src FROM flows
WHERE ts_us // 86400000000 < (SELECT max(ts_us // 86400000000) FROM flows) GROUP BY ALL""", "flows"))
def stream_window_available_now(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that the watermark has closed when the input ends; files may come in any order, so the delay covers the span."""
    out = _scratch(spark)
    jobs.run_once(jobs.windows(jobs.flow_stream(spark, _flow_files(spark, sf), 100)), out, _scratch(spark))
    return spark.read.parquet(out).select(F.col("window.start").cast("long").alias("start_s"), "dst_ip", "pkts", "bytes", "unique_src")


@query("STR-04", "STR-17", sql=A.oracle("""
, n AS (SELECT src_ip, ts_us, flow_id, CASE WHEN coalesce(ts_us - lag(ts_us) OVER w, 21600000001) > 21600000000 THEN 1 ELSE 0 END AS new FROM flows WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us, flow_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY src_ip ORDER BY ts_us, flow_id ROWS UNBOUNDED PRECEDING) AS session FROM n), g AS (SELECT src_ip, session, min(ts_us) AS a, max(ts_us) AS b, count(*) AS records FROM s GROUP BY ALL)
SELECT round(a / 1e6, 6) AS start_s, src_ip, records FROM g WHERE b // 1000 + 21600000 <= (SELECT max(ts_us) // 1000 FROM flows)""", "flows"))
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = _scratch(spark)
    jobs.run_once(jobs.sessions(jobs.flow_stream(spark, _flow_files(spark, sf), 100)), out, _scratch(spark))
    return spark.read.parquet(out).select(F.round(F.col("session_window.start").cast("double"), 6).alias("start_s"), "src_ip", "records")


@query("SET-02", "STR-09", sql=A.oracle("""
, a AS (SELECT flow_id, src_ip, ts_us, bytes_out / 50000e0 AS conf FROM flows WHERE bytes_out > 5000), q AS (SELECT *, list({'t': ts_us, 'c': conf, 'id': flow_id}) OVER (PARTITION BY src_ip ORDER BY ts_us, flow_id ROWS UNBOUNDED PRECEDING) AS l FROM a)
SELECT src_ip, ts_us, round(conf, 6) AS confidence FROM q WHERE list_reduce(l, lambda a, x: CASE WHEN x.t - a.t >= 86400000000 OR x.c >= a.c + 0.1e0 THEN x ELSE a END).id = flow_id""", "flows"))
def stream_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    out = _scratch(spark)
    alerts = jobs.flow_stream(spark, _flow_files(spark, sf), 100).withWatermark("ts", "0 seconds").withColumn("confidence", F.col("bytes_out") / 50000.0).where("bytes_out > 5000")
    jobs.run_once(jobs.cooldown_stream(alerts, 86_400_000_000, 0.1), out, _scratch(spark))
    return spark.read.parquet(out).withColumn("confidence", F.round("confidence", 6))


@query("SNK-05", sql=A.oracle("SELECT count(*) FILTER (flow_id % 10 > 0) AS sent, count(*) FILTER (flow_id % 10 = 0) AS failed FROM flows", "flows"))
def stream_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Every alert forwarded by itself to a receiver that refuses every tenth."""

    def send(rows: list[dict]) -> None:
        if any(r["flow_id"] % 10 == 0 for r in rows):
            raise ConnectionError("refused")

    counts = jobs.forward(jobs.flow_stream(spark, _flow_files(spark, sf), 100).select("flow_id", "src_ip"), send, _scratch(spark), most=1)
    return spark.createDataFrame([(counts["sent"], counts["failed"])], "sent long, failed long")


@query("SRC-08", "STR-15", sql=A.oracle("SELECT CASE WHEN flow_id % 17 = 0 THEN 'malformed' ELSE src_ip END AS who, count(*) AS n FROM flows GROUP BY ALL", "flows"))
def stream_json_tail(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines followed as a stream, every seventeenth line cut off."""
    path, out = _scratch(spark), _scratch(spark)
    line = F.to_json(F.struct("flow_id", "src_ip"))
    A.flows(spark, sf).select(F.when(F.col("flow_id") % 17 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).repartition(3).write.text(path)
    jobs.run_once(jobs.tail_lines(spark, path, StructType.fromDDL("flow_id long, src_ip string")), out, _scratch(spark))
    return spark.read.parquet(out).groupBy(F.when(F.col("malformed"), "malformed").otherwise(F.col("src_ip")).alias("who")).agg(F.count("*").alias("n"))


@query("STR-14", "JOIN-07", sql=A.oracle("""
, a AS (SELECT flow_id, ts_us, unnest([0, 1, 2]) AS p, unnest([concat(src_ip, '>', dst_ip), dst_ip, src_ip]) AS key FROM flows WHERE flow_id % 5 = 0), h AS (SELECT flow_id AS hit_id, ts_us AS h_us, CASE WHEN flow_id % 3 = 1 THEN dst_ip ELSE src_ip END AS key FROM flows WHERE flow_id % 4 = 1)
SELECT a.flow_id AS alert_id, p, hit_id FROM a JOIN h ON a.key = h.key AND h_us <= ts_us AND ts_us < h_us + 86400000000""", "flows"))
def stream_recent_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts and hits as two streams, joined within a day."""
    path, out = _flow_files(spark, sf), _scratch(spark)
    f = lambda: jobs.flow_stream(spark, path, 100)
    alerts = f().where("flow_id % 5 = 0").select(F.col("flow_id").alias("alert_id"), "ts", "src_ip", "dst_ip")
    hits = f().where("flow_id % 4 = 1").select(F.col("flow_id").alias("hit_id"), "ts", F.when(F.col("flow_id") % 3 == 1, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("key"))
    jobs.run_once(jobs.recent_hits(alerts, hits, "1 day", "40 days"), out, _scratch(spark))
    return spark.read.parquet(out).select("alert_id", "p", "hit_id")
