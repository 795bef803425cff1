"""Feeds and sinks of records: indicator CSV, JSON lines, validated ingest, telemetry snapshots, alert sequences, fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.scalars import domain_parts

IOC_CSV = "kind string, value string, category string, confidence string, source string"


def read_iocs(spark: SparkSession, path: str) -> DataFrame:
    """Indicators of CSV files with a header; a missing category is unknown, a missing confidence 0.9, a missing source the file."""
    rows = spark.read.option("header", "true").option("enforceSchema", "false").schema(IOC_CSV).csv(path)
    return rows.select(
        "kind", "value", F.coalesce(F.when(F.trim("category") != "", F.col("category")), F.lit("unknown")).alias("category"),
        F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.9)).alias("confidence"), F.coalesce("source", F.col("_metadata.file_path")).alias("source"),
    )


def write_lines(records: DataFrame, path: str) -> None:
    """One compact JSON object a record, appended; fields without a value are left out."""
    records.write.mode("append").json(path)


def read_lines(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines) of JSON lines."""
    corrupt = "_malformed"
    full = StructType([*schema.fields, StructField(corrupt, StructType.fromDDL("x string")["x"].dataType)])
    parsed = spark.read.text(path).select(F.col("value").alias("__line"), F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{corrupt}").isNotNull()
    return parsed.where(~bad).select(*[F.col(f"r.`{f.name}`") for f in schema.fields]), parsed.where(bad).select(F.col("__line").alias("line"))


def valid_flow() -> Column:
    """Ports of 16 bits, counters that are not negative, both addresses there."""
    port = lambda c: F.col(c).between(0, 65535)
    return F.coalesce(port("src_port") & port("dst_port") & (F.col("bytes_out") >= 0) & (F.col("bytes_in") >= 0) & (F.col("duration_us") >= 0) & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull(), F.lit(False))


def ingest(rows: DataFrame, valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a batch."""
    ok = valid_flow() if valid is None else valid
    return rows.where(ok), rows.where(~ok)


def sequenced(alerts: DataFrame, order: list[str]) -> DataFrame:
    """Alerts with a sequence number from 1 on: ranges of the order get their offsets from the counts of those before."""
    dealt = alerts.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    # Kept, since both uses must see the same ranges.
    numbered = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order))).persist()
    # One row for each partition.
    counts = numbered.groupBy("__part").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(F.broadcast(before.drop("__c")), "__part").withColumn("seq", F.col("__before") + F.col("__n")).drop("__part", "__n", "__before")


def since(sequence: DataFrame, seq: int, ring: int = 2000) -> DataFrame:
    """Alerts after a sequence number, as far as the ring of the last ones still holds them."""
    top = sequence.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__top"))
    return sequence.join(F.broadcast(top)).where((F.col("seq") > seq) & (F.col("seq") > F.col("__top") - ring)).drop("__top")


def by_id(alerts: DataFrame, alert_id) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id).limit(1)


def put_snapshot(spark: SparkSession, row: DataFrame, path: str) -> None:
    """Replace the latest-state file by one JSON object: written beside it, then renamed over it in one step."""
    text = row.select(F.to_json(F.struct("*"))).first()[0]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = beside.getFileSystem(conf).create(beside, True)
    out.write(bytearray((text + "\n").encode()))
    out.hsync()
    out.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(beside, target, rename)


def get_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest readable state; a file that is half written counts for nothing."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.desc("timestamp")).limit(1)


def load_domains(lines: DataFrame, least: int = 7, limit: int | None = None, seed: int = 1) -> DataFrame:
    """(label) of domain lists: the last comma field of (value), lower-case, with a dot and a long enough label; a seeded choice of ``limit``."""
    name = F.lower(F.trim(F.element_at(F.split("value", ","), -1)))
    out = lines.select(name.alias("name")).where(F.col("name").contains(".")).select(domain_parts("name")["sld"].alias("label")).where(F.length("label") >= least)
    return out if limit is None else out.orderBy(F.md5(F.concat(F.lit(str(seed)), "label")), "label").limit(limit)


#: Classes of the mock feed, with cumulative shares in hundredths and severities.
MOCK = ((30, "Botnet C2 Beaconing", "HIGH"), (50, "Port Scan", "MEDIUM"), (65, "DDoS Flood", "CRITICAL"), (80, "DGA Domain", "HIGH"), (90, "DNS Tunneling", "HIGH"), (100, "Data Exfiltration", "CRITICAL"))


def mock_alerts(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """(alert_id, ts_us, threat_class, severity, confidence): a class drawn by weight, all of it a function of the id."""
    draw = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col("id").cast("string")).cast("binary")), 1, 6), 16, 10).cast("long")
    share = draw("class") % 100
    kind, level = F.lit(MOCK[-1][1]), F.lit(MOCK[-1][2])
    for least, name, sev in reversed(MOCK[:-1]):
        kind, level = F.when(share < least, name).otherwise(kind), F.when(share < least, sev).otherwise(level)
    return spark.range(n).select(F.col("id").alias("alert_id"), (F.col("id") * 250_000 + draw("ts") % 250_000).alias("ts_us"), kind.alias("threat_class"), level.alias("severity"), (0.5 + draw("confidence") % 500 / 1000.0).alias("confidence"))


def simulated_flows(spark: SparkSession, hosts: int, seconds: int, beacon_every: int = 60, jitter: float = 0.1, dropped: float = 0.05, seed: int = 3) -> DataFrame:
    """(flow_id, ts_us, src_ip, dst_ip, dst_port, proto, bytes_out, is_beacon): browsing with exponential gaps (as uniform
    times of a Poisson number), time synchronisation, and on every fifth host a beacon with jitter and dropped beats."""
    each = max(1, seconds // 20)
    u = F.rand(seed)
    browse = spark.range(hosts * each).select((F.col("id") / each).cast("long").alias("h"), (u * seconds * 1_000_000).cast("long").alias("ts_us"), (F.rand(seed + 1) * 400).cast("long").alias("d"), F.exp(F.randn(seed + 2) + 7).cast("long").alias("bytes_out"))
    browse = browse.select("h", "ts_us", F.concat(F.lit("93.184."), (F.col("d") % 20).cast("string"), F.lit("."), F.col("d").cast("string")).alias("dst_ip"), F.lit(443).alias("dst_port"), F.lit(6).alias("proto"), "bytes_out", F.lit(False).alias("is_beacon"))
    steps = max(1, seconds // 64)
    ntp = spark.range(hosts * steps).select((F.col("id") / steps).cast("long").alias("h"), ((F.col("id") % steps) * 64_000_000).alias("ts_us"), F.lit("129.6.15.28").alias("dst_ip"), F.lit(123).alias("dst_port"), F.lit(17).alias("proto"), F.lit(76).cast("long").alias("bytes_out"), F.lit(False).alias("is_beacon"))
    n = max(1, seconds // beacon_every)
    beats = spark.range((hosts + 4) // 5 * n).select(((F.col("id") / n).cast("long") * 5).alias("h"), (((F.col("id") % n) + (F.rand(seed + 3) - 0.5) * 2 * jitter) * beacon_every * 1_000_000).cast("long").alias("ts_us"), F.rand(seed + 4).alias("r"))
    beats = beats.where((F.col("r") >= dropped) & (F.col("h") < hosts)).select("h", "ts_us", F.concat(F.lit("203.0.113."), (F.col("h") % 200 + 1).cast("string")).alias("dst_ip"), F.lit(443).alias("dst_port"), F.lit(6).alias("proto"), (F.lit(300) + (F.rand(seed + 5) * 20).cast("long")).alias("bytes_out"), F.lit(True).alias("is_beacon"))
    rows = browse.unionByName(ntp).unionByName(beats)
    return rows.select(F.xxhash64("h", "ts_us", "dst_ip", "bytes_out").alias("flow_id"), "ts_us", F.concat(F.lit("10.0."), (F.col("h") / 250).cast("long").cast("string"), F.lit("."), (F.col("h") % 250 + 1).cast("string")).alias("src_ip"), "dst_ip", "dst_port", "proto", "bytes_out", "is_beacon")
