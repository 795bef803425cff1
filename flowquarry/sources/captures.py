"""Captures as fixtures and as records: frames by rule, the parser's report, hellos put together from segments."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ACK, PSH, ja3, ja4
from ..operators.records import hello_bytes
from . import pcap
from .pcap import labelled, read_packets

__all__ = ["labelled", "read_packets", "write_fixture", "mixed_frames", "hello_frames", "report", "hellos"]


def capture_bytes(rows: list[tuple[int, bytes]], link: int = 1) -> bytes:
    """A little-endian microsecond capture."""
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    return head + b"".join(struct.pack("<IIII", ts // 10**6, ts % 10**6, len(f), len(f)) + f for ts, f in rows)


def write_fixture(spark: SparkSession, path: str, by_link: dict[int, list[tuple[int, bytes]]], kind: str = "benign") -> str:
    """A capture file for each link type, on any file system Spark reaches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for link, rows in by_link.items():
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/link{link}.pcap")
        out = p.getFileSystem(conf).create(p, True)
        out.write(bytearray(capture_bytes(rows, link)))
        out.close()
    return path


def mixed_frames(n: int) -> dict[int, list[tuple[int, bytes]]]:
    """n frames over Ethernet, raw IP, cooked and loopback links: DNS queries, TCP segments, cut headers, broken frames."""
    out: dict[int, list[tuple[int, bytes]]] = {1: [], 101: [], 113: [], 0: []}
    for i in range(n):
        kind = i % 10
        if kind < 4:
            frame = pcap.udp_frame("10.0.0.1", "8.8.8.8", 4000 + i, 53, pcap.dns_query(f"h{i}.example.org", 16 if i % 3 == 0 else 1))
        elif kind == 8:  # eight bytes of a TCP header: a packet without ports
            frame = pcap._frame("10.0.0.2", "1.2.3.4", 6, b"\x01\xbb\x01\xbb\0\0\0\0")
        elif kind == 9:
            frame = b"\0" * 12 + (b"\x08\x06" if i % 20 == 9 else b"\x08\x00") + b"\x45"
        else:
            frame = pcap.tcp_frame("10.0.0.3" if i % 2 else "10.0.0.4", "1.2.3.4", 5000 + i, 443, ACK | PSH, b"x" * (i % 50))
        link = (1, 101, 113, 0)[i // 10 % 4]
        if link == 101:
            frame = frame[14:]
        elif link == 113:
            frame = b"\0" * 14 + frame[12:]
        elif link == 0:
            frame = b"\x02\0\0\0" + frame[14:]
        out[link].append((1_700_000_000_000_000 + i * 1000, frame))
    return out


def hello_frames(n: int) -> dict[int, list[tuple[int, bytes]]]:
    """n flows with a ClientHello in three segments (later flows' segments between them); of every fifth the last is missing."""
    rows = []
    for i in range(n):
        data = pcap.hello(771, [4865 + i % 3, 49195], f"site{i % 7}.example.com", [29, 23], [0])
        cuts = (data[:7], data[7:60], data[60:])
        for j, part in enumerate(cuts[: 2 if i % 5 == 4 else 3]):
            rows.append((1_700_000_000_000_000 + j * 1_000_000 + i * 10, pcap.tcp_frame(f"10.0.0.{i + 1}", "1.2.3.4", 40000 + i, 443, ACK | PSH, part)))
    return {1: sorted(rows, key=lambda r: (r[0] % 7, r[0]))}


def report(packets: DataFrame) -> DataFrame:
    """(record, packets, bytes): what the parser met; frames it could not read are skipped."""
    kind = F.when(F.col("proto").isNull(), "skipped").when(F.col("dns_name").isNotNull(), "dns").when(F.col("proto") == 6, "tcp").when(F.col("proto") == 17, "udp").otherwise("other")
    return packets.groupBy(kind.alias("record")).agg(F.count("*").alias("packets"), F.coalesce(F.sum("ip_len"), F.lit(0)).cast("long").alias("bytes"))


HELLO = "version int, ciphers array<int>, extensions array<int>, curves array<int>, formats array<int>, signatures array<int>, sni string, alpn string, max_version int"


def hellos(packets: DataFrame) -> DataFrame:
    """Decoded hellos of the directional TCP flows of a capture, with both fingerprints; incomplete or other data gives no row."""
    key = ["src_ip", "src_port", "dst_ip", "dst_port"]
    data = hello_bytes(packets.withColumn("packet_id", F.xxhash64("path", "ts_us", "payload")), key)

    @F.pandas_udf(f"struct<{HELLO.replace(' array', ': array').replace(' int', ': int').replace(' string', ': string')}>")
    def decode(col: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in HELLO.split(", ")]
        found = [pcap.client_hello(bytes(x)) for x in col]
        return pd.DataFrame([[h[k] for k in names] if isinstance(h, dict) else [None] * len(names) for h in found], columns=names)

    h = data.withColumn("h", decode("data")).where("h.version is not null").select(*key, "h.*")
    version = F.coalesce("max_version", "version")
    return h.select(*key, "sni", "alpn", "version", ja3("version", "ciphers", "extensions", "curves", "formats")["md5"].alias("ja3"), ja4(version, "ciphers", "extensions", F.coalesce("signatures", F.array().cast("array<int>")), F.coalesce("alpn", F.lit("")), F.col("sni").isNotNull()).alias("ja4"))
