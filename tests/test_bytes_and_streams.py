"""Captures, fingerprints, folds and streams: unit vectors and batch equality."""

import ipaddress
import random

import numpy as np
from pyspark.sql import functions as F

from flowquarry.detectors import dga
from flowquarry.detectors.ddos import fold as ddos_fold
from flowquarry.functions import scalars as S
from flowquarry.operators import joins
from flowquarry.operators.alerts import cooldown_fold
from flowquarry.operators.flows import fold_sessions
from flowquarry.operators.history import lomb_scargle
from flowquarry.plans import adapters as A
from flowquarry.plans import all_queries
from flowquarry.sources import feeds, pcap
from flowquarry.streaming import jobs


def test_capture_round_trip(spark, tmp_path):
    rows = [
        (1_000_001, pcap.udp_frame("10.0.0.1", "8.8.8.8", 4000, 53, pcap.dns_query("a.Example.com", 16))),
        (2_000_000, pcap.tcp_frame("10.0.0.1", "1.2.3.4", 4001, 443, S.SYN)),
        (3_000_000, pcap.tcp_frame("fd00::1", "2001:db8::2", 4002, 443, S.ACK | S.PSH, b"hello")),
        (4_000_000, b"short"),
        (5_000_000, b"\0" * 12 + b"\x81\x00\x00\x05" + pcap.tcp_frame("10.0.0.9", "1.2.3.4", 1, 2, S.RST)[12:]),
    ]
    (tmp_path / "malware").mkdir()
    pcap.write_pcap(str(tmp_path / "malware" / "x1.pcap"), rows)
    got = pcap.labelled(pcap.read_packets(spark, f"file://{tmp_path}")).orderBy("ts_us").collect()
    assert [r.proto for r in got] == [17, 6, 6, None, 6]
    assert (got[0].dns_name, got[0].dns_qtype, got[0].dns_response) == ("a.example.com", 16, False)
    assert got[1].flags == S.SYN and got[2].src_ip == "fd00::1" and bytes(got[2].payload) == b"hello" and got[2].payload_len == 5
    assert got[4].src_ip == "10.0.0.9" and {r.capture_id for r in got} == {"x1"} and {r.label for r in got} == {1}
    twice = pcap.replayed(pcap.read_packets(spark, f"file://{tmp_path}"), 2).agg(F.min("ts_us"), F.max("ts_us"), F.count("*")).first()
    assert tuple(twice) == (1_000_001, 5_000_000 + 3_999_999 + 1_000_000, 10)


def test_client_hello_and_published_fingerprint(spark):
    ciphers = [47, 53, 5, 10, 49161, 49162, 49171, 49172, 50, 56, 19, 4]
    data = pcap.hello(769, ciphers, "example.com", [23, 24, 25], [0])
    h = pcap.client_hello(data)
    assert h["ciphers"] == ciphers and h["sni"] == "example.com" and h["extensions"] == [0, 10, 11]
    assert pcap.client_hello(data[:40]) == "more" and pcap.client_hello(b"GET /") is None
    row = spark.createDataFrame([(h["version"], h["ciphers"], h["extensions"], h["curves"], h["formats"])], "v int, c array<int>, e array<int>, g array<int>, f array<int>")
    assert row.select(S.ja3("v", "c", "e", "g", "f")["md5"]).first()[0] == "ada70206e40642a3e4461f35503241d5"


def test_session_reasons():
    s = 1_000_000
    fold = lambda t, f: [x[3] for x in fold_sessions([i * s for i in t], f, 15 * s, 120 * s, 2 * s)]
    assert fold([0, 1, 20], [16, 16, 16]) == ["idle", "flush"]
    assert fold(range(0, 140, 10), [16] * 14) == ["active", "flush"]
    assert fold([0, 1, 1.5], [2, 4, 2]) == ["reuse", "flush"]
    assert fold([0, 1, 5], [17, 17, 16]) == ["closed", "flush"]


def test_folds():
    assert cooldown_fold([0, 10, 20, 400], [0.6, 0.6, 0.75, 0.6], 300, 0.1) == [True, False, True, True]
    quiet = [(1000.0, 1.0, 0.0, 0.0, 0.0, 0.0)] * 5
    flood = [(25000.0, 1.0, 1.0, 1.0, 0.0, 0.0)] * 4
    out = ddos_fold(quiet + flood)
    assert all(r["detected"] == 0 for r in out[:5]) and {r["attack_class"] for r in out[5:]} == {"SYN_FLOOD"}
    assert out[-1]["persistence"] >= 0.7 and out[5]["severity"] != "CRITICAL"


def test_periodicity_tells_beacons_from_noise():
    rnd = random.Random(4)
    beacon = np.cumsum([30 + rnd.uniform(-1.5, 1.5) for _ in range(60)])
    noise = np.cumsum([rnd.expovariate(1 / 30) for _ in range(60)])
    a, b = lomb_scargle(beacon), lomb_scargle(noise)
    assert a[0] > 1.5 * b[0] and abs(a[1] - 30) < 1.5 and lomb_scargle(beacon[:5])[:3] == (0.0, 0.0, 0.0)


def test_streams_equal_batch(spark, sf):
    queries, _ = all_queries()
    day = 86_400_000_000
    batch = A.flows(spark, sf).groupBy(F.expr(f"ts_us div {day}").alias("b"), "dst_ip").agg(F.count("*").alias("pkts"), F.countDistinct("src_ip").alias("u"))
    want = {(r.b * 86400, r.dst_ip): (r.pkts, r.u) for r in batch.collect()}
    got = {(r.start_s, r.dst_ip): (r.pkts, r.unique_src) for r in queries["stream_window_available_now"](spark, sf).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    closed = max(k[0] for k in want)
    assert all(k in got for k in want if k[0] < closed)
    idle = queries["flow_sessions_idle"](spark, sf)
    want = sorted((r.src_ip, r.records) for r in queries["stream_sessions"](spark, sf).collect())
    have = sorted((r.src_ip, r.records) for r in idle.collect())
    assert want and all(x in have for x in want)
    assert queries["stream_cooldown"](spark, sf).count() > 0


def test_forwarding_snapshots_and_state(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    for lo in (0, 50):
        spark.range(lo, lo + 50, 1, 1).select(F.col("id").alias("flow_id"), (F.col("id") * 1000).alias("ts_us"), F.lit("a").alias("src_ip"), F.lit("b").alias("dst_ip"), F.lit(1).cast("long").alias("bytes_out")).write.mode("append").parquet(src)
    sent = []

    def send(rows):
        if any(r["flow_id"] == 60 for r in rows):
            raise OSError("down")
        sent.extend(rows)

    counts = jobs.forward(jobs.flow_stream(spark, src).select("flow_id", "src_ip"), send, f"file://{tmp_path}/c1", most=20)
    assert counts["sent"] == len(sent) and counts["sent"] + counts["failed"] == 100 and 0 < counts["failed"] <= 20
    jobs.snapshots(jobs.flow_stream(spark, src).select(F.col("flow_id").alias("timestamp"), "src_ip"), f"file://{tmp_path}/state/now.json", f"file://{tmp_path}/c2")
    assert feeds.get_snapshot(spark, f"file://{tmp_path}/state", "timestamp long, src_ip string").collect() in ([(49, "a")], [(99, "a")])
    q = jobs.persistence_stream(jobs.flow_stream(spark, src, 100).select(F.col("src_ip").alias("key"), "ts_us", (F.col("flow_id") % 4 > 0).alias("hit"))).writeStream.outputMode("update").format("memory").queryName("held").option("checkpointLocation", f"file://{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination()
    s, k = 0.0, 0
    for i in range(100):
        k = k + 1 if i % 4 else max(0, k - 1)
        s = s * 0.35 + (min(1.0, k / 3) if i % 4 else 0.0) * 0.65
    got = spark.table("held").collect()[-1]
    assert abs(got.persistence - s) < 1e-9 and got.streak == k


def test_cut_headers_root_names_and_times(spark):
    cut = pcap._frame("10.0.0.2", "1.2.3.4", 6, b"\x01\xbb\x01\xbb\0\0")
    assert (p := pcap.parse(1, cut)) and (p["src_port"], p["dst_port"], p["proto"], p["payload_len"]) == (0, 0, 6, 0)
    root = pcap.parse(1, pcap.udp_frame("10.0.0.1", "8.8.8.8", 4000, 53, b"\0\1\1\0\0\1\0\0\0\0\0\0" + b"\0\0\2\0\1"))
    assert (root["dns_name"], root["dns_qtype"]) == ("", 2)
    times = spark.createDataFrame([("1700000000.25",), ("2023-11-14T22:13:20.250Z",), ("2023-11-15T00:13:20.25+02:00",), ("2023-11-14T22:13:20.25",), ("soon",), (None,)], "v string")
    got = [r[0] for r in times.select(S.event_micros("v")).collect()]
    assert got == [1_700_000_000_250_000] * 4 + [None, None]
    assert times.select(S.iso_millis(S.event_micros("v"))).first()[0] == "2023-11-14T22:13:20.250Z"


def test_domain_scores_in_model_mode(spark):
    p = spark.createDataFrame([(0.0,), (0.2,), (0.4,), (0.7,), (1.0,)], "p double")
    got = [r[0] for r in p.select(dga.model_score(F.col("p"), 0.4)).collect()]
    assert np.allclose(got, [0, 0.25, 0.5, 0.75, 1.0], atol=1e-6)


def test_published_hello_fingerprint(spark):
    ciphers = [0x1301, 0x1302, 0x1303, 0xC02B, 0xC02F, 0xC02C, 0xC030, 0xCCA9, 0xCCA8, 0xC013, 0xC014, 0x9C, 0x9D, 0x2F, 0x35]
    extensions = [0, 0x17, 0xFF01, 0xA, 0xB, 0x23, 0x10, 5, 0xD, 0x12, 0x33, 0x2D, 0x2B, 0x1B, 0x4469, 0x15]
    signatures = [0x403, 0x804, 0x401, 0x503, 0x805, 0x501, 0x806, 0x601]
    row = spark.createDataFrame([(0x304, [0x2A2A, *ciphers], [0x3A3A, *extensions], signatures)], "v int, c array<int>, e array<int>, s array<int>")
    assert row.select(S.ja4("v", "c", "e", "s", F.lit("h2"), F.lit(True))).first()[0] == "t13d1516h2_8daaf6152771_e5627efa2ab1"


def test_command_line(spark, sf, tmp_path):
    from flowquarry.__main__ import main
    from flowquarry.sources import captures

    assert main(["list"]) == 0
    assert main(["run", "flag_counts", "--data", sf, "--out", f"file://{tmp_path}/q"]) == 0 and spark.read.parquet(f"file://{tmp_path}/q").count() > 0
    captures.write_fixture(spark, f"file://{tmp_path}/caps", captures.mixed_frames(50))
    assert main(["parse", f"file://{tmp_path}/caps", "--out", f"file://{tmp_path}/parsed"]) == 0
    report = {r.record: r.packets for r in spark.read.json(f"file://{tmp_path}/parsed/report").collect()}
    assert report == {"dns": 20, "tcp": 25, "skipped": 5} and spark.read.json(f"file://{tmp_path}/parsed/records").count() == 45
    (tmp_path / "a.csv").write_text("kind,value,category,confidence,source\nip, 1.2.3.4 ,,,\nurl,x,,,\ndomain,Evil.ORG,c2,0.5,list\n")
    assert main(["import-iocs", f"file://{tmp_path}/a.csv", "--out", f"file://{tmp_path}/iocs"]) == 0
    iocs = spark.read.parquet(f"file://{tmp_path}/iocs")
    assert {(r.kind, r.value, r.category, r.confidence) for r in iocs.collect()} == {("ip", "1.2.3.4", "unknown", 0.9), ("domain", "evil.org", "c2", 0.5)}
    assert joins.point_lookup(iocs, "domain", " EVIL.org").count() == 1 and joins.point_lookup(iocs, "ip", "4.3.2.1").count() == 0


def test_periodogram_equals_least_squares():
    rnd = random.Random(9)
    t = np.cumsum([20 + rnd.uniform(-4, 4) for _ in range(30)])
    power, period, snr, n = lomb_scargle(t, freqs=64)
    t = t - t[0]
    dt = max(float(np.median(np.diff(t))) / 4, t[-1] / 4096)
    y = np.bincount((t / dt).astype(int), minlength=int(t[-1] / dt) + 1).astype(float)
    y -= y.mean()
    at, best = (np.arange(len(y)) + 0.5) * dt, []
    for f in np.geomspace(2 / t[-1], 1 / (2 * dt), 64):
        x = np.stack([np.cos(2 * np.pi * f * at), np.sin(2 * np.pi * f * at)], axis=1)
        fit = x @ np.linalg.lstsq(x, y, rcond=None)[0]
        best.append(1 - ((y - fit) ** 2).sum() / (y @ y))
    assert n == 30 and abs(power - max(best)) < 1e-6 and abs(snr - max(best) / np.median(best)) < 1e-3


def test_private_addresses_equal_the_standard_library(spark):
    v6 = ["::1", "::", "::2", "::ffff:8.8.8.8", "64:ff9b:1::5", "64:ff9b::5", "100::7", "2001::9", "2001:1ff::1", "2001:200::1", "2001:db8::1", "2001:4860::8888", "2001:3::1", "2001:4:112::1", "2001:20::5", "2002::1", "2a00:1450::1", "fc00::1", "fdff::1", "fe80::1", "febf::1", "fec0::1", "ff02::1"]
    v4 = ["10.0.0.1", "8.8.8.8", "172.31.0.1", "172.32.0.1", "192.0.2.1", "198.19.1.1", "198.20.1.1", "203.0.113.5", "240.0.0.1", "169.254.1.1", "127.0.0.1", "0.0.0.1"]
    rows = spark.createDataFrame([(x,) for x in [*v6, *v4, "x", "", "1.2.3", ":::x", None]], "ip string").select("ip", S.is_private("ip").alias("p")).collect()
    for r in rows:
        want = ipaddress.ip_address(r.ip).is_private if r.ip in v6 + v4 else False
        if r.ip != "::ffff:8.8.8.8":  # whether a mapped address counts as itself differs by version
            assert r.p == want, r
