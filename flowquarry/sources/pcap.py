"""Packet captures: a distributed reader over whole files, frame and ClientHello decoding, and a writer for fixtures.

Files are listed and read by Spark's binary source, so any file system Spark reaches will do; each file is one task's
work and its packets leave it in Arrow batches.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic numbers of the formats, as (byte order, ticks a second).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
#: Link types.
NULL, ETHERNET, RAW, SLL = 0, 1, (12, 14, 101), 113
PACKET = "path string, ts_us long, linktype int, src_ip string, dst_ip string, src_port int, dst_port int, proto int, ip_len int, payload_len int, flags int, payload binary, dns_name string, dns_qtype int, dns_response boolean, dns_rcode int"


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(microseconds, link type, frame) of a pcap or pcapng file; a cut-off record ends the file."""
    if data[:4] in MAGIC:
        order, ticks = MAGIC[data[:4]]
        link, at = struct.unpack(order + "I", data[20:24])[0] & 0xFFFF, 24
        while at + 16 <= len(data):
            sec, frac, size, _ = struct.unpack(order + "IIII", data[at : at + 16])
            if at + 16 + size > len(data):
                return
            yield sec * 10**6 + frac * 10**6 // ticks, link, data[at + 16 : at + 16 + size]
            at += 16 + size
    elif data[:4] == b"\x0a\x0d\x0d\x0a":
        yield from _pcapng(data)


def _pcapng(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    order, faces, at = "<", [], 0
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            faces = []
        kind, size = struct.unpack(order + "II", data[at : at + 8])
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        if kind == 1:
            link, ticks, opt = struct.unpack(order + "H", body[:2])[0], 10**6, 8
            while opt + 4 <= len(body):
                code, n = struct.unpack(order + "HH", body[opt : opt + 4])
                if code == 9 and n:
                    r = body[opt + 4]
                    ticks = 2 ** (r & 127) if r & 128 else 10**r
                if code == 0:
                    break
                opt += 4 + n + (-n) % 4
            faces.append((link, ticks))
        elif kind == 6 and len(body) >= 20:
            face, high, low, n, _ = struct.unpack(order + "IIIII", body[:20])
            if face < len(faces):
                link, ticks = faces[face]
                yield ((high << 32) | low) * 10**6 // ticks, link, body[20 : 20 + n]
        elif kind == 3 and faces:
            yield 0, faces[0][0], body[4:]
        at += size


def _network(link: int, frame: bytes) -> bytes | None:
    """The network-layer part of a frame; None for other payloads."""
    if link == ETHERNET:
        kind, at = frame[12:14], 14
        while kind in (b"\x81\x00", b"\x88\xa8"):
            kind, at = frame[at + 2 : at + 4], at + 4
        return frame[at:] if kind in (b"\x08\x00", b"\x86\xdd") else None
    if link == SLL:
        return frame[16:] if frame[14:16] in (b"\x08\x00", b"\x86\xdd") else None
    if link == NULL:
        return frame[4:]
    return frame if link in RAW else None


def dns_question(data: bytes) -> tuple[str, int, bool, int] | None:
    """(name, type, is response, response code) of the first question."""
    if len(data) < 17:
        return None
    flags, count = struct.unpack(">HH", data[2:6])
    at, labels = 12, []
    if not count:
        return None
    while at < len(data) and (n := data[at]):
        if n & 0xC0 or at + 1 + n > len(data):
            return None
        labels.append(data[at + 1 : at + 1 + n].decode("ascii", "replace"))
        at += 1 + n
    if at + 5 > len(data) or data[at]:
        return None
    return ".".join(labels).lower(), struct.unpack(">H", data[at + 1 : at + 3])[0], bool(flags & 0x8000), flags & 15


def parse(link: int, frame: bytes) -> dict | None:
    """A packet's fields; None where the frame is malformed or not IP."""
    try:
        ip = _network(link, frame)
        if not ip:
            return None
        if ip[0] >> 4 == 4:
            head, size = (ip[0] & 15) * 4, struct.unpack(">H", ip[2:4])[0] or len(ip)
            proto, fragment = ip[9], struct.unpack(">H", ip[6:8])[0] & 0x1FFF
            src, dst = ip[12:16], ip[16:20]
            if head < 20 or len(dst) < 4:
                return None
        elif ip[0] >> 4 == 6:
            head, size, proto, fragment = 40, 40 + struct.unpack(">H", ip[4:6])[0], ip[6], 0
            src, dst = ip[8:24], ip[24:40]
            while proto in (0, 43, 60):
                proto, head = ip[head], head + (ip[head + 1] + 1) * 8
            if proto == 44:
                proto, fragment = ip[head], 1
        else:
            return None
        out = {"src_ip": str(ipaddress.ip_address(src)), "dst_ip": str(ipaddress.ip_address(dst)), "src_port": 0, "dst_port": 0, "proto": proto, "ip_len": size, "payload_len": 0, "flags": 0, "payload": b""}
        if fragment:
            return out
        body, room = ip[head:size], size - head
        # A cut transport header leaves the packet without ports.
        if len(body) < {6: 14, 17: 8}.get(proto, 0):
            return out
        if proto == 6:
            offset = (body[12] >> 4) * 4
            out |= {"flags": body[13], "payload_len": max(room - offset, 0), "payload": body[offset:]}
        elif proto == 17:
            out |= {"payload_len": max(room - 8, 0), "payload": body[8:]}
        else:
            return out
        out["src_port"], out["dst_port"] = struct.unpack(">HH", body[:4])
        if proto == 17 and {out["src_port"], out["dst_port"]} & {53, 5353} and (q := dns_question(out["payload"])):
            out |= dict(zip(("dns_name", "dns_qtype", "dns_response", "dns_rcode"), q, strict=True))
        return out
    except (IndexError, struct.error, ValueError):
        return None


def client_hello(data: bytes) -> dict | str | None:
    """Fields of a TLS ClientHello; 'more' where bytes are missing, None where it is something else."""
    if not data:
        return "more"
    if data[0] != 0x16 or (len(data) > 1 and data[1] != 3):
        return None
    if len(data) < 9:
        return "more"
    size = struct.unpack(">H", data[3:5])[0]
    if data[5] != 1 or size > 16384:
        return None
    if len(data) < 5 + size:
        return "more"
    try:
        b = data[9 : 5 + size]
        out = {"version": struct.unpack(">H", b[:2])[0], "ciphers": [], "extensions": [], "curves": [], "formats": [], "signatures": [], "sni": None, "alpn": None, "max_version": None}
        at = 35 + b[34]
        n = struct.unpack(">H", b[at : at + 2])[0]
        out["ciphers"] = list(struct.unpack(f">{n // 2}H", b[at + 2 : at + 2 + n]))
        at += 2 + n
        at += 1 + b[at]
        end = min(len(b), at + 2 + struct.unpack(">H", b[at : at + 2])[0]) if at + 2 <= len(b) else at
        at += 2
        versions = []
        while at + 4 <= end:
            kind, n = struct.unpack(">HH", b[at : at + 4])
            x = b[at + 4 : at + 4 + n]
            out["extensions"].append(kind)
            if kind == 0 and n > 5:
                out["sni"] = x[5 : 5 + struct.unpack(">H", x[3:5])[0]].decode("ascii", "replace").lower()
            elif kind == 10 and n >= 2:
                out["curves"] = list(struct.unpack(f">{(n - 2) // 2}H", x[2 : 2 + (n - 2) // 2 * 2]))
            elif kind == 11 and n:
                out["formats"] = list(x[1 : 1 + x[0]])
            elif kind == 13 and n >= 2:
                out["signatures"] = list(struct.unpack(f">{(n - 2) // 2}H", x[2 : 2 + (n - 2) // 2 * 2]))
            elif kind == 16 and n > 3:
                out["alpn"] = x[3 : 3 + x[2]].decode("ascii", "replace")
            elif kind == 43 and n:
                versions = list(struct.unpack(f">{x[0] // 2}H", x[1 : 1 + x[0] // 2 * 2]))
            at += 4 + n
        real = [v for v in versions if v & 0x0F0F != 0x0A0A]
        out["max_version"] = max(real) if real else out["version"]
        return out
    except (IndexError, struct.error):
        return None


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all captures under path; malformed frames have a null proto."""
    kinds = [(f.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[f.split()[1]]) for f in PACKET.split(", ")]

    def part(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for ts, link, frame in frames(data.as_buffer().to_pybytes()):
                    rows.append({"path": path, "ts_us": ts, "linktype": link} | (parse(link, frame) or {}))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds], [k for k, _ in kinds])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds], [k for k, _ in kinds])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(part, PACKET)


def labelled(packets: DataFrame) -> DataFrame:
    """Capture id and label (0 benign, 1 malware) from the path."""
    return packets.withColumns({"capture_id": F.regexp_extract("path", r"([^/]+)\.pcap(ng)?$", 1), "label": F.when(F.col("path").contains("/malware/"), 1).when(F.col("path").contains("/benign/"), 0)})


def replayed(packets: DataFrame, times: int) -> DataFrame:
    """The capture repeated, each pass after the one before: time moves by the span and one second."""
    span = packets.agg(F.coalesce(F.max("ts_us") - F.min("ts_us"), F.lit(0)).alias("span")).first().span
    return packets.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("ts_us", F.col("ts_us") + F.col("pass") * (span + 1_000_000))


def write_pcap(path: str, rows: list[tuple[int, bytes]], link: int = 1) -> None:
    """A little-endian microsecond capture, for fixtures."""
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link))
        for ts, frame in rows:
            f.write(struct.pack("<IIII", ts // 10**6, ts % 10**6, len(frame), len(frame)) + frame)


def udp_frame(src: str, dst: str, sport: int, dport: int, payload: bytes) -> bytes:
    body = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    return _frame(src, dst, 17, body)


def tcp_frame(src: str, dst: str, sport: int, dport: int, flags: int, payload: bytes = b"") -> bytes:
    return _frame(src, dst, 6, struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) + payload)


def _frame(src: str, dst: str, proto: int, body: bytes) -> bytes:
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    if a.version == 4:
        ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, a.packed, b.packed)
        return b"\0" * 12 + b"\x08\x00" + ip + body
    return b"\0" * 12 + b"\x86\xdd" + struct.pack(">IHBB16s16s", 0x60000000, len(body), proto, 64, a.packed, b.packed) + body


def dns_query(name: str, qtype: int = 1) -> bytes:
    labels = b"".join(bytes([len(x)]) + x.encode() for x in name.split("."))
    return struct.pack(">HHHHHH", 1, 0x0100, 1, 0, 0, 0) + labels + b"\0" + struct.pack(">HH", qtype, 1)


def hello(version: int, ciphers: list[int], sni: str, curves: list[int], formats: list[int]) -> bytes:
    """A ClientHello record with server name, curves and point formats."""
    name = sni.encode()
    ext = struct.pack(">HHHBH", 0, len(name) + 5, len(name) + 3, 0, len(name)) + name
    ext += struct.pack(f">HHH{len(curves)}H", 10, 2 * len(curves) + 2, 2 * len(curves), *curves)
    ext += struct.pack(">HHB", 11, len(formats) + 1, len(formats)) + bytes(formats)
    body = struct.pack(">H", version) + b"\0" * 32 + b"\0" + struct.pack(f">H{len(ciphers)}H", 2 * len(ciphers), *ciphers) + b"\x01\0" + struct.pack(">H", len(ext)) + ext
    shake = b"\x01" + struct.pack(">I", len(body))[1:] + body
    return b"\x16" + struct.pack(">HH", 0x0301, len(shake)) + shake
