"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Second-level public suffixes of the domain-score path.
PUBLIC_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.in", "net.in", "org.in", "gov.in", "ac.in", "nic.in", "co.jp", "com.br", "com.cn", "co.za", "com.mx", "co.nz", "com.sg", "com.tr")
#: Address ranges that threat intelligence never looks up, as first address and prefix length.
INTERNAL_V4 = (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8), ("169.254.0.0", 16), ("224.0.0.0", 4), ("0.0.0.0", 8))
#: IANA special-purpose ranges that count as private in the exfiltration path.
PRIVATE_V4 = (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4), ("255.255.255.255", 32))
#: IANA special-purpose IPv6 ranges, as patterns of an address's text, and the public ones among them.
PRIVATE_V6 = r"^(::1?$|::ffff:|64:ff9b:1:|100::|2001:(:|[0-9a-f]{1,2}:|0{0,1}[01][0-9a-f]{2}:|0?db8:)|2002:|3fff:(:|[0-9a-f]{1,3}:|0[0-9a-f]{3}:)|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"
PUBLIC_V6 = r"^2001:(0{0,3}3:|0{0,3}4:112:|0{0,2}[23][0-9a-f]:)"
#: IP protocol numbers.
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPV6"}
#: TCP flag bits.
FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16
RATIO_CAP = 1000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ramp(x, low: float, high: float) -> Column:
    """0 up to low, 1 from high, linear between."""
    x = _c(x)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))


def safe_double(x, default: float = 0.0) -> Column:
    return F.coalesce(_c(x).try_cast("double"), F.lit(default))


def ipv4_number(ip) -> Column:
    """The address as a number; null where it is not a dotted quad of 0-255."""
    parts = F.split(_c(ip), r"\.")
    n = [F.get(parts, F.lit(i)).try_cast("long") for i in range(4)]
    ok = _c(ip).rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    return F.when(ok, n[0] * 16777216 + n[1] * 65536 + n[2] * 256 + n[3])


def _quad(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return a * 16777216 + b * 65536 + c * 256 + d


def in_ranges(number: Column, ranges) -> Column:
    """Whether a number lies in one of the ranges. The number is computed once, as the one element of an array; as a
    plain expression every range test would hold a copy of it and the generated code would outgrow its limit."""

    def test(n: Column) -> Column:
        out = F.lit(False)
        for ip, bits in ranges:
            out |= n.between(_quad(ip), _quad(ip) + 2 ** (32 - bits) - 1)
        return out

    return F.get(F.transform(F.array(number), test), F.lit(0))


def is_internal(ip) -> Column:
    """Addresses never looked up; unparsable ones count as internal. IPv6 ranges are told by their first digits."""
    shape = F.lower(_c(ip)).rlike(r"^(?=.*:)[0-9a-f:.]{2,45}$")
    v6 = F.lower(_c(ip)).rlike(r"^(f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:|(0{0,4}:){2,7}0{0,3}1$)")
    return F.coalesce(in_ranges(ipv4_number(ip), INTERNAL_V4), F.when(shape, v6), F.lit(True))


def is_private(ip) -> Column:
    """The wider table of the exfiltration path; unparsable addresses are not private. IPv6 is told by its first groups."""
    text = F.lower(_c(ip))
    v6 = text.rlike(r"^(?=.*:)[0-9a-f:.]{2,45}$") & text.rlike(PRIVATE_V6) & ~text.rlike(PUBLIC_V6)
    return F.coalesce(in_ranges(ipv4_number(ip), PRIVATE_V4), v6, F.lit(False))


def protocol_name(number) -> Column:
    n = _c(number)
    out = F.upper(n.cast("string"))
    for k, name in PROTOCOLS.items():
        out = F.when(n == k, name).otherwise(out)
    return out


def has_flag(flags, bit: int) -> Column:
    return _c(flags).bitwiseAND(bit) != 0


def normal_domain(name) -> Column:
    return F.regexp_replace(F.lower(F.trim(_c(name))), r"\.+$", "")


def domain_parts(name, suffixes=PUBLIC_SUFFIXES) -> Column:
    """struct(sld, suffix, registered, subdomain) with second-level public suffixes respected."""
    labels = F.split(_c(name), r"\.")
    n = F.size(labels)
    two = F.concat_ws(".", F.get(labels, n - 2), F.get(labels, n - 1))
    take = F.when((n > 2) & two.isin(*suffixes), 2).otherwise(1)
    suffix = F.when(n > 1, F.array_join(F.slice(labels, n - take + 1, take), ".")).otherwise("")
    sld = F.when(n > 1, F.get(labels, n - take - 1)).otherwise(F.get(labels, F.lit(0)))
    sub = F.when(n > take + 1, F.array_join(F.slice(labels, F.lit(1), F.greatest(n - take - 1, F.lit(0))), ".")).otherwise("")
    return F.struct(sld.alias("sld"), suffix.alias("suffix"), F.when(n > 1, F.concat_ws(".", sld, suffix)).otherwise(sld).alias("registered"), sub.alias("subdomain"))


def entropy_of(counts) -> Column:
    """Bits of an array of counts; 0 without any."""
    total = F.aggregate(_c(counts), F.lit(0.0), lambda a, x: a + x.cast("double"))
    bits = F.aggregate(_c(counts), F.lit(0.0), lambda a, x: a + F.when(x > 0, x.cast("double") * F.log2(x.cast("double"))).otherwise(0.0))
    return F.when(total > 0, F.log2(total) - bits / total).otherwise(0.0)


def char_counts(text) -> Column:
    chars = F.split(_c(text), "")
    return F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)))


def char_entropy(text) -> Column:
    return F.when(F.length(_c(text)) > 0, entropy_of(char_counts(text))).otherwise(0.0)


def count_of(text, pattern: str) -> Column:
    return F.length(F.regexp_replace(_c(text), f"[^{pattern}]", ""))


def longest_run(text, pattern: str) -> Column:
    runs = F.regexp_extract_all(_c(text), F.lit(f"[{pattern}]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def ngrams(text, n: int) -> Column:
    size = F.length(_c(text))
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(_c(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def capped_ratio(a, b, cap: float = RATIO_CAP) -> Column:
    """a / b, at most cap; over zero it is cap where there is anything, else 0."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b > 0, F.least(a / F.nullif(b, F.lit(0.0)), F.lit(cap))).when(a > 0, cap).otherwise(0.0)


def guarded(a, b, otherwise: float = 0.0) -> Column:
    """a / b where b is positive."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b > 0, a / F.nullif(b, F.lit(0.0))).otherwise(otherwise)


#: Reserved (GREASE) code points of the TLS registries.
GREASE = tuple(0x0A0A + 0x1010 * i for i in range(16))


def ja3(version, ciphers, extensions, curves, formats, drop_grease: bool = True) -> Column:
    """struct(text, md5) of the five comma-joined lists."""

    def dash(xs):
        xs = F.filter(_c(xs), lambda x: ~x.isin(*GREASE)) if drop_grease else _c(xs)
        return F.array_join(F.transform(xs, lambda x: x.cast("string")), "-")

    plain = F.array_join(F.transform(_c(formats), lambda x: x.cast("string")), "-")
    text = F.concat(_c(version).cast("string"), F.lit(","), dash(ciphers), F.lit(","), dash(extensions), F.lit(","), dash(curves), F.lit(","), plain)
    return F.struct(text.alias("text"), F.md5(text.cast("binary")).alias("md5"))


def ja3s(version, cipher, extensions) -> Column:
    """struct(text, md5) of a ServerHello: version, chosen cipher, extensions in their order."""
    text = F.concat_ws(",", _c(version).cast("string"), _c(cipher).cast("string"), F.array_join(F.transform(_c(extensions), lambda x: x.cast("string")), "-"))
    return F.struct(text.alias("text"), F.md5(text.cast("binary")).alias("md5"))


#: Version codes of a ClientHello fingerprint.
TLS_VERSIONS = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3"}


def ja4(version, ciphers, extensions, signatures, alpn, has_sni) -> Column:
    clean = F.filter(_c(ciphers), lambda x: ~x.isin(*GREASE))
    exts = F.filter(_c(extensions), lambda x: ~x.isin(*GREASE))

    def hexes(xs, sort=True):
        out = F.transform(xs, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0"))
        return F.array_join(F.array_sort(out) if sort else out, ",")

    code = F.lit("00")
    for k, v in TLS_VERSIONS.items():
        code = F.when(_c(version) == k, v).otherwise(code)
    two = lambda n: F.lpad(F.least(n, F.lit(99)).cast("string"), 2, "0")
    al = F.when(F.length(_c(alpn)) > 0, F.concat(F.substring(_c(alpn), F.lit(1), F.lit(1)), F.substring(_c(alpn), F.length(_c(alpn)), F.lit(1)))).otherwise("00")
    head = F.concat(F.lit("t"), code, F.when(_c(has_sni), "d").otherwise("i"), two(F.size(clean)), two(F.size(exts)), al)
    body = hexes(F.filter(exts, lambda x: ~x.isin(0, 16)))
    sig = hexes(_c(signatures), sort=False)
    tail = F.when(F.size(_c(signatures)) > 0, F.concat(body, F.lit("_"), sig)).otherwise(body)
    cut = lambda x: F.substring(F.sha2(x.cast("binary"), 256), 1, 12)
    return F.concat_ws("_", head, cut(hexes(clean)), cut(tail))


def severity(score, levels: tuple[tuple[float, str], ...], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for least, name in sorted(levels):
        out = F.when(_c(score) >= least, name).otherwise(out)
    return out


def volume_features(flows: DataFrame) -> DataFrame:
    """Totals and rates of (flow_id, bytes_out, bytes_in, pkts, duration_us); no rate without a duration."""
    seconds = F.col("duration_us") / 1e6
    rate = lambda x, name: F.round(F.when(seconds > 0, x / F.nullif(seconds, F.lit(0.0))).otherwise(0.0), 6).alias(name)
    total = F.col("bytes_out") + F.col("bytes_in")
    return flows.select("flow_id", total.alias("total_bytes"), rate(F.col("bytes_out"), "out_rate"), rate(F.col("bytes_in"), "in_rate"), rate(total, "total_rate"), rate(F.col("pkts"), "packet_rate"))


def iso_millis(us) -> Column:
    """Microseconds since the epoch as text in UTC with milliseconds."""
    us = _c(us)
    at = F.timestamp_micros(us)
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss."), F.lpad((F.floor(us / 1000) % 1000).cast("string"), 3, "0"), F.lit("Z"))


def event_micros(value) -> Column:
    """Microseconds since the epoch of a text: a number of seconds, or an ISO time (UTC if it names no zone); else null."""
    v = F.trim(_c(value).cast("string"))
    zoned = v.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    iso = F.when(zoned, v).otherwise(F.concat(v, F.lit("Z")))
    return F.coalesce(F.round(v.try_cast("double") * 1e6).cast("long"), F.unix_micros(iso.try_cast("timestamp")))


def minute_of_day(us) -> Column:
    return (F.floor(_c(us) / 60_000_000) % 1440).cast("int")


def flow_key() -> Column:
    """src:port>dst:port/protocol."""
    return F.format_string("%s:%d>%s:%d/%d", "src_ip", "src_port", "dst_ip", "dst_port", "proto")
