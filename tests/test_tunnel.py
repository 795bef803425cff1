"""The whole DNS tunnel score against a fold over the queries in order."""

import math
import random
from collections import Counter, defaultdict, deque
from statistics import fmean, pstdev

from flowquarry.detectors import scores


def fold(rows):
    ramp = lambda v, lo, hi: max(0.0, min(1.0, (v - lo) / (hi - lo)))
    sources, rings, out = defaultdict(set), defaultdict(lambda: deque(maxlen=256)), {}
    for i, us, src, domain, qtype in sorted(rows, key=lambda r: (r[1], r[0])):
        ls = (domain or "").lower().strip().rstrip(".").split(".")
        if ls == [""]:
            continue
        k = 3 if len(ls) > 2 and ".".join(ls[-2:]) in ("co.uk", "com.au") else 2
        name = ".".join(ls[-k:])
        sources[name].add(src)
        label = max([x for x in ls[:-k] if x], key=len, default="")
        if len(label) < 8 or not label.isalnum():
            continue
        ring = rings[src, name]
        ring.append((us / 1e6, label, qtype in (16, 10)))
        while us / 1e6 - ring[0][0] > 120:
            ring.popleft()
        n = len(ring)
        if n < 8:
            continue
        entropy = [-sum(c / len(x) * math.log2(c / len(x)) for c in Counter(x).values()) for _, x, _ in ring]
        gaps = [b[0] - a[0] for a, b in zip(ring, list(ring)[1:], strict=False) if b[0] > a[0]]
        cadence = max(0.0, 1 - pstdev(gaps) / fmean(gaps) / 0.75) if gaps else 0.0
        score = 0.25 * ramp(fmean(len(x) for _, x, _ in ring), 20, 50) + 0.25 * ramp(fmean(entropy), 2.5, 3.8) + 0.25 * ramp(len({x for _, x, _ in ring}) / n, 0.5, 0.95)
        score += 0.1 * ramp(n / max(ring[-1][0] - ring[0][0], 1), 0.1, 5) + 0.1 * cadence + 0.05 * sum(t for *_, t in ring) / n
        out[i] = (src, name, n, min(1.0, score * (0.6 if len(sources[name]) >= 25 else 1.0)))
    return out


def test_tunnel_against_a_fold(spark):
    rnd, rows = random.Random(2), []
    text = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    def add(us, src, domain, qtype=1):
        rows.append((len(rows), us, src, domain, qtype))

    for i in range(400):
        add(i * 200_000, "t1", f"{text(44)}.x.evil.co.uk", 16)  # beyond the ring of 256
        add(i * 900_000, "t2", f"a.{text(40)}.bad.org.")
        add(i * 700_000 + rnd.randrange(600_000), f"s{i % 60}" if i % 2 else "t3", f"{text(48)}.cdn.net", 10)
        add(i * 5_000_000, "t4", f"{text(9)}.slow.com")
        add(i * 300_000, "t5", rnd.choice(["abc.ok.com", "with-dash-here.ok.com", "samelabel.ok.com", "ok.com", None, "", "longlabel1.Ok.com"]))
    got = {r.query_id: r for r in scores.tunnel_scores(spark.createDataFrame(rows, "query_id long, ts_us long, src_ip string, domain string, qtype int").repartition(5)).collect()}
    want = fold(rows)
    assert set(got) == set(want)
    for i, (src, name, n, score) in want.items():
        assert (got[i].src_ip, got[i].registered, got[i].n) == (src, name, n) and abs(got[i].score - score) < 1e-4, (got[i], want[i])
        assert got[i].alert == int(got[i].score >= 0.65)
    assert {r.src_ip for r in got.values() if r.alert} >= {"t1", "t2", "t3"}
    assert any(r.src_ip == "t3" and not r.alert for r in got.values())
