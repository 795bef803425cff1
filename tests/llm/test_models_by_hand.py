"""Kneser-Ney and FTRL against plain loops over dictionaries."""

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from flowquarry.llm import langid, quality


def plain_kneser_ney(words, symbols, order=3):
    """log p(symbol | context) of an interpolated model by the textbook's formulas."""
    top = Counter()
    for w, n in words.items():
        s = langid.START * (order - 1) + w + langid.END
        for i in range(len(s) - order + 1):
            top[s[i : i + order]] += n
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    found = {}
    for k, c in counts.items():
        once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
        total, kinds = defaultdict(int), defaultdict(int)
        for g, n in c.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        found[k] = (c, d, total, kinds)

    def p(gram):
        if not gram:
            return 1 / symbols
        c, d, total, kinds = found[len(gram)]
        head = gram[:-1]
        if not total[head]:
            return p(gram[1:])
        return max(c[gram] - d, 0) / total[head] + d * kinds[head] / total[head] * p(gram[1:])

    return lambda gram: math.log(p(gram))


def test_language_model_equals_the_formulas():
    rng = np.random.default_rng(3)
    texts = {lang: Counter("".join(rng.choice(list(chars), rng.integers(1, 6))) for _ in range(300)) for lang, chars in (("aa", "abcde"), ("bb", "cdefgh"))}
    order, rows = 3, Counter()
    for lang, words in texts.items():
        for w, n in words.items():
            s = langid.START * (order - 1) + w + langid.END
            for i in range(len(s) - order + 1):
                rows[lang, s[i : i + order]] += n
    table = pd.DataFrame([(a, g, n) for (a, g), n in rows.items()], columns=["lang", "gram", "n"])
    model = langid.build_model(table, langid.LangConfig(order=order))
    symbols = len({g[-1] for _, g in rows}) + 1
    for col, lang in enumerate(model.langs):
        want = plain_kneser_ney(texts[lang], symbols, order)
        for w in ["abc", "hgf", "a", "cdcd", "zz", "ebdh"]:
            s = langid.START * (order - 1) + w + langid.END
            by_hand = sum(want(s[i : i + order]) for i in range(len(s) - order + 1))
            assert abs(float(model.words([w])[0, col]) - by_hand) < 1e-3, (lang, w)


def test_ftrl_equals_a_plain_loop():
    cfg = quality.QualityConfig(bits=6, epochs=2)
    rng = np.random.default_rng(1)
    examples = []
    for _ in range(60):
        idx = np.unique(rng.integers(0, 64, 6))
        x = rng.random(len(idx))
        examples.append((idx, x, int(x.sum() > 2.5)))
    got = quality.ftrl(examples, cfg)
    z, n, order = [0.0] * 64, [0.0] * 64, np.random.default_rng(7)

    def weight(i):
        if abs(z[i]) <= cfg.l1:
            return 0.0
        return -(z[i] - math.copysign(cfg.l1, z[i])) / ((cfg.beta + math.sqrt(n[i])) / cfg.alpha + cfg.l2)

    for _ in range(cfg.epochs):
        for e in order.permutation(len(examples)):
            idx, x, y = examples[e]
            w = {int(i): weight(i) for i in idx}
            p = 1 / (1 + math.exp(-sum(w[int(i)] * v for i, v in zip(idx, x, strict=True))))
            for i, v in zip(idx.tolist(), x.tolist(), strict=True):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / cfg.alpha * w[i]
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(64)], atol=1e-6) and np.abs(got).max() > 0
