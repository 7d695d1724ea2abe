"""Features, fit and scores against versions written out in plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from faultline.llm import quality_classifier as qc

SF = "/root/testdata/sf0.001"
SPACE = b" \t\n\x0b\x0c\r"


def brute_features(text):
    raw = (text or "").encode()
    kinds = [[9], [10], [13], [32], range(48, 58), range(65, 91), range(97, 123), range(128, 256), *([b] for b in range(33, 127) if not chr(b).isalnum())]
    held = [sum(b in k for b in raw) for k in kinds]
    out = [math.sqrt(n / max(1, len(raw))) for n in [*held, len(raw) - sum(held)]]
    words, now = [], bytearray()
    for b in raw + b" ":
        if b in SPACE:
            if now:
                words.append(bytes(now))
            now = bytearray()
        else:
            now.append(b)
    n = len(words)
    if not n:
        return [*out, *[0.0] * 13, 1.0]
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n
    times = Counter(words)
    runs = [tuple(words[i : i + 5]) for i in range(n - 4)]
    again = Counter(runs)
    lines = raw.split(b"\n")
    inked = [x for x in lines if x.strip()]
    # a line's length counts its break; the text's last line has none, but counts as if it had
    longest = sum(len(x) + 1 for x in lines) / len(lines)
    capitals = [sum(65 <= b < 91 for b in w) for w in words]
    return [
        *out,
        math.log1p(n) / 5, 1 / (1 + n), mean / 10, math.sqrt(sum((s - mean) ** 2 for s in sizes) / n) / 10, math.log1p(max(sizes)) / 5, len(times) / n, math.sqrt(max(times.values()) / n),
        math.sqrt(sum(again[r] > 1 for r in runs) / len(runs)) if runs else 0.0, math.sqrt(1 - len(set(inked)) / max(1, len(inked))), math.log1p(longest) / 5, math.sqrt(len(lines) / n),
        sum(c == s for c, s in zip(capitals, sizes, strict=True)) / n, sum(c > 0 for c in capitals) / n, 0.0,
    ]


def test_features():
    rnd = random.Random(4)
    bits = ["a", "Bc", "DEF", "12", "#", "é", "日本", " ", "  ", "\n", "\n\n", "\t", "\r\n", "the same run of words again ", "line\n"]
    texts = [None, "", " \n", "x", "A B C D E A B C D E", *("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(300))]
    got = qc._feature_rows(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), qc.WIDTH)
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(row, brute_features(text), atol=1e-9), text


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()]
    rows = {d: brute_features(t) for d, t in docs}
    known = [(q, rows[d]) for d, q in labels if q in (0, 1) and d in rows and zlib.crc32(str(d).encode()) % 5]
    x, y = np.array([r for _, r in known]), np.array([q for q, _ in known])
    order = np.lexsort((*x.T[:20], y))
    x, y = x[order], y[order]
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1
    z = ((x - mean) / spread).clip(-8, 8)
    draw = np.random.Generator(np.random.PCG64(5))
    better, worse = z[draw.choice(np.flatnonzero(y == 1), qc.PAIRS)], z[draw.choice(np.flatnonzero(y == 0), qc.PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(40):  # the loss of all pairs, by full Newton steps with halving
        p = 1 / (1 + np.exp(-((better - worse) @ w)))
        slope = (better - worse).T @ (1 - p) / qc.PAIRS - qc.L2 * w
        bend = ((better - worse) * (p * (1 - p))[:, None]).T @ (better - worse) / qc.PAIRS + qc.L2 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)

        def loss(v):
            return np.log1p(np.exp(-((better - worse) @ v))).mean() + qc.L2 / 2 * v @ v

        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * step
    bar = np.quantile(z @ w, (y == 0).mean())
    got = {r.doc_id: r for r in qc.op6_quality_classifier(spark, SF).collect()}
    assert len(got) == len(docs)
    near = 0
    for d, _ in docs:
        strength = ((np.array(rows[d]) - mean) / spread).clip(-8, 8) @ w
        want = 1 / (1 + math.exp(-(strength - bar + math.log(0.3 / 0.7))))
        assert abs(got[d].score - want) < 0.02 and got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and got[d].predicted == int(got[d].score >= 0.3)
        near += abs(got[d].score - want) < 1e-3
    assert near > 0.95 * len(docs)
