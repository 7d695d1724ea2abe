import hashlib
import random

import pytest

from faultline.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, marks int"


def brute(rows, window=13):
    first = {}
    words = [[] if t is None else [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)] for _, t in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df, **kw).collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_random_passages(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" for i in range((3, 12, 60, 400)[seed])]
    pool = [[rnd.choice(vocab) for _ in range(rnd.randint(12, 60))] for _ in range(5)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(pool)
            a = rnd.randint(0, len(p) - 1)
            w += p[a : a + rnd.randint(1, 40)] if rnd.random() < 0.6 else [rnd.choice(vocab) for _ in range(rnd.randint(1, 30))]
        rows.append((rnd.choice([d, d, d // 2]), rnd.choice([" ", "\n", " \t\x0b"]).join(w)))
    assert ours(spark, rows) == brute(rows)


def test_edges(spark):
    same = " ".join(f"x{i}" for i in range(13))
    rows = [(1, None), (2, ""), (3, same), (4, same), (4, same), (None, same), (5, "a " * 40), (6, "a " * 14), (7, "x " + same + " y"), (8, " ".join(f"x{i}" for i in range(12))), (9, "b" * 300_000 + " " + same)]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, []) == []


def test_texts_and_window(spark):
    rows = [(1, "a b c d e f"), (2, "z a b c d e y")]
    got = {r.doc_id: (r.kept_text, r.n_removed) for r in remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), window=5).collect()}
    assert got == {1: ("a b c d e f", 0), 2: ("z y", 5)}
