import collections
import hashlib
import math
import random

import numpy as np
import pytest

from faultline.llm import vector_codes as vc


def brute(vectors, parts, entries, rounds):
    """Plain Lloyd's rounds: every part against every entry, each time."""
    fine = [(i, [math.floor(256 * c) for c in x], label) for i, x, label in vectors if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    fine.sort(key=lambda r: (r[0] is None, r[0], r[1]) if r[0] is not None else (True, 0, r[1]))
    x = np.array([r[1] for r in fine]).reshape(len(fine), parts, -1)
    book = x[: min(entries, sum(r[0] is not None for r in fine))].copy()

    def assign():
        return np.stack([((x[:, p, None] - book[None, :, p]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)

    for _ in range(rounds):
        code, new = assign(), book.copy()
        for p in range(parts):
            for e in set(code[:, p]):
                new[e, p] = x[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
        book = new
    code = assign()
    error = [int(sum(((x[i, p] - book[code[i, p], p]) ** 2).sum() for p in range(parts))) for i in range(len(x))]
    text = ",".join(str(v) for p in range(parts) for e in range(len(book)) for v in book[e, p])
    return sorted(((r[0], "".join(f"{v:02x}" for v in c), k) for r, c, k in zip(fine, code, error, strict=True)), key=str), hashlib.sha256(text.encode()).hexdigest()


def made(seed, n, width):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i, [np.float32(c + rnd.gauss(0, 0.2)).item() for c in rnd.choice(centres)], rnd.choice([None, 1, 2])) for i in range(n)]
    rows += [(i, rows[3][1], 9) for i in range(n, n + 40)]  # equal vectors
    return rows + [(3, rows[5][1], 1), (n + 50, None, 1), (n + 51, [None] * width, 1), (n + 52, [math.nan] * width, None), (n + 53, [math.inf] + [0.0] * (width - 1), 1)]


@pytest.mark.parametrize(("n", "width", "parts", "entries", "rounds"), [(700, 32, 16, 64, 2), (300, 8, 2, 5, 6), (30, 16, 16, 64, 2), (400, 12, 3, 1, 3), (200, 4, 4, 256, 1)])
def test_against_plain_rounds(spark, n, width, parts, entries, rounds):
    rows = made(n, n, width)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    found, books = vc.fit_codes(df, parts, entries, rounds)
    want, sha = brute(rows, parts, entries, rounds)
    assert sorted(((r.vec_id, r.code, r.error) for r in found.collect()), key=str) == want
    assert books.digest() == sha


def test_only_violated_parts_are_scanned(monkeypatch):
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.integers(-5, 5, (200, 2)) + c for c in ([0, 0], [500, 0], [0, 500])])[None].astype(np.int64)
    books = vc.Codebooks(np.array([[[0, 0], [500, 0], [0, 500]]], np.int64))
    block = vc.Block(x, 3)
    block.fill(books)
    seen = []
    scan = vc._scan
    monkeypatch.setattr(vc, "_scan", lambda part, entries: (seen.append(len(part)), scan(part, entries))[1])
    near = books.moved(np.array([[[1, 1], [500, 2], [0, 499]]], np.int64))
    assert list(block.repair(near)) == [] and not seen  # no heap's root is violated
    far = near.moved(np.array([[[260, 0], [240, 2], [0, 499]]], np.int64))
    changed = list(block.repair(far))
    assert sum(seen) == 400 and all((new < 2).all() for _, _, _, new in changed)  # the third entry's heap stays closed
    assert (block.codes[0] == ((x[0][:, None] - far.entries[0][None]) ** 2).sum(2).argmin(1)).all()


def test_heaps_pop_what_is_violated():
    rnd = np.random.default_rng(6)
    x = rnd.integers(-50, 50, (1, 300, 3))
    books = vc.Codebooks(x[:, :7].copy())
    block = vc.Block(x, 7)
    block.fill(books)
    for _ in range(4):
        books = books.moved(books.entries + rnd.integers(-4, 5, books.entries.shape))
        code = np.repeat(np.arange(7), np.diff(np.concatenate([[0], block.ends[0]])))
        assert sorted(block.pop(0, books.drift[0])) == np.flatnonzero(block.keys[0] <= books.drift[0][code]).tolist()
        list(block.repair(books))
        assert (block.codes[0] == ((x[0][:, None] - books.entries[0][None]) ** 2).sum(2).argmin(1)).all()


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<double>, label string"
    none = spark.createDataFrame([(1, None, "a"), (2, [], "b"), (3, [1.0] * 5, None)], kind)
    assert vc.fit_codes(none)[0].count() == 0
    mixed = spark.createDataFrame([(5, [0.5] * 16, "a"), (2, [1e9] * 16, "a"), (6, [0.25] * 32, "b"), (None, [0.5] * 16, None)], kind)
    found, books = vc.fit_codes(mixed)
    assert sorted((r.vec_id or 0, r.code, r.error) for r in found.collect()) == [(0, "00" * 16, 0), (5, "00" * 16, 0)] and books.entries.shape == (16, 1, 1)
    with pytest.raises(ValueError):
        vc.fit_codes(mixed, rounds=0)
