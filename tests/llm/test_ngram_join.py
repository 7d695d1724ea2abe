import random
from collections import defaultdict

import pytest

from faultline.llm.components import components
from faultline.llm.ngram_join import _nodes, bands_for, keep_first, near_duplicates

SCHEMA = "doc_id long, text string, n long, rep_id string"


def grams(text, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = {d: grams(t) for d, t in rows}
    by = defaultdict(list)
    for d, s in sets.items():
        if s:
            by[s].append(d)
    rep = {s: min(ds) for s, ds in by.items()}
    parent = {r: r for r in rep.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = defaultdict(int)
    keys = list(rep)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(a & b) >= threshold * len(a | b) - 1e-9:
                count[rep[a]] += 1
                count[rep[b]] += 1
                x, y = sorted((root(rep[a]), root(rep[b])))
                parent[y] = x
    return sorted((d, root(rep[s]), rep[s], count[rep[s]]) if s else (d, d, d, 0) for d, s in sets.items())


@pytest.mark.parametrize("blocks", [(1_000_000, 600), (900, 4)])
def test_against_brute_force(spark, blocks):
    rnd = random.Random(9)
    vocab = [f"W{i}" for i in range(300)]
    rows, d = [], 100
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([6, 60, 120]))]
        for _ in range(rnd.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((d, rnd.choice([" ", "\n"]).join(w)))
            d -= 1 if rnd.random() < 0.5 else -70
    rows += [(5000, "one two"), (5001, "One  two"), (5002, "two one"), (5003, ""), (5004, None), (5005, " \n")]
    rows = [(x, t) for x, t in {x: t for x, t in rows}.items()]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], SCHEMA).repartition(3)
    got = near_duplicates(df, recall=0.999999, max_hashes=400, block_grams=blocks[0], block_texts=blocks[1]).collect()
    assert sorted((r.doc_id, r.class_id, r.rep_id, r.n_links) for r in got) == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c", 1, ""), (3, "a b c", 1, ""), (3, "a b c", 1, ""), (None, "x", 1, "")], SCHEMA)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(df).collect()), key=str)
    assert got == [(3, 3, 0), (3, 3, 0), (None, 3, 0), (None, None, 0)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_doc_id(spark):
    a, b = ("p q r s t u v w x y z " * 4 + "one two").split(), [f"u{i}" for i in range(40)]
    near_a, near_b = [*a[:-1], "three"], [*b[:-1], "else"]

    def run(rows):
        df = spark.createDataFrame([(d, " ".join(w), 1, "") for d, w in rows], SCHEMA)
        return [(r.doc_id, r.class_id, r.rep_id, r.n_links) for r in near_duplicates(df, recall=0.999999, max_hashes=400).collect()], keep_first(df)

    got, kept = run([(3, a), (3, a), (4, near_a)])
    assert sorted(got) == [(3, 3, 3, 1), (3, 3, 3, 1), (4, 3, 4, 1)]
    assert [r.doc_id for r in kept.collect()] == [3]
    got, kept = run([(3, a), (3, b), (4, near_a), (5, near_b)])
    assert [r[3] for r in got] == [1, 1, 1, 1]
    by = {d: c for d, c, _, _ in got if d != 3}
    assert by[4] != by[5] and {c for d, c, _, _ in got if d == 3} == {by[4], by[5]} and 3 in by.values()
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(3, " ".join(a)), (3, " ".join(b))])
    got, kept = run([(7, a), (7, b)])
    assert len({c for _, c, _, _ in got}) == 2 and kept.count() == 2


def test_keep_first_edges(spark):
    rows = [(None, "a b c", 1, ""), (None, None, 2, ""), (1, None, 3, ""), (1, "", 4, ""), (2, "a b c", 5, "x"), (2, "a b c", 6, "y"), (9, " ".join(f"w{i}" for i in range(30_000)), 7, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = keep_first(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 1, 2, 9, None, None]
    assert keep_first(df.limit(0)).count() == 0


def test_keep_first_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text, 5, "a"), (2, text, 6, "b"), (3, "other words", 7, "c"), (None, text, 8, "d"), (4, None, 9, "e")], "doc_id long, text string, nj__id int, NJ__of string")
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.nj__id, r.NJ__of) for r in kept.collect()) == [("1", 5, "a"), ("3", 7, "c"), ("4", 9, "e"), ("None", 8, "d")]


def test_equal_first_hashes(spark):
    rows = [(1, 10, 3, 77, 1, [1, 2]), (2, 20, 3, 77, 2, [3, 4]), (3, 10, 3, 77, 1, [1, 2])]
    got = _nodes(spark.createDataFrame(rows, "doc_id long, tag long, n long, h1 long, h2 long, bands array<long>")).collect()
    assert len(got) == 2 and len({r.node for r in got}) == 2 and 77 in {r.node for r in got}


def test_bands():
    bands, rows = bands_for(0.8, 0.999, 150)
    assert bands * rows <= 150 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rnd.randint(200, 300), rnd.randint(200, 300)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in list(parent)}
