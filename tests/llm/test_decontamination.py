import random
import re

from faultline.llm.decontamination import find_leaks

SCHEMA = "doc_id long, text string, items string"


def norm(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    owners = {}
    for i, it in items:
        q = norm(it)
        for p in range(max(1, len(q) - window + 1)) if q else ():
            owners.setdefault(tuple(q[p : p + window]), set()).add(i)
    sizes = {len(g) for g in owners}
    out = []
    for d, text in docs:
        w, hit, ids = norm(text), set(), set()
        for size in sizes:
            for a in range(len(w) - size + 1):
                who = owners.get(tuple(w[a : a + size]))
                if who:
                    hit.update(range(a, a + size))
                    ids |= who
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    v = ["Aé", "b", "c3", "D", "ß"]
    items = [(i, " ".join(rnd.choice(v) for _ in range(rnd.randint(1, 25)))) for i in range(12)] + [(50, "b"), (51, ""), (52, None), (3, "zz yy"), (53, "D-D d")]
    docs = [(d, rnd.choice([" ", ", ", "\n"]).join(rnd.choice(v) for _ in range(rnd.randint(0, 80))) + rnd.choice(["", " " + (rnd.choice(items)[1] or "")]) if rnd.random() < 0.9 else (items[rnd.randint(0, 11)][1]).upper()) for d in range(60)]
    docs += [(90, None), (91, ""), (None, "b b"), (92, "KK b"), (92, "KK b")]
    items = [(i, t) for i, t in items]
    df = spark.createDataFrame([(*r, "x") for r in docs], SCHEMA)
    bench = spark.createDataFrame([(*r, 1) for r in [*items, (None, "c3")]], "item_id long, text string, doc_id int")
    got = find_leaks(df, bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute(docs, items)
    rows = sorted(str(r) for r in got)
    for max_windows in (60, 24):  # several automata, long items in segments
        assert sorted(str(r) for r in find_leaks(df, bench, max_windows=max_windows).collect()) == rows
    by = dict(docs)
    for r in got:
        if r.doc_id not in (None, 92):
            assert sum(len(norm(by[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit
    assert find_leaks(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert find_leaks(df.limit(0), bench).count() == 0


def test_offsets(spark):
    text = "Xé—Intro! The QUICK, brown fox. End"
    df = spark.createDataFrame([(1, text, "")], SCHEMA)
    bench = spark.createDataFrame([(1, "the quick brown-fox")], "item_id long, text string")
    (r,) = find_leaks(df, bench).collect()
    assert [text[s.start : s.end] for s in r.spans] == ["The QUICK, brown fox"]


def test_long_texts(spark):
    """A text and an item of 200,000 words; a hit at the very end of each."""
    long = " ".join(f"w{k}" for k in range(200_000))
    df = spark.createDataFrame([(1, long, ""), (2, "a " * 200_000 + "w199990 w199991 w199992 w199993 w199994 w199995 w199996 w199997 w199998 w199999", ""), (3, "x" * 1_000_000, "")], SCHEMA)
    bench = spark.createDataFrame([(7, long)], "item_id long, text string")
    for max_windows in (250_000, 100_000):
        got = {r.doc_id: r for r in find_leaks(df, bench, max_windows=max_windows).collect()}
        assert [(got[d].n_words, got[d].n_hit, got[d]["items"]) for d in (1, 2, 3)] == [(200_000, 200_000, [7]), (200_010, 10, [7]), (1, 0, [])]
        assert [(s.start, s.end) for s in got[1].spans] == [(0, len(long))] and len(got[2].spans) == 1
