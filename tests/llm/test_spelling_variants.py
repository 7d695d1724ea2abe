import collections
import random
import re
import zlib

from faultline.llm import spelling_variants as sv


def brute(docs, every=97):
    """All rows of the result, each word compared with each other one."""
    counts = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}

    def is_near(a, b):
        if len(a) > len(b):
            a, b = b, a
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a != b and (a[i:] == b[i + 1 :] if len(a) + 1 == len(b) else len(a) == len(b) and a[i + 1 :] == b[i + 1 :])

    near = {w: [x for x in n if abs(len(w) - len(x)) < 2 and is_near(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, lengths, letters):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.choice(lengths))) for _ in range(50)}
    for w in sorted(words):
        for _ in range(5):
            i = rnd.randrange(len(w))
            words.add(rnd.choice([w[:i] + rnd.choice("abÿ") + w[i:], w[:i] + w[i + 1 :], w[:i] + rnd.choice("abc") + w[i + 1 :]]))
    return [(rnd.choice([None, i, 7]), rnd.choice([" ", "1", "\n", "—"]).join([rnd.choice([w, w.title()])] * rnd.choice([2, 3, 4, 9, 20]))) for i, w in enumerate(sorted(words))]


def test_against_brute_force(spark):
    docs = corpus(1, [4, 5, 6, 7, 12], "aabé") + corpus(2, [63, 64, 65, 66, 200], "aab") + [(1, None), (2, ""), (3, "12 — 日本語"), (4, "ÀÉ×÷ß " * 3)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string")
    want = brute(docs)
    assert len(want) > 300 and sum(r[1] is not None for r in want) > 50
    for range_words in (50_000, 25):
        assert rows(sv.group_variants(sv.vocabulary(df), range_words=range_words)) == want
    assert rows(sv.group_variants(sv.vocabulary(df, every=3))) == brute(docs, 3)
    assert rows(sv.group_variants(sv.vocabulary(df.limit(0)))) == []


def test_complete_tries(spark):
    """All strings over two letters: every node has active nodes at every level."""
    words = sorted({f"{i:0{k}b}".translate({48: "a", 49: "b"}) for k in range(1, 8) for i in range(2**k)})
    df = spark.createDataFrame([(w, 1 + i) for i, w in enumerate(words)], "word string, n long")
    for range_words in (1000, 31, 5):
        got = {r.word: r.n_near for r in sv.near_words(df, range_words).collect()}
        assert got == {w: len({w[:i] + x + w[i + k :] for i in range(len(w) + 1) for x in ("", "a", "b") for k in (0, 1)} & set(words) - {w}) for w in words}


def test_long_chains_and_words(spark):
    chain = [("a" * k + "b" * (40 - k), 3 * 2**k) for k in range(40)]
    got = {r.word: r for r in sv.group_variants(spark.createDataFrame(chain, "word string, n long"), range_words=7).collect()}
    assert {r.root for r in got.values()} == {chain[-1][0]} and got[chain[0][0]].form == chain[1][0]
    long = [(1, ("q" * 20_000 + " ") * 3), (2, ("q" * 19_999 + " ") * 9)]
    got = rows(sv.group_variants(sv.vocabulary(spark.createDataFrame(long, "doc_id long, text string"), every=10**9)))
    assert sorted((len(r[0]), len(r[1] or ""), len(r[2]), *r[3:]) for r in got) == [(19_999, 0, 19_999, 9, 1, None), (20_000, 19_999, 19_999, 3, 1, 9)]
