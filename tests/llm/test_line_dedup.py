import difflib
import random
from collections import defaultdict

from faultline.llm.line_dedup import blocks, dedup_lines, op1_line_dedup, patience

SCHEMA = "doc_id long, text string, n int, tag string, lines string"


def brute(rows, rare_df, least, every=False):
    """Each key's holders aligned with the first, or, with `every`, those of a key of few holders with all earlier ones."""
    solid = {d: [(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")] for d, t in rows}
    single, double = defaultdict(set), defaultdict(set)
    for d, ls in solid.items():
        x = [l for _, l in ls]
        for l in x:
            single[l].add(d)
        for pair in list(zip(x, x[1:], strict=False)) or [("one", x[0])] if x else []:
            double[pair].add(d)
    links = defaultdict(set)

    def earlier(ds):
        firsts = sorted(ds) if every and len(ds) <= rare_df else [min(ds)]
        return [(d, f) for d in ds for f in firsts if f < d]

    for l, ds in single.items():
        if 2 <= len(ds) <= rare_df:
            for d, f in earlier(ds):
                links[d, f].add(l)
    for ds in double.values():
        for d, f in earlier(ds):
            links[d, f]
    gone = defaultdict(set)
    for (d, f), rare in links.items():
        b = [l for _, l in solid[d]]
        gone[d] |= {solid[d][k][0] for k in blocks([l for _, l in solid[f]], b, rare, least)}
    return sorted((d, t if not gone[d] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]), len(solid[d]), len(gone[d])) for d, t in rows)


def test_patience():
    rnd = random.Random(4)
    for _ in range(300):
        v = rnd.choice([2, 5, 50])
        a, b = ([rnd.randrange(v) for _ in range(rnd.randint(0, 30))] for _ in range(2))
        got = patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        assert len(patience(a, a)) == len(a)
    assert patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert len(patience([7] * 20_000, [7] * 15_000 + [8] + [7] * 4_000)) >= 15_000


def test_against_brute_force(spark):
    rnd = random.Random(11)
    pool = [f"line {i}é" for i in range(120)] + ["", "  ", "boiler"] * 6
    rows = []
    passages = [[rnd.choice(pool) for _ in range(rnd.randint(1, 8))] for _ in range(6)]
    for d in range(80):
        t = []
        for _ in range(rnd.randint(0, 5)):
            t += rnd.choice(passages) if rnd.random() < 0.5 else [f"own {d} {rnd.random()}", rnd.choice(pool)]
        rows.append((d, "\n".join(t)))
    rows += [(100, None), (101, rows[3][1]), (102, "solo"), (103, "solo"), (104, "\n\n")]
    df = spark.createDataFrame([(*r, 1, "t", "l") for r in rows], SCHEMA).repartition(3)
    for rare, least in ((20, 2), (3, 3)):
        for every in (False, True):
            got = sorted((r.doc_id, r.kept_text, r.n_lines, r.n_removed) for r in dedup_lines(df, rare, least, every).collect())
            assert got == brute(rows, rare, least, every)


def own_blocks(a, b, rare, least):
    """The deletable positions of b, by an alignment of its own: the longest common run first, then what lies before and after it."""
    gone = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        match = difflib.SequenceMatcher(None, a[a0:a1], b[b0:b1], autojunk=False).find_longest_match()
        if match.size:
            i, j = a0 + match.a, b0 + match.b
            run = range(j, j + match.size)
            if match.size >= least or match.size == len(b) or any(b[k] in rare for k in run):
                gone |= set(run)
            todo += [(a0, i, b0, j), (i + match.size, a1, j + match.size, b1)]
    return gone


def test_recall_of_all_pairs(spark):
    """Against every pair of documents, aligned otherwise: nothing that is found there is missed but for changes of order."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    solid = {d: [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")] for d, t in rows}
    holders = defaultdict(set)
    for d, ls in solid.items():
        for x in ls:
            holders[x].add(d)
    rare = {x for x, ds in holders.items() if 2 <= len(ds) <= 20 or len(x.split()) >= 20 or len(x.encode()) >= 120}
    want = {d: set() for d in solid}
    for d in solid:
        for f in {f for x in solid[d] for f in holders[x] if f < d}:
            want[d] |= own_blocks(solid[f], solid[d], rare, 2)
    got = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), every=True).collect()}
    total = sum(map(len, want.values()))
    assert total > 100 and sum(min(got[d], len(want[d])) for d in want) >= 0.99 * total and sum(got.values()) <= 1.05 * total  # alignments differ where blocks change their order


def test_edges(spark):
    text = "a\n\nb\nc"
    rows = [(None, text), (5, text), (5, text), (6, text), (7, "x\na\n\nb\ny"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "t", "l") for r in rows], SCHEMA)
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n", "tag", "lines", "kept_text", "n_lines", "n_removed"]
    found = sorted(((r.doc_id, r.kept_text, r.n_removed) for r in got.select("doc_id", "kept_text", "n_removed").collect()), key=str)
    assert found == sorted([(5, text, 0), (5, text, 0), (6, "", 3), (7, "x\n\ny", 2), (None, None, 0), (None, text, 0)], key=str)
    assert dedup_lines(df.limit(0)).count() == 0


def test_frequent_long_lines(spark):
    """A long line goes at any frequency, a short one only as part of a block."""
    words, glued, short = " ".join(f"w{k}" for k in range(20)), "語" * 40, " ".join(f"w{k}" for k in range(19))
    rows = [(d, f"a{d}\n{words}\nb{d}\n{glued}\nc{d}\n{short}\nd{d}") for d in range(50)]
    df = spark.createDataFrame([(*r, 1, "t", "l") for r in rows], SCHEMA)
    got = {r.doc_id: r.kept_text for r in dedup_lines(df).collect()}
    assert got[0] == rows[0][1]
    assert all(got[d] == f"a{d}\nb{d}\nc{d}\n{short}\nd{d}" for d in range(1, 50))


def test_every_holder(spark, tmp_path):
    """A block goes if any earlier holder has it in the same order, though the first has another one."""
    texts = ["p1 p2 q1 q2 q3", "b1 p1 p2 b2", "q1 q2 q3 c1 p1 p2"]
    df = spark.createDataFrame([(d, "\n".join(t.split()), 1, "t", "l") for d, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.kept_text.split("\n") for r in dedup_lines(df, every=True).collect()}
    assert got == {0: texts[0].split(), 1: ["b1", "b2"], 2: ["c1"]}
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in op1_line_dedup(spark, str(tmp_path)).collect()} == {0: 0, 1: 2, 2: 5}


def test_clashing_columns_and_long_text(spark):
    long = "\n".join(f"line {k} of a very long text" for k in range(50_000))
    rows = [(1, "a b\nc d\nown one"), (2, "x\na b\nc d"), (2, "x\na b\nc d"), (3, long), (4, "first\n" + long), (None, "a b\nc d"), (5, None), (6, "")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    df = plain.selectExpr("doc_id", "text", "7 as tag__", "'q' as LINES__", "8 as gone__", "9 as n__", "10 as n_lines", "11 as c_id__")
    found = dedup_lines(df)
    assert found.columns == ["doc_id", "text", "tag__", "LINES__", "gone__", "n__", "c_id__", "kept_text", "n_lines", "n_removed"]
    got = found.collect()
    assert {(r.tag__, r.LINES__, r.gone__, r.n__, r.c_id__) for r in got} == {(7, "q", 8, 9, 11)}
    assert sorted((str(r.doc_id), str(r.kept_text)[:20], r.n_lines, r.n_removed) for r in got) == sorted((str(r.doc_id), str(r.kept_text)[:20], r.n_lines, r.n_removed) for r in dedup_lines(plain).collect())
    assert {r.doc_id: r.kept_text for r in got}[4] == "first" and [r.kept_text for r in got if r.doc_id == 2] == ["x", "x"]
