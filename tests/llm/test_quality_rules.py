import re
from collections import Counter

from pyspark.sql import functions as F

from faultline.llm import quality_rules as q

SCHEMA = "doc_id long, text string, q__words int, n_words int"


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered, times = set(), Counter(grams)
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(i, i + 5))
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "lines": len(lines),
        "capitals": sum("A" <= c <= "Z" for c in t),
        "stutters": sum(a == b for a, b in zip(w, w[1:], strict=False)),
    }


def brute_kept(text):
    m = brute(text)
    n = m["n_words"]
    return not (
        n < 10
        or 100 * m["n_repeat_words"] > 20 * n
        or 100 * m["n_symbols"] > 30 * n
        or 100 * m["n_dup_lines"] > 50 * m["lines"]
        or 100 * m["stutters"] > 30 * n
        or m["word_chars"] > 15 * n
        or 100 * m["capitals"] > 40 * len(text or "")
    )


def brute_rejections(text):
    m = brute(text)
    n = m["n_words"]
    held = {
        "few_words": n < 10, "repeated_words": 100 * m["n_repeat_words"] > 20 * n, "symbols": 100 * m["n_symbols"] > 30 * n, "stutters": 100 * m["stutters"] > 30 * n,
        "repeated_lines": 100 * m["n_dup_lines"] > 50 * m["lines"], "long_words": m["word_chars"] > 15 * n, "capitals": 100 * m["capitals"] > 40 * len(text or ""),
    }
    return {name for name, x in held.items() if x}


TEXTS = [None, "", " \n\t", "a b c d e a b c d e x", "one two three four five six seven eight nine ten", "a a a a a a a a a a a", "l1\nl1\n l1\n\nl1", "é ü 😀 # * | <a> $%& x y z", "AB CD EF GH IJ KL MN OP QR ST UV", "word\x0bword\x0cword\rword " * 3, "x" * 20_000 + " b"]


def test_measures(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)], SCHEMA).drop("q__words")
    names = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in q.measured(df, names).collect():
        want = brute(TEXTS[r.doc_id])
        assert {n: r[f"q__{n}"] for n in ["n_words", *names]} == {n: want[n] for n in ["n_words", *names]}, TEXTS[r.doc_id]


def test_order_changes_nothing(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)], SCHEMA).drop("q__words")
    rules = [*q.BASE, *q.OWN]
    for order in (rules, rules[::-1]):
        got = {r.doc_id: r.rejected_by is None for r in q.cascade(df, order).collect()}
        assert got == {i: brute_kept(t) for i, t in enumerate(TEXTS)}
    order = q.plan(df, rules)
    assert {r.name for r, _, _ in order} == {r.name for r in rules}
    again = q.plan(df.repartition(7), rules[::-1], 10_000)
    assert [(r.name, cost, share) for r, cost, share in order] == [(r.name, cost, share) for r, cost, share in again]
    n = len(TEXTS)
    shares = {r.name: sum(r.name in brute_rejections(t) for t in TEXTS) / n for r in rules}
    assert {r.name: share for r, _, share in order} == shares
    assert [(share + 1e-4) / cost for _, cost, share in order] == sorted(((share + 1e-4) / cost for _, cost, share in order), reverse=True)
    assert {r.doc_id for r in q.keep_good(df).collect()} == {i for i, t in enumerate(TEXTS) if brute_kept(t)}
    assert q.keep_good(df.limit(0)).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(i, t, i * 10, "mine") for i, t in enumerate(TEXTS)] * 2 + [(None, TEXTS[4], 7, "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, q__words int, rejected_by string").withColumn("Q__verdict", F.lit(1)).withColumn("own_q__words", F.lit(2))
    got = q.cascade(df, [*q.BASE, *q.OWN]).collect()
    assert sorted((str(r.doc_id), r.q__words, r.Q__verdict, r.own_q__words, r.rejected_by is None) for r in got) == sorted((str(i), n, 1, 2, brute_kept(t)) for i, t, n, _ in rows)
    kept = q.keep_good(df)
    assert kept.columns == df.columns and {r.rejected_by for r in kept.collect()} == {"mine"}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t, _, _ in rows if brute_kept(t))


def test_native(spark):
    df = spark.createDataFrame([(1, "x", 1, 2)], SCHEMA).drop("q__words")
    plan = q.cascade(df, [*q.BASE, *q.OWN])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEvalPython", "Python")
