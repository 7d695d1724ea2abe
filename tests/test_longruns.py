"""Runs cut into parts give what uncut ones give."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import longruns
from faultline.operators.parse import SEPARATORS, parse_runs, parse_text, report, unique_frames
from faultline.sources import ingest

#: Lines that open, carry on or end something in one reader or another.
LINES = [
    "Traceback (most recent call last):", '  File "a.py", line 2, in f', "    go()", "KeyError: 1", *SEPARATORS, "", "   ", "plain words", "2024-01-01 10:00:00 INFO a.b: started",
    "____ test_a ____", "t.py:3: in test_a", "E   AssertionError: no", "FAILED t.py::test_a - no",
    "thread 'm' panicked at a.rs:1:2:", "told why", "thread 'm' panicked at 'old', a.rs:4:5", "stack backtrace:", "   5: foo::bar", "             at ./a.rs:2:3", "note: run with", "  note: indented", "a::b --- FAILED",
    "panic: oops", "goroutine 1 [running]:", "main.f(0x1)", "\t/a/b.go:3 +0x1", "--- FAIL: TestA (0.00s)", "    a_test.go:3: bad", "./a.go:1:2: undefined: x",
    'Exception in thread "main" a.b.CException: x', "\tat a.b.C.f(C.java:1)", "Caused by: a.b.DError: y", "\t... 2 more", "A.java:3: error: bad",
    "error[E0308]: mismatched", "error: bare", "warning: unused", "error: aborting due to 2", "  --> a.rs:1:2", "   |    ^^^ label", "  ::: b.rs:4:5",
    "    at foo (a.js:1:2)", "    at b.js:3:4", "TypeError: no",
]


def texts_of(rnd, lines):
    cuts = sorted({0, len(lines), *(rnd.randint(0, len(lines)) for _ in range(rnd.randint(0, 6)))})
    return [""] * rnd.randint(0, 1) + ["\n".join(lines[a:b]) + "\n" for a, b in zip(cuts, cuts[1:], strict=False)]


@pytest.mark.parametrize("seed", range(12))
def test_any_cut(seed):
    rnd = random.Random(seed)
    for _ in range(20):
        lines = [rnd.choice(LINES) for _ in range(rnd.randint(1, 40))]
        texts = texts_of(rnd, lines)
        effects = [longruns.effects_of(t) for t in texts]
        now, sheets = longruns.START, []
        for text, effect in zip(texts, effects, strict=True):
            sheets.append(longruns.read_part(text, now))
            now = longruns.compose(now, effect[now.modes])
        assert report(longruns.whole_sheet(sheets)) == parse_text("\n".join(lines))
        k = rnd.randint(1, len(texts))
        rest = [longruns.joined(effects[k:])] if k < len(texts) else []
        assert longruns.joined(effects) == longruns.joined([longruns.joined(effects[:k]), *rest]) == longruns.effects_of("\n".join(lines) + "\n")


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(longruns, "FAN", 3)  # several levels of groups
    rnd = random.Random(99)
    runs = [(n, "\n".join(rnd.choice(LINES) for _ in range(size)), None) for n, size in enumerate([400, 90, 10, 0])] + [(9, None, "KeyError: 2")]
    df = spark.createDataFrame(runs, "run_id long, stdout string, stderr string")
    want = {r.run_id: r for r in parse_runs(df).collect()}
    assert {r.run_id: r for r in longruns.parse_long_runs(df, 60).collect()} == want
    assert {r.run_id: r for r in longruns.parse_any(df, 2_000).collect()} == want
    assert longruns.parse_long_runs(df.limit(0), 60).count() == 0


def test_log_parts(spark, tmp_path):
    rnd = random.Random(7)
    for n in range(3):
        (tmp_path / f"{n}.log").write_text("\n".join(rnd.choice(LINES) for _ in range(3000 * n + 1)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        parts = ingest.log_parts(spark, str(tmp_path), 5_000)
        assert parts.select(F.spark_partition_id()).distinct().count() > 3 and parts.count() > 20
        got = {r.run_id: r for r in longruns.parse_parts(parts, 5_000).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {r.run_id: r for r in parse_runs(ingest.runs_from_logs(spark, str(tmp_path), "r")).collect()}


def test_cut_text():
    assert list(longruns.cut_text("ab\ncd\nefgh\ni", 3)) == [(0, "ab\n"), (3, "cd\n"), (6, "efgh\n"), (11, "i")]
    assert list(longruns.cut_text("long line", 3)) == [(0, "long line")] and list(longruns.cut_text("", 3)) == []


def test_frames_of_parts(spark, monkeypatch):
    """One row a frame, from no row of all frames of a run."""
    monkeypatch.setattr(longruns, "FAN", 3)
    rnd = random.Random(5)
    places = [f"{lead}t{k}.py:{k}: in f" for k in range(3) for lead in ("", "./", ".\\")]
    parts = [(run, at * 10, "\n".join(rnd.choice(LINES + places) for _ in range(rnd.randint(0, 30))) + "\n") for run in range(4) for at in range(20)]
    df = spark.createDataFrame([*parts, (9, 0, None)], "run_id long, at long, text string")
    want = sorted(map(tuple, unique_frames(longruns.parse_parts(df, 10)).collect()), key=str)
    monkeypatch.setattr(longruns, "report", None)
    assert sorted(map(tuple, longruns.frames_of_parts(df, 10).collect()), key=str) == want and len(want) > 50
    assert longruns.frames_of_parts(df.limit(0), 10).count() == 0


def test_few_machines(monkeypatch):
    """Modes on which no line depends make no machines of their own."""
    text = 'plain\nTraceback (most recent call last):\n  File "a.py", line 2, in f\n    go()\nKeyError: 1\n' * 20
    made = []
    monkeypatch.setattr(longruns, "compose", lambda a, b, real=longruns.compose: made.append(1) or real(a, b))
    monkeypatch.setattr(longruns, "Trace", lambda real=longruns.Trace: made.append(1) or real())
    longruns.effects_of(text)
    assert len(made) < 100
