"""Whole packets: the JSON document field by field, and what the Markdown shows."""

import json

import pytest
from pyspark.sql import functions as F

from faultline.plans import packet

FILES = "repo_id string, rel string, size_bytes long, content string"
RUNS = "run_id long, repo_id string, command array<string>, exit_code int, stdout string, stderr string, cwd string, root string"
GIT = "run_id long, root string, branch string, commit string, status string, diff string, diff_names array<string>"
ENV = "run_id long, python string, node string, platform string, machine string, env map<string,string>"

CHAIN = """Traceback (most recent call last):
  File "app/db.py", line 2, in read
    raise
KeyError: 'user'

The above exception was the direct cause of the following exception:

Traceback (most recent call last):
  File "/repo/app/main.py", line 3, in main
    go()
  File "/usr/lib/python3/site-packages/x/y.py", line 9, in z
    h()
RuntimeError: no user
"""
CONTEXT = CHAIN.replace("The above exception was the direct cause of the following exception", "During handling of the above exception, another exception occurred")
BUILD = "# shop\ncart/cart.go:4:2: undefined: Total\n./main.go:7:1: missing return\n"
JVM = 'Exception in thread "main" a.b.OuterException: top\n\tat a.b.Shop.main(Shop.java:5)\nCaused by: a.b.InnerError: deep\n\tat a.b.Cart.add(Cart.java:7)\n\tat java.util.Map.get(Map.java:1)\n\t... 1 more\n'
NAMESAKES = "  File \"lost.py\", line 1, in f\n"


@pytest.fixture(scope="module")
def built(spark):
    files = {
        "app/db.py": "import os\n\ndef read():\n    pass\n", "app/main.py": "import app.db\nimport util\n", "util.py": "x\n", "tests/test_app.py": "t\n" * 3, "pyproject.toml": "[p]\n", "README.md": "r" * 401,
        "cart/cart.go": "package cart\n", "cart/more.go": "package cart\n", "cart/cart_test.go": "package cart\n", "main.go": "package main\n", "j/a/b/Shop.java": "class Shop\n", "j/a/b/Cart.java": "class Cart\n",
        "p/lost.py": "1\n", "q/lost.py": "2\n", "big.py": "line of text\n" * 3000, "huge.py": "line of text\n" * 3000,
    }
    held = spark.createDataFrame([("r", rel, len(text), text) for rel, text in files.items()], FILES)
    rows = [
        (1, ["pytest", "tests/test_app.py::test_it", "-k", "a b"], CHAIN + "FAILED tests/test_app.py::test_it - RuntimeError\n", "warn\n"),
        (2, ["run"], CONTEXT, ""),
        (3, ["go", "build"], "", BUILD),
        (4, ["java", "Shop"], JVM, None),
        (5, ["py"], "Traceback (most recent call last):\n" + NAMESAKES + "ValueError: x\n", ""),
        (6, ["py"], 'Traceback (most recent call last):\n  File "big.py", line 1500, in f\n  File "huge.py", line 1, in g\nValueError: big\n', ""),
        (7, ["true"], "x" * 20_001, ""),
    ]
    runs = spark.createDataFrame([(n, "r", c, n, out, err, "", "/repo") for n, c, out, err in rows], RUNS)
    git = spark.createDataFrame([(1, "/repo", "main", "abc1234", " M app/db.py\n?? new file.txt", "-a\n+b", ["app/db.py", "util.py"]), (2, "/repo", None, None, "", "d" * 20_001, [])], GIT)
    env = spark.createDataFrame([(1, "3.13.1", "v20", "linux", "x86_64", {"HOME": "/h", "AWS_ACCESS": "s3cret", "lang": "C"})], ENV)
    changed = spark.createDataFrame([(1, "util.py"), (1, "new file.txt")], "run_id long, rel string")
    out = packet.build(runs, held, changed, git, env, created_at=F.timestamp_seconds(F.lit(1_700_000_000)))
    return {r.run_id: (json.loads(r.json), r.markdown, r) for r in out["packets"].collect()}


def frame(path, line, function, language, resolved, how, vendored=False):
    return {"path": path, "line": line, "function": function, "language": language, "vendored": vendored, "resolved": resolved, "resolution": how}


def file(path, rank, reason, tokens, trimmed=False, included=True):
    return {"path": path, "rank": rank, "reason": reason, "included": included, "trimmed": trimmed, "tokens_estimated": tokens}


def test_every_field(built):
    document, markdown, row = built[1]
    stats = document.pop("token_stats")
    assert document == {
        "packet_version": "0.1", "created_at": "2023-11-14T22:13:20+00:00", "command": ["pytest", "tests/test_app.py::test_it", "-k", "a b"], "exit_code": 1, "failure": "KeyError: 'user'", "root_cause": "KeyError: 'user'",
        "cause_chain": ["RuntimeError: no user", "KeyError: 'user'"], "diagnostics": [], "failed_tests": ["tests/test_app.py::test_it"],
        "stack": [frame("app/db.py", 2, "read", "python", "app/db.py", "direct"), frame("/repo/app/main.py", 3, "main", "python", "app/main.py", "direct"), frame("/usr/lib/python3/site-packages/x/y.py", 9, "z", "python", None, "vendored")],
        "files": [
            file("app/db.py", 1, "stack trace", 8), file("app/main.py", 1, "stack trace", 7), file("tests/test_app.py", 2, "failing test", 2),
            file("util.py", 3, "imported by, or in the same package as, a relevant file", 1), file("pyproject.toml", 5, "dependency manifest", 1),
        ],
        "git": {"root": "/repo", "branch": "main", "commit": "abc1234", "status": " M app/db.py\n?? new file.txt", "diff": "-a\n+b", "diff_truncated": False, "changed_files": ["app/db.py", "new file.txt", "util.py"]},
        "environment": {"python": "3.13.1", "platform": "linux", "machine": "x86_64", "env_var_names": ["HOME", "lang"], "node": "v20"},
        "stdout": CHAIN + "FAILED tests/test_app.py::test_it - RuntimeError\n", "stderr": "warn\n",
    }
    assert stats["packet_tokens_estimated"] == (len(markdown) + 3) // 4 == row.packet_tokens
    assert stats["repository_source_tokens_estimated"] == row.repo_tokens
    assert stats["context_reduction_percent"] == round(max(0, (1 - row.packet_tokens / row.repo_tokens) * 100), 1)
    assert "estimates" in stats["note"] and len(stats) == 4
    assert "s3cret" not in markdown and "AWS_ACCESS" not in markdown and "'a b'" in markdown


def test_chains_and_builds(built):
    two, text, _ = built[2]
    assert (two["failure"], two["root_cause"], two["cause_chain"]) == ("RuntimeError: no user", None, [])
    assert text.index("app/main.py:3 in main") < text.index("app/db.py:2 in read") and "RuntimeError: no user:" in text
    assert (two["git"]["branch"], two["git"]["commit"], two["git"]["diff_truncated"]) == ("(no commits yet)", "(no commits yet)", True) and len(two["git"]["diff"]) < 20_100
    three, text, _ = built[3]
    assert three["diagnostics"] == ["undefined: Total", "missing return"] and three["failure"] == "undefined: Total" and three["git"] is None and three["environment"] is None
    assert [(f["path"], f["rank"], f["reason"]) for f in three["files"]] == [("cart/cart.go", 1, "compiler diagnostic"), ("main.go", 1, "compiler diagnostic"), ("cart/more.go", 3, "imported by, or in the same package as, a relevant file"), ("pyproject.toml", 5, "dependency manifest")]
    assert "## Reported locations" in text and "## Relevant stack" not in text
    four, text, _ = built[4]
    assert four["cause_chain"] == ["a.b.OuterException: top", "a.b.InnerError: deep"] and four["root_cause"] == "a.b.InnerError: deep"
    assert [(s["resolved"], s["resolution"]) for s in four["stack"]] == [("j/a/b/Shop.java", "suffix"), ("j/a/b/Cart.java", "suffix"), (None, "vendored")]
    assert text.index("Cart.java:7") < text.index("Shop.java:5")  # the cause on top


def test_what_is_left_out(built):
    five, text, _ = built[5]
    assert five["stack"] == [frame("lost.py", 1, "f", "python", None, "ambiguous")] and "p/lost.py, q/lost.py" in text and [f["path"] for f in five["files"]] == ["pyproject.toml"]
    six, text, _ = built[6]
    assert {f["path"]: (f["included"], f["trimmed"]) for f in six["files"]} == {"big.py": (True, True), "huge.py": (True, True), "pyproject.toml": (True, False)}
    assert "... [trimmed]" in text and max(f["tokens_estimated"] for f in six["files"]) < 300
    seven, text, _ = built[7]
    assert seven["failure"] is None and "Exit code 7" in text and seven["stdout"].endswith("truncated]") and len(seven["stdout"]) < 20_100 and seven["stack"] == []


def test_end_of_text(spark):
    """Line feeds at a text's end go without a pattern over all of it; what other line breaks did to that stays."""
    from faultline.operators import render

    texts = ["", "a", "a\n\n", "\n", "a\nb\n", "a\n\r", "a\r\n", "a\n\r\n", "a\n ", "a\n\u0085\n", "a \n", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(render._without_end(F.col("t")).alias("new"), F.regexp_replace("t", "\n+$", "").alias("old"))
    assert all(r.new == r.old for r in d.collect())


def test_documents_without_texts(spark):
    """The JSON document tells the Markdown's length without any file's text being read for it, whatever the texts end in."""
    ends = ["", "\n\n\n", "\r\n\r\n", "\n\u0085\n", "\n\u2028\n"]
    long = "".join(f"line {n}\r\n" for n in range(900))
    files = {f"e{k}.py": f"x{k}\ny" + e for k, e in enumerate(ends)} | {"m.py": long + "\n\n", "n.py": long, "o.py": long, "go/a.go": "a\n", "go/b.go": "b\n\n", "go/c.go": "c"}
    held = spark.createDataFrame([("r", rel, len(text.encode()), text) for rel, text in files.items()], FILES)
    trace = "Traceback (most recent call last):\n{}ValueError: x\n"
    at = lambda *places: trace.format("".join(f'  File "{p}", line {n}, in f\n' for p, n in places))
    outs = [at(*((f"e{k}.py", 1) for k in range(len(ends)))), at(("m.py", 1), ("m.py", 700), ("n.py", 5000), ("o.py", 450)), "# go\ngo/a.go:1:2: undefined: X\ngo/c.go:1:2: undefined: Y\n", "fine\n"]
    runs = spark.createDataFrame([(n, "r", ["x"], 1, out, "", "", "/repo") for n, out in enumerate(outs)], RUNS)
    changed = spark.createDataFrame([(2, "go/b.go"), (3, "n.py")], "run_id long, rel string")
    built = packet.build(runs, held, changed, budget=2_000, created_at=F.timestamp_seconds(F.lit(0)))
    plan = lambda *names: built["packets"].select(*names)._jdf.queryExecution().optimizedPlan().toString()
    assert " AS texts" in plan("markdown") and " AS texts" not in plan("json", "packet_tokens")
    rows = {r.run_id: r for r in built["packets"].collect()}
    assert len(rows) == 4 and {n: r.packet_tokens for n, r in rows.items()} == {n: (len(r.markdown) + 3) // 4 for n, r in rows.items()}
    told = {n: [(f["path"], f["rank"], f["included"], f["trimmed"]) for f in json.loads(r.json)["files"]] for n, r in rows.items()}
    assert told[0] == [(f"e{k}.py", 1, True, False) for k in range(len(ends))] and told[2] == [("go/a.go", 1, True, False), ("go/c.go", 1, True, False), ("go/b.go", 3, True, False)]
    assert told[1] == [("m.py", 1, True, True), ("n.py", 1, True, True), ("o.py", 1, True, True)] and told[3] == [("n.py", 4, True, True)]
    texts = {(r.run_id, r.rel): r.tokens for r in built["files"].collect()}
    assert {(n, f["path"]): f["tokens_estimated"] for n, r in rows.items() for f in json.loads(r.json)["files"]} == texts
