"""Synthetic captured runs, made from `events` with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalars import changed_files

#: Output templates by dialect; {e} is the event, {u} the user, {l} a line, {f} a file number.
TEMPLATES = {
    0: "collecting\nTraceback (most recent call last):\n  File \"app/main{f}.py\", line {l}, in main\n    go()\n  File \"app/lib{f}.py\", line {u}, in go{f}\n    raise\nKeyError: 'k{e}'\ndone",
    1: "============\n____ test_case_{e} ____\napp/main{f}.py:{l}: in test_case_{e}\nE   AssertionError: assert {u} == {l}\ntests/test_{f}.py:{u}: AssertionError\nFAILED tests/test_{f}.py::test_case_{e} - assert",
    2: "starting\nTypeError: bad value {e}\n    at run{f} (/srv/app/lib{f}.js:{l}:7)\n    at /srv/app/main{f}.js:{u}:3\n    at node:internal/main:1:1\nexit",
    3: "running\nthread 'main' panicked at src/lib{f}.rs:{l}:5:\nmissing key {e}\nstack backtrace:\n   0: core::panicking::panic\n             at /rustc/abc/library/core/src/rustlib/x.rs:9:5\n   1: shop::go{f}\n             at ./src/main{f}.rs:{u}:9\nnote: run with",
    4: "panic: index {e} out of range\n\ngoroutine 1 [running]:\nexample.com/shop/cart.Go{f}(0x1)\n\t/build/cart/lib{f}.go:{l} +0x1d\nmain.main()\n\t/build/main{f}.go:{u} +0x2\n\nexit status 2",
    5: "Exception in thread \"main\" java.lang.IllegalStateException: outer {e}\n\tat com.example.shop.Main{f}.main(Main{f}.java:{l})\nCaused by: java.lang.NullPointerException: inner {e}\n\tat com.example.shop.Lib{f}.go(Lib{f}.java:{u})\n\tat java.base/java.util.Map.get(Map.java:1)\n\t... 1 more",
    6: "warning: unused\n --> src/skip.rs:1:1\nerror[E0308]: mismatched types {e}\n  --> src/main{f}.rs:{l}:9\n   |\n{l} |     go()\n   |        ^^^^ expected u{u}\n  ::: src/lib{f}.rs:{u}:1\nerror: could not compile `shop`",
    7: "Traceback (most recent call last):\n  File \"app/lib{f}.py\", line {u}, in go{f}\n    raise\nKeyError: 'k{e}'\n\nThe above exception was the direct cause of the following exception:\n\nTraceback (most recent call last):\n  File \"app/main{f}.py\", line {l}, in main\n    go()\nRuntimeError: outer {e}",
    8: "Traceback (most recent call last):\n  File \"app/lib{f}.py\", line {u}, in go{f}\n    raise\nKeyError: 'k{e}'\n\nDuring handling of the above exception, another exception occurred:\n\nTraceback (most recent call last):\n  File \"app/main{f}.py\", line {l}, in main\n    go()\nRuntimeError: outer {e}",
    9: "# shop/cart\ncart/lib{f}.go:{l}:4: undefined: x{e}\n./main{f}.go:{u}:2: missing return",
    10: "java/com/example/shop/Main{f}.java:{l}: error: cannot find symbol {e}\n    x\n    ^\n1 error",
    11: "--- FAIL: TestShop{e} (0.00s)\n    lib{f}_test.go:{l}: got {u}\nFAIL",
    12: "thread 'main' panicked at 'missing key {e}', src/lib{f}.rs:{l}:5\nnote: run with `RUST_BACKTRACE=1`",
}
FILES = 50


def runs(events: DataFrame) -> DataFrame:
    """run_id, dialect, repo_id, command, exit_code, stdout, stderr, cwd: a run per error event."""
    e = events.where("event_type = 'error'").select(
        "event_id", "user_id", (F.col("event_id") % len(TEMPLATES)).cast("int").alias("dialect"), (F.col("event_id") % 400 + 1).alias("l"), (F.col("user_id") % 900 + 500).alias("u"), (F.col("event_id") % FILES).alias("f")
    )
    text = F.lit(None).cast("string")
    for k, template in TEMPLATES.items():
        made = F.lit(template)
        for mark, column in (("{e}", "event_id"), ("{u}", "u"), ("{l}", "l"), ("{f}", "f")):
            made = F.replace(made, F.lit(mark), F.col(column).cast("string"))
        text = F.when(F.col("dialect") == k, made).otherwise(text)
    return e.select(
        F.col("event_id").alias("run_id"), "dialect", F.lit("shop").alias("repo_id"), F.array(F.lit("run"), F.concat(F.lit("tests/test_"), "f", F.lit(".py::x"))).alias("command"),
        F.lit(1).alias("exit_code"), text.alias("stdout"), F.lit("").alias("stderr"), F.lit("").alias("cwd"), "l", "u", "f", "user_id",
    )


def repo_files(spark) -> DataFrame:
    """The repository that the runs speak of: repo_id, rel, size_bytes, content."""
    n = spark.range(FILES).withColumnRenamed("id", "n")
    names = F.array(*[F.concat(F.lit(a), F.col("n").cast("string"), F.lit(b)) for a, b in [("app/main", ".py"), ("app/lib", ".py"), ("tests/test_", ".py"), ("web/lib", ".js"), ("web/main", ".js"), ("src/lib", ".rs"), ("src/main", ".rs"), ("cart/lib", ".go"), ("main", ".go"), ("java/com/example/shop/Main", ".java"), ("java/com/example/shop/Lib", ".java"), ("old/lib", ".js"), ("cart/lib", "_test.go")]])
    files = n.select("n", F.explode(names).alias("rel")).where("not (rel like 'old/%' and n % 5 <> 0)")
    imports = F.when(F.col("rel").like("app/main%"), F.concat(F.lit("import app.lib"), F.col("n").cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    content = F.concat(imports, F.repeat(F.concat(F.lit("line of "), F.col("rel"), F.lit("\n")), (20 + F.col("n") * 40).cast("int")))
    base = files.select(F.lit("shop").alias("repo_id"), "rel", content.alias("content"))
    manifest = spark.range(1).select(F.lit("shop").alias("repo_id"), F.lit("pyproject.toml").alias("rel"), F.lit("[project]\n").alias("content"))
    return base.unionByName(manifest).withColumn("size_bytes", F.octet_length("content").cast("long"))


def git_states(runs: DataFrame) -> DataFrame:
    """What git said at each run: a fourth of them had a changed file."""
    dirty = F.col("run_id") % 4 == 0
    lib = F.concat(F.lit("app/lib"), "f", F.lit(".py"))
    return runs.select(
        "run_id", F.lit("/repo").alias("root"), F.when(F.col("run_id") % 5 > 0, F.concat(F.lit("topic"), "f")).alias("branch"), F.substring(F.sha1(F.col("run_id").cast("string")), 1, 7).alias("commit"),
        F.when(dirty, F.concat(F.lit(" M "), lib, F.lit("\n?? notes "), "f", F.lit(".txt"))).otherwise("").alias("status"),
        F.when(dirty, F.concat(F.lit("-old "), "run_id", F.lit("\n+new "), "run_id")).otherwise("").alias("diff"), F.when(dirty, F.array(lib)).otherwise(F.array().cast("array<string>")).alias("diff_names"),
    )


def changed(git: DataFrame) -> DataFrame:
    """run_id, rel: the files that git named."""
    return git.select("run_id", F.explode(changed_files(F.col("diff_names"), F.col("status"))).alias("rel"))


def environments(runs: DataFrame) -> DataFrame:
    env = F.create_map(*map(F.lit, ("PATH", "/bin", "API_TOKEN", "t0ken", "LANG", "C", "my_secret_x", "hidden")))
    return runs.select("run_id", F.concat(F.lit("3."), F.col("f") % 4 + 10).alias("python"), F.when(F.col("f") % 2 == 0, "v20").alias("node"), F.lit("linux").alias("platform"), F.lit("x86_64").alias("machine"), F.when(F.col("f") % 3 == 0, F.map_concat(env, F.create_map(F.concat(F.lit("F"), "f"), F.lit("1")))).otherwise(env).alias("env"))
