"""Resolution, ranking, selection and scalar functions on small fixtures."""

import random

from pyspark.sql import functions as F

from faultline.functions import scalars
from faultline.operators import ancestors, select
from faultline.operators.parse import parse_runs
from faultline.operators.rank import failing_tests, imported, manifests, named_modules
from faultline.operators.resolve import SKIPPED, file_index, resolve, sizes, tail_index
from faultline.plans import packet

FILES = "repo_id string, rel string, size_bytes long, content string"
FRAMES = "repo_id string, cwd string, root string, path string, path_hint string, vendored boolean"
RUNS = "run_id long, repo_id string, command array<string>, exit_code int, stdout string, stderr string, cwd string, root string"


def repo(spark, files):
    return spark.createDataFrame([("r", rel, len(text), text) for rel, text in files.items()], FILES)


def test_resolve(spark):
    names = ["app/main.py", "main.py", "web/app/main.py", "shop/cart/cart.go", "vendor/cart/cart.go", "other/cart.go", "a/com/x/P.java", "b/com/y/P.java", "build/gen.py", "tests/util_test.go", "cart/util_test.go", "solo.rs"]
    asked = {
        ("app/main.py", None, False, ""): ("direct", "app/main.py"),
        ("main.py", None, False, "app"): ("direct", "app/main.py"),
        ("main.py", None, False, "tests"): ("direct", "main.py"),
        ("app/../app/./main.py", None, False, ""): ("direct", "app/main.py"),
        ("../main.py", None, False, "app"): ("direct", "main.py"),
        ("../../main.py", None, False, "app"): ("ambiguous", None),
        ("/home/u/r/main.py", None, False, "app"): ("direct", "main.py"),
        ("/home/u/r/x/../app/main.py", None, False, ""): ("direct", "app/main.py"),
        ("/home/u/rest/web/app/main.py", None, False, ""): ("suffix", "web/app/main.py"),
        ("/build/shop/cart/cart.go", None, False, ""): ("suffix", "shop/cart/cart.go"),
        ("P.java", "com/y/P.java", False, ""): ("suffix", "b/com/y/P.java"),
        ("P.java", None, False, ""): ("ambiguous", None),
        ("q/site-packages/solo.rs", None, False, ""): ("vendored", None),
        ("solo.rs", None, True, "x"): ("direct", "solo.rs"),
        ("x/solo.rs", None, True, ""): ("vendored", None),
        ("/etc/solo.rs", None, False, ""): ("outside-repo", None),
        ("C:\\x\\solo.rs", None, False, ""): ("suffix", "solo.rs"),
        ("build/gen.py", None, False, ""): ("unresolved", None),
        ("util_test.go", None, False, ""): ("ambiguous", None),
    }
    frames = spark.createDataFrame([("r", cwd, "/home/u/r", p, h, v) for p, h, v, cwd in asked], FRAMES)
    host = spark.createDataFrame([("/etc/solo.rs",)], "path string")
    got = {(x.path, x.path_hint, x.vendored, x.cwd): (x.how, x.resolved, x.candidates) for x in resolve(frames, repo(spark, dict.fromkeys(names, "x")), host).collect()}
    assert {k: v[:2] for k, v in got.items()} == asked
    assert got["util_test.go", None, False, ""][2] == ["cart/util_test.go", "tests/util_test.go"]


def walk(files, skipped):
    """Paths in the order of a sorted walk, on a real tree of dictionaries."""
    tree = {}
    for f in files:
        *dirs, name = f.split("/")
        at = tree
        for d in dirs:
            at = at.setdefault(d, {})
        at[name] = None

    def go(at, base):
        yield from (base + n for n in sorted(n for n, x in at.items() if x is None))
        for d in sorted(d for d, x in at.items() if x is not None and d not in skipped):
            yield from go(at[d], f"{base}{d}/")

    return list(go(tree, ""))


def test_index_in_walk_order(spark):
    rnd = random.Random(8)
    names = ["a", "a b", "a-b", "a.b", "B", "é", "z", "build", ".git"]
    files = sorted({"/".join([*(rnd.choice(names) for _ in range(rnd.randint(0, 3))), f"{rnd.choice(names)}{rnd.randint(0, 4)}.py"]) for _ in range(300)})
    order = walk(files, SKIPPED)
    held = repo(spark, dict.fromkeys(files, "x")).unionByName(spark.createDataFrame([("small", "q.py", 1, "x")], FILES))
    for cap in (1, 50, len(order) - 1, len(order)):
        assert sorted(x.rel for x in file_index(held, cap).where("repo_id = 'r'").collect()) == sorted(order[:cap])
        assert {x.repo_id: (x.n_files, x.truncated) for x in sizes(held, cap).collect()} == {"r": (len(order), cap < len(order)), "small": (1, False)}
    assert file_index(held, 1).where("repo_id = 'small'").count() == 1


def test_many_files_of_one_name(spark):
    """20,000 namesakes: the index holds each tail once, and a path meets a row for each of its own tails only."""
    n = 20_000
    files = spark.range(n).select(F.lit("r").alias("repo_id"), F.format_string("p%d/m%d/__init__.py", F.col("id"), F.col("id") % 100).alias("rel"), F.lit(1).cast("long").alias("size_bytes"), F.lit("x").alias("content"))
    asked = [(f"/elsewhere/p{k}/m{k % 100}/__init__.py", "suffix") for k in range(0, n, 2000)] + [("/x/m7/__init__.py", "ambiguous"), ("/x/y/__init__.py", "ambiguous"), ("/x/none.py", "unresolved")]
    frames = spark.createDataFrame([("r", "", None, p, None, False) for p, _ in asked], FRAMES)
    found = {x.path: x for x in resolve(frames, files).collect()}
    assert {p: x.how for p, x in found.items()} == dict(asked)
    assert found["/elsewhere/p2000/m0/__init__.py"].resolved == "p2000/m0/__init__.py"
    assert len(found["/x/m7/__init__.py"].candidates) == 200 and len(found["/x/y/__init__.py"].candidates) == n
    index = tail_index(file_index(files))
    assert index.count() == n + 100 + 1 and index.agg(F.max("n")).first()[0] == n


def test_imports_and_manifests(spark):
    files = {
        "app/main.py": "import app.lib, os\nfrom pkg import x\n", "app/lib.py": "x", "src/pkg/__init__.py": "x", "app/w.pyw": "import app.lib\n", "app/t.pyi": "import app.lib\n", "app/r.py": "import os as o, app.lib\nfrom app.lib import(x)\nimport pkg , app.w\n",
        "web/a.ts": 'import x from "./foo.js"\nconst y = require( "../lib/b")\nimport("./c")\nrequire "./c"\nimport * as q from "./foo.js"\nexport * from \'./dir\'\nlet z = "./c"', "web/foo.ts": "x", "lib/b.jsx": "x", "web/dir/index.mjs": "x", "web/c.js": "x",
        "p/a_test.go": "x", "p/a.go": "x", "p/b_test.go": "x", "p/sub/c.go": "x", "pyproject.toml": "x", "app/pyproject.toml": "x", "go.mod": "x", "other/package.json": "x",
    }
    held = repo(spark, files)
    got = {(x.source, x.target) for x in imported(held, held).collect()}
    assert got == {("app/main.py", "app/lib.py"), ("app/main.py", "src/pkg/__init__.py"), ("app/w.pyw", "app/lib.py"), ("app/r.py", "src/pkg/__init__.py"), ("web/a.ts", "web/foo.ts"), ("web/a.ts", "lib/b.jsx"), ("web/a.ts", "web/dir/index.mjs"), ("p/a_test.go", "p/a.go"), ("p/b_test.go", "p/a.go")}
    runs = spark.createDataFrame([(1, "r", ["x"], 1, "", "", "app/deep", None)], RUNS)
    assert {x.rel for x in manifests(runs, held).collect()} == {"app/pyproject.toml", "go.mod"}


def test_modules_by_content(spark):
    """A text that many repositories hold is read once, and one that is known not at all."""
    rows = [(f"r{n}", rel, len(text), text) for n in range(20) for rel, text in {"a.py": "import lib\n", "copy.py": "import lib\n", "lib.py": f"x = {n % 2}\n", "web/a.js": "import './b'\n", "web/b.js": "y"}.items()]
    files = spark.createDataFrame(rows, FILES)
    modules = named_modules(files)
    assert sorted((r.kind, r.names) for r in modules.collect()) == [("js", []), ("js", ["./b"]), ("py", []), ("py", []), ("py", ["lib"])]
    want = {(f"r{n}", s, t) for n in range(20) for s, t in (("a.py", "lib.py"), ("copy.py", "lib.py"), ("web/a.js", "web/b.js"))}
    assert {tuple(x) for x in imported(files, files).collect()} == {tuple(x) for x in imported(files, files, modules).collect()} == want
    told = modules.withColumn("names", F.when(F.col("kind") == "py", F.array(F.lit("copy"))).otherwise(F.col("names")))
    got = {(x.source, x.target) for x in imported(files, files, told).collect()}
    assert got == {("a.py", "copy.py"), ("lib.py", "copy.py"), ("web/a.js", "web/b.js")}
    assert sorted(x.kind for x in named_modules(files, modules.where("kind = 'js'")).collect()) == ["js", "js", "py", "py", "py"]


def test_failing_tests_and_build(spark):
    files = {"pkg/tests/test_a.py": "def test(): pass\n" * 40, "tests/SpecB.java": "x", "tests/test_c.jsx": "x", "lib.py": "x\n", "changed.py": "y\n"}
    out = "FAILED tests/test_a.py::test_x\n" + 'Traceback (most recent call last):\n  File "/repo/lib.py", line 1, in f\nKeyError: 1'
    runs = spark.createDataFrame([(1, "r", ["go", "tests/SpecB.java::z", "tests/test_c.jsx", "missing_test.py"], 1, out, None, None, "/repo"), (2, "r", [], 3, None, None, None, None)], RUNS)
    held = repo(spark, files)
    assert {x.rel for x in failing_tests(parse_runs(runs), runs, held).collect()} == {"pkg/tests/test_a.py", "tests/SpecB.java"}
    changed = spark.createDataFrame([(1, "changed.py"), (1, "lib.py")], "run_id long, rel string")
    git = spark.createDataFrame([(1, "/repo", "main", "abc", " M lib.py", "-a\n+b", ["lib.py"])], "run_id long, root string, branch string, commit string, status string, diff string, diff_names array<string>")
    env = spark.createDataFrame([(1, "3.13", None, "linux", "x", {"HOME": "h", "API_KEY": "k"})], "run_id long, python string, node string, platform string, machine string, env map<string,string>")
    built = packet.build(runs, held, changed, git, env, created_at=F.timestamp_seconds(F.lit(0)))
    assert {(x.run_id, x.rel, x["rank"]) for x in built["ranked"].collect()} == {(1, "lib.py", 1), (1, "pkg/tests/test_a.py", 2), (1, "tests/SpecB.java", 2), (1, "changed.py", 4)}
    rows = {x.run_id: x for x in built["packets"].collect()}
    assert rows[1].failure == "KeyError: 1" and "lib.py:1 in f" in rows[1].markdown and '"created_at":"1970-01-01T00:00:00+00:00"' in rows[1].json
    assert "HOME" in rows[1].markdown and "API_KEY" not in rows[1].markdown + rows[1].json and "+b" in rows[1].markdown
    assert "Exit code 3" in rows[2].markdown and rows[2].failure is None


def test_reasons(spark):
    row = spark.range(1).select(*[F.element_at(scalars.literal_map(scalars.REASONS), k).alias(f"r{k}") for k in range(1, 6)]).first()
    assert list(row) == ["stack trace", "failing test", "imported by, or in the same package as, a relevant file", "in git diff", "dependency manifest"]


def test_ancestors(spark):
    roots = spark.createDataFrame([("/home/u/r/",), ("/home/u/r/sub",), ("/srv",), (None,)], "path string")
    asked = {"/home/u/r": ("/home/u/r", True), "/home/u/r/sub/deep/er": ("/home/u/r/sub", True), "/home/u/rest": ("/home/u/rest", False), "/home/u/r/a/./b/": ("/home/u/r", True), "/srv/x": ("/srv", True), "/": ("/", False), None: (None, False)}
    runs = spark.createDataFrame([(k, c, "old") for k, c in enumerate(asked)], "run_id long, cwd string, root string")
    found = ancestors.with_root(runs, roots)
    assert {r.cwd: (r.root, r.in_repo) for r in found.collect()} == asked
    packets = spark.createDataFrame([("/home/u/r", 1, "old"), ("/home/u/r/", 2, "new"), ("/srv/x", 1, "here"), ("/srv", 9, "above")], "dir string, created_at long, markdown string")
    got = {r.cwd: (r.found_in, r.markdown) for r in ancestors.latest_packet(found, packets).collect()}
    assert got == {"/home/u/r": ("cwd", "new"), "/home/u/r/a/./b/": ("root", "new"), "/srv/x": ("cwd", "here"), "/home/u/r/sub/deep/er": (None, None), "/home/u/rest": (None, None), "/": (None, None), None: (None, None)}
    assert ancestors.with_root(runs.limit(0), roots).count() == 0


def brute_window(text, refs, context=30):
    """Every kept line, one by one."""
    rows = text.splitlines()
    kept = sorted({i for r in refs for i in range(max(1, r - context), min(len(rows), r + context) + 1)})
    return text if not refs else "\n".join(("...\n" if k and kept[k - 1] < i - 1 else "") + rows[i - 1] for k, i in enumerate(kept))


def test_trim_and_budget(spark):
    rnd = random.Random(2)
    ragged = "\n".join("x" * (n % 7) for n in range(1, 201)) + "\n\n"
    texts = ["\n".join(f"l{n}" for n in range(1, 201)), ragged, "a\r\nb\x0bc\u2028d", "", "\n", "é\U0001d4b3\n" * 90]
    cases = [(t, refs) for t in texts for refs in ([100], [1, 200], [220], [231], [400], [], [5, 70, 71, 190], [61, 122, 30, 30], *([rnd.randint(1, 260) for _ in range(6)] for _ in range(5)))]
    df = spark.createDataFrame([("r", str(k), t, refs) for k, (t, refs) in enumerate(cases)], "repo_id string, rel string, content string, refs array<int>")
    ends = select.line_index(df).select(F.col("rel").alias("e_rel"), "ends", "chars")
    cut = df.join(ends, F.col("rel") == F.col("e_rel")).withColumn("cuts", select.spans(F.col("refs"), F.col("ends")))
    rows = cut.select("rel", select.windowed(F.col("content"), F.col("cuts")).alias("w"), select.window_length(F.col("cuts"), F.col("chars")).alias("n"), select.trim(F.col("content"), F.col("cuts"), F.lit(5_000)).alias("t")).collect()
    assert len(rows) == len(cases)
    for r in rows:
        want = brute_window(*cases[int(r.rel)])
        assert (r.w, r.n, r.t) == (want, len(want), want + select.TRAILER), cases[int(r.rel)]
    files = spark.createDataFrame([([(100, 400), (6750, 27_000), (500, 2_000)],)], "files array<struct<cost: long, window: long>>")
    fate = files.select(select.fold_budget(F.col("files"), 450).alias("f")).first().f
    assert [x.state for x in fate] == ["whole", "trim", "omit"] and [x.room for x in fate] == [450, 350, 16]
    assert select.clamp(450) == 500


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.fence(F.lit("x/Run.SH")).alias("sh"), scalars.fence(F.lit("a.md")).alias("md"), scalars.shell_join(F.array(F.lit("a"), F.lit("b c"), F.lit("it's"), F.lit(""))).alias("cmd"),
        scalars.tokens(F.lit("abcde")).alias("n"), scalars.report(F.lit(8412), F.lit(312004)).alias("report"), scalars.reduction_percent(F.lit(9), F.lit(0)).alias("zero"),
        scalars.changed_files(F.array(F.lit("b")), F.lit(' M a.py\n?? "c d"\n')).alias("changed"), scalars.capped(F.lit("abcdef"), 3, "~").alias("cap"),
        scalars.tidy(scalars.parts(F.lit("a/./b/../c"))).alias("tidy"), scalars.tidy(scalars.parts(F.lit("a/../../c"))).alias("out"),
        scalars.safe_names(F.create_map(*map(F.lit, ("PATH", "1", "MY_TOKEN", "2", "LANG", "3")))).alias("names"), scalars.utc_second(F.timestamp_seconds(F.lit(61))).alias("ts"), scalars.some(F.array(*map(F.lit, "abc")), 2).alias("some"),
    ).first()
    assert (row.sh, row.md, row.cmd, row.n) == ("bash", "", "a 'b c' 'it'\"'\"'s' ''", 2)
    assert "97.3%" in row.report and "312,004" in row.report and row.zero == 0
    assert (row.changed, row.cap, row.tidy, row.out, row.names) == (["a.py", "b", "c d"], "abc~", "a/c", None, ["LANG", "PATH"])
    assert (row.ts, row.some) == ("1970-01-01T00:01:01+00:00", "a, b, and 1 more")


def test_texts_are_cut_into_lines_once(spark):
    """A file's line breaks are made even before its text meets the runs that show it."""
    text = "".join(f"line {n}\r\n" for n in range(400))
    repo = spark.createDataFrame([("r", "a.py", text), ("r", "b.py", text)], "repo_id string, rel string, content string")
    chosen = "run_id long, q_repo string, pos int, rel string, rank int, cost long, reason string, cuts array<struct<start: long, size: long>>, window long, state string, room long"
    rows = [(n, "r", 0, "a.py", 1, 900, "stack trace", [(7 * n, 60), (900, 40)] if n % 2 else None, 10, ("trim", "whole", "omit")[n % 3], 320 + n) for n in range(12)]
    held = spark.createDataFrame(rows, chosen)
    files = select.with_texts(held, repo)
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "split(" not in plan[: plan.index("Join")]
    old = held.join(repo, (F.col("q_repo") == F.col("repo_id")) & (repo["rel"] == held["rel"]))
    want = F.when(F.col("state") == "whole", F.col("content")).when(F.col("state") == "trim", select.trim(F.col("content"), F.col("cuts"), F.col("room")))
    assert {r.run_id: r.content for r in files.collect()} == {r.run_id: r.c for r in old.select("run_id", want.alias("c")).collect()}
