"""Files by relevance: 1 in a stack, 2 failing test, 3 imported, 4 changed, 5 manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalars import REASONS, let, literal_map, parts, tidy
from faultline.operators.parse import JS_EXTENSIONS
from faultline.operators.resolve import resolve, skipped_dir
from faultline.sources.staging import staged, weighed

#: Manifests looked for from the working directory upwards.
MANIFESTS = ["Cargo.toml", "Pipfile", "go.mod", "package.json", "pyproject.toml", "requirements.txt", "setup.py"]
#: Extensions of files that a command may name as tests.
TEST_EXTENSIONS = ["py", "js", "mjs", "ts", "go", "rs", "java", "kt"]
MAX_SIZE = 512_000
#: Files beside others, in all, up to which their arrays may be broadcast.
MAX_BROADCAST = 200_000


def rankable(repo_files: DataFrame) -> DataFrame:
    return repo_files.where((F.col("size_bytes") > 0) & (F.col("size_bytes") <= MAX_SIZE) & ~skipped_dir(parts(F.col("rel"))))


def _dir(rel):
    return F.regexp_extract(rel, r"^(.*)/[^/]*$", 1)


def _root(runs: DataFrame):
    """The repository's absolute path, where the runs' table has it."""
    return (F.col("root") if "root" in runs.columns else F.lit(None).cast("string")).alias("root")


def _at(base, name):
    return F.when(base == "", name).otherwise(F.concat(base, F.lit("/"), name))


def _kind(rel):
    return F.when(rel.rlike(r"[^/]\.pyw?$"), "py").when(rel.rlike(rf"({'|'.join(e.replace('.', '[.]') for e in JS_EXTENSIONS)})$"), "js")


def _keyed(files: DataFrame) -> DataFrame:
    """files of languages whose imports are read, with kind and key, a hash of their content."""
    return files.withColumns({"kind": _kind(F.col("rel")), "key": F.sha2("content", 256)}).where("kind is not null")


def named_modules(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """kind, key, names: what the files' texts import by name. Equal texts of any repositories are read once.

    files: rel, content. known: an earlier result; texts that it has are not read again.
    """
    keyed = _keyed(files)
    if known is not None:
        old = known.select(F.col("kind").alias("o_kind"), F.col("key").alias("o_key"))
        keyed = keyed.join(old, (F.col("kind") == F.col("o_kind")) & (F.col("key") == F.col("o_key")), "left_anti")
    texts = keyed.groupBy("kind", "key").agg(F.any_value("content").alias("content"))
    name = r"[A-Za-z_][\w.]*"
    froms = F.regexp_extract_all("content", F.lit(rf"(?mU)^\s*from\s+({name})\s+import\s"), F.lit(1))
    # a list of names ends at the first one that is renamed
    lists = F.regexp_extract_all("content", F.lit(rf"(?mU)^\s*import\s+({name}(?:\s*,\s*{name})*)"), F.lit(1))
    plain = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, r"\s*,\s*"), lambda m: F.trim(m))))
    # a quoted path that begins with a dot, after "require(" or after "from" or "import" and a blank
    leads = "|".join([r"require\(\s*", r"from\s+", r"import\s+"])
    quoted = F.regexp_extract_all("content", F.lit(rf"(?:{leads})[\"'](\.\.?/[^\"']+)[\"']"), F.lit(1))
    names = F.array_distinct(F.filter(F.when(F.col("kind") == "py", F.concat(froms, plain)).otherwise(quoted), lambda m: m != ""))
    found = texts.select("kind", "key", names.alias("names"))
    return found if known is None else found.unionByName(known.select("kind", "key", "names"))


def imported(files: DataFrame, repo_files: DataFrame, known_modules: DataFrame | None = None) -> DataFrame:
    """(repo_id, source, target): one hop from `files` (repo_id, rel) by local imports, and to Go files of the same package.

    Only the sources' texts are read, each distinct one once, and not those of `known_modules`
    (see named_modules); a package's files travel as one array per directory.
    """
    known = rankable(repo_files).select(F.col("repo_id").alias("k_repo"), F.col("rel").alias("k_rel"))
    asked = files.select(F.col("repo_id").alias("a_repo"), F.col("rel").alias("a_rel")).distinct()
    same = (F.col("repo_id") == F.col("a_repo")) & (F.col("rel") == F.col("a_rel"))
    texts = rankable(repo_files).join(asked, same, "left_semi").withColumn("base", _dir(F.col("rel")))
    named = named_modules(texts, known_modules).select(F.col("kind").alias("n_kind"), F.col("key").alias("n_key"), "names")
    met = _keyed(texts).join(named, (F.col("kind") == F.col("n_kind")) & (F.col("key") == F.col("n_key"))).select("repo_id", "rel", "base", "kind", F.explode("names").alias("m"))
    module, wanted = (met.where(F.col("kind") == k).drop("kind") for k in ("py", "js"))
    slashed = F.replace(F.col("m"), F.lit("."), F.lit("/"))
    py_places = [_at(b, F.concat(slashed, F.lit(end))) for b in (F.lit(""), F.lit("src"), F.col("base")) for end in (".py", "/__init__.py")]
    whole = tidy(parts(_at(F.col("base"), F.col("m"))))
    stem = F.regexp_replace(whole, r"(?<=[^/])\.[^./]+$", "")
    js_places = [F.when(whole != stem, whole), *[F.concat(stem, F.lit(e)) for e in JS_EXTENSIONS], *[F.concat(whole, F.lit(f"/index{e}")) for e in JS_EXTENSIONS]]

    def first(asked: DataFrame, options: list) -> DataFrame:
        tried = asked.select("repo_id", "rel", "m", F.posexplode(F.array(*options)).alias("prio", "place")).where("place is not null")
        met = tried.join(known, (F.col("repo_id") == F.col("k_repo")) & (F.col("place") == F.col("k_rel")))
        return met.groupBy("repo_id", "rel", "m").agg(F.min_by("place", "prio").alias("target")).select("repo_id", F.col("rel").alias("source"), "target")

    go = texts.where("rel like '%.go'").select("repo_id", "rel", "base")
    packages = known.where("k_rel like '%.go' and k_rel not like '%\\_test.go'").groupBy("k_repo", _dir(F.col("k_rel")).alias("dir")).agg(F.collect_list("k_rel").alias("members"))
    siblings = go.join(packages, (F.col("repo_id") == F.col("k_repo")) & (F.col("base") == F.col("dir"))).select("repo_id", F.col("rel").alias("source"), F.explode("members").alias("target"))
    return first(module, py_places).unionByName(first(wanted, js_places)).unionByName(siblings).where("source <> target").distinct()


def manifests(runs: DataFrame, repo_files: DataFrame) -> DataFrame:
    """(run_id, repo_id, rel): the nearest manifest of each name from the run's cwd up to the root. Only distinct directories are looked up."""
    cwd = F.coalesce("cwd", F.lit(""))
    asked = runs.select("repo_id", cwd.alias("cwd")).distinct()
    steps = parts(F.col("cwd"))
    up = asked.select("repo_id", "cwd", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("dir")))).alias("a")).select("repo_id", "cwd", "a.*")
    named = rankable(repo_files).withColumn("name", F.element_at(F.split("rel", "/"), -1)).where(F.col("name").isin(MANIFESTS)).select(F.col("repo_id").alias("m_repo"), "rel", "name", _dir(F.col("rel")).alias("m_dir"))
    nearest = up.join(named, (F.col("repo_id") == F.col("m_repo")) & (F.col("dir") == F.col("m_dir"))).groupBy("repo_id", "cwd", "name").agg(F.max_by("rel", "depth").alias("rel"))
    held = staged(nearest.select(F.col("repo_id").alias("n_repo"), F.col("cwd").alias("n_cwd"), "rel"))
    return runs.select("run_id", "repo_id", cwd.alias("cwd")).join(held, (F.col("repo_id") == F.col("n_repo")) & (F.col("cwd") == F.col("n_cwd"))).select("run_id", "repo_id", "rel")


def failing_tests(parsed: DataFrame, runs: DataFrame, repo_files: DataFrame) -> DataFrame:
    """(run_id, repo_id, rel): test files that the output names, and those under the working directory that the command does.

    What the output names is placed like a frame's path, by the longest tail if need be.
    """
    where = runs.select(F.col("run_id").alias("r_id"), "repo_id", "cwd", _root(runs), "command")
    keys = ["run_id", "repo_id", "cwd", "root", "path"]
    said = parsed.select("run_id", F.explode("failed_tests.path").alias("path")).join(where, F.col("run_id") == F.col("r_id")).select(*keys)
    word = where.withColumn("run_id", F.col("r_id")).withColumn("w", F.explode("command")).withColumn("path", F.substring_index("w", "::", 1)).select(*keys)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    asked = word.where(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1).isin(TEST_EXTENSIONS) & name.rlike("test|spec"))
    at = asked.withColumn("under", tidy(F.concat(parts(F.coalesce("cwd", F.lit(""))), parts(F.col("path")))))
    known = repo_files.select(F.col("repo_id").alias("k_repo"), F.col("rel").alias("k_rel"))
    there = at.join(known, (F.col("repo_id") == F.col("k_repo")) & (F.col("under") == F.col("k_rel")), "left_semi").select(*keys)
    # written, as it is read twice and its plan holds every run's command
    both = staged(said.unionByName(there))
    paths = both.select(*keys, F.lit(None).cast("string").alias("path_hint"), F.lit(False).alias("vendored"))
    placed = staged(resolve(paths, repo_files).where("resolved is not null").select(F.col("repo_id").alias("p_repo"), F.col("cwd").alias("p_cwd"), F.col("root").alias("p_root"), F.col("path").alias("p_path"), F.col("resolved").alias("rel")))
    same = (F.col("repo_id") == F.col("p_repo")) & (F.col("path") == F.col("p_path")) & F.col("cwd").eqNullSafe(F.col("p_cwd")) & F.col("root").eqNullSafe(F.col("p_root"))
    return paths.join(placed, same).select("run_id", "repo_id", "rel").distinct()


def rank_parts(runs: DataFrame, parsed: DataFrame, resolved: DataFrame, repo_files: DataFrame, changed: DataFrame | None = None, known_modules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What `listed` puts together, as written tables: run_id, repo_id, rel, rank, lines of the files that a run itself names, and repo_id, source, target of the files next to those in a stack or failing test.

    A package's files are so held once for each file of it, not once for each run. resolved: run_id, repo_id, rel, line of placed frames; changed: run_id, rel; known_modules: a kept result of named_modules.
    """
    none = F.lit(None).cast("int")
    one = resolved.select("run_id", "repo_id", "rel", F.lit(1).alias("rank"), F.col("line").cast("int").alias("line"))
    # written, as it is read twice and its plan is a whole resolution
    two = staged(failing_tests(parsed, runs, repo_files)).select("run_id", "repo_id", "rel", F.lit(2).alias("rank"), none.alias("line"))
    seeds = one.unionByName(two).select("repo_id", "rel").distinct()
    near = staged(imported(seeds, repo_files, known_modules))
    all_ = one.unionByName(two)
    if changed is not None:
        repo_of = runs.select(F.col("run_id").alias("q_id"), "repo_id")
        all_ = all_.unionByName(changed.join(repo_of, F.col("run_id") == F.col("q_id")).select("run_id", "repo_id", "rel", F.lit(4).alias("rank"), none.alias("line")))
    all_ = all_.unionByName(manifests(runs, repo_files).select("run_id", "repo_id", "rel", F.lit(5).alias("rank"), none.alias("line")))
    known = rankable(repo_files).select(F.col("repo_id").alias("k_repo"), F.col("rel").alias("k_rel"))
    held = all_.join(known, (F.col("repo_id") == F.col("k_repo")) & (F.col("rel") == F.col("k_rel")), "left_semi")
    return staged(held.groupBy("run_id", "repo_id", "rel").agg(F.min("rank").alias("rank"), F.sort_array(F.collect_set("line")).alias("lines"))), near


def listed(own: DataFrame, near: DataFrame, more: list[str]) -> DataFrame:
    """run_id, repo_id, files: each run's files as one array of (rel, rank) and the columns `more` of both tables, in order of rank and rel.

    Rows meet by run_id only; what is next to a file comes to them as one array, already in order.
    """
    third = near.select(F.col("repo_id").alias("n_repo"), "source", F.struct(F.col("target").alias("rel"), F.lit(3).alias("rank"), *more).alias("f"))
    beside = staged(third.groupBy("n_repo", "source").agg(F.sort_array(F.collect_list("f")).alias("beside")))
    beside = weighed(beside, F.size("beside"), MAX_BROADCAST)
    met = own.repartition("run_id").join(beside, (F.col("repo_id") == F.col("n_repo")) & (F.col("rel") == F.col("source")) & (F.col("rank") <= 2), "left")
    held = met.groupBy("run_id", "repo_id").agg(F.collect_list(F.struct("rel", "rank", *more)).alias("named"), F.flatten(F.collect_list("beside")).alias("beside"))
    # a file's best rank comes first
    first = lambda x: F.filter(x, lambda f, i: (i == 0) | (f["rel"] != F.get(x, i - 1)["rel"]))
    of_rank = lambda x, k: F.filter(x, lambda f: f["rank"] == k)
    by_rank = lambda x: F.concat(*[of_rank(x, k) for k in REASONS])
    return held.select("run_id", "repo_id", let(let(F.sort_array(F.concat("named", "beside")), first), by_rank).alias("files"))


def reason(rank: Column, diagnosed: Column) -> Column:
    return F.when((rank == 1) & diagnosed, "compiler diagnostic").otherwise(F.element_at(literal_map(REASONS), rank))


def diagnosed(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("run_id").alias("d_id"), (F.size("diagnostics") > 0).alias("diagnosed"))


def rank_files(own: DataFrame, near: DataFrame, parsed: DataFrame) -> DataFrame:
    """run_id, rel, rank, reason, lines. own, near: as rank_parts gives them."""
    held = listed(own, near.withColumn("lines", F.array().cast("array<int>")), ["lines"]).join(diagnosed(parsed), F.col("run_id") == F.col("d_id"), "left").select("run_id", "diagnosed", F.explode("files").alias("f"))
    return held.select("run_id", "f.rel", "f.rank", reason(F.col("f.rank"), F.col("diagnosed")).alias("reason"), "f.lines")
