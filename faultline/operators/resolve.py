"""Frame paths to repository files, never by guess.

Distinct (path, hint, vendored) triples are resolved once. A path that names a
repository file (under the run's cwd, then from the root; an absolute one under the
repository's own path) is `direct`; a vendored one is `vendored`; an absolute one that exists elsewhere is `outside-repo`; else
the file with the longest matching tail of segments is `suffix`, if it is the only
one at that depth, and `ambiguous` otherwise. An index holds each tail of each file of
an asked name once, with the number of its files, so whether a tail is unique is a
lookup: a path meets one row for each of its own tails, however many files share its
name. Candidates are listed once for each ambiguous tail.

The search by tails sees the first `cap` files of a repository in the order of a sorted
walk. Larger repositories are dealt out by range of that order; the cap falls into one
range, and only that one's files are numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.scalars import parts, tidy
from faultline.operators.parse import VENDORED
from faultline.sources.staging import staged

#: Directories that are never looked into.
SKIPPED = [".eggs", ".faultline", ".git", ".hg", ".idea", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".venv", ".vscode", "__pycache__", "build", "dist", "htmlcov", "node_modules", "venv"]
INDEX_CAP = 40_000


def skipped_dir(path_parts):
    return F.arrays_overlap(F.slice(path_parts, F.lit(1), F.greatest(F.size(path_parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED)))


def walk_key(path_parts: Column) -> Column:
    """Sorts as a walk goes that lists a directory's own files before its subdirectories, each by name."""
    last = F.size(path_parts) - 1
    return F.array_join(F.transform(path_parts, lambda x, i: F.concat(F.when(i == last, F.lit("\x01")).otherwise("\x02"), x)), "\x00")


def sizes(repo_files: DataFrame, cap: int = INDEX_CAP) -> DataFrame:
    """repo_id, n_files, truncated: how many files a walk meets, and whether the index leaves some out."""
    seen = repo_files.where(~skipped_dir(parts(F.col("rel")))).groupBy("repo_id").agg(F.count("*").alias("n_files"))
    return seen.withColumn("truncated", F.col("n_files") > cap)


def _first_of_walk(files: DataFrame, cap: int) -> DataFrame:
    """The first `cap` of each repository. Only counts of ranges are put in order, and the files of the range that the cap falls into."""
    keyed = files.withColumn("walk", walk_key(F.col("path_parts")))
    dealt = staged(keyed.repartitionByRange("repo_id", "walk").withColumn("range", F.spark_partition_id()))
    ranges = dealt.groupBy(F.col("repo_id").alias("g_repo"), F.col("range").alias("g_range")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("g_repo").orderBy("g_range").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranges.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(F.col("before") < cap)
    met = dealt.join(counted, (F.col("repo_id") == F.col("g_repo")) & (F.col("range") == F.col("g_range")))
    whole = met.where(F.col("before") + F.col("n") <= cap)
    split = met.where(F.col("before") + F.col("n") > cap).withColumn("nth", F.row_number().over(Window.partitionBy("repo_id", "range").orderBy("walk")))
    return whole.select(*files.columns).unionByName(split.where(F.col("before") + F.col("nth") <= cap).select(*files.columns))


def file_index(repo_files: DataFrame, cap: int = INDEX_CAP) -> DataFrame:
    """repo_id, rel, name, path_parts: the first `cap` files of each repository in walk order."""
    base = repo_files.select("repo_id", "rel", parts(F.col("rel")).alias("path_parts")).where(~skipped_dir(F.col("path_parts")))
    large = sizes(repo_files, cap).where("truncated").select(F.col("repo_id").alias("l_repo"))
    if not large.isEmpty():
        is_large = F.col("repo_id") == F.col("l_repo")
        base = base.join(large, is_large, "left_anti").unionByName(_first_of_walk(base.join(large, is_large, "left_semi"), cap))
    return base.select("repo_id", "rel", F.element_at("path_parts", -1).alias("name"), "path_parts")


def tails(path_parts: Column) -> Column:
    """All tails of a path: (depth, tail)."""
    n = F.size(path_parts)
    return F.transform(F.sequence(F.lit(1), n), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(path_parts, n - d + 1, d), "/").alias("tail")))


def tail_index(files: DataFrame) -> DataFrame:
    """repo_id, tail, n (files that end so), only (the file, where it is one). files: as file_index."""
    each = files.select("repo_id", "rel", F.explode(F.transform(tails(F.col("path_parts")), lambda t: t["tail"])).alias("tail"))
    return each.groupBy("repo_id", "tail").agg(F.count("*").alias("n"), F.min("rel").alias("only"))


def _vendored(path):
    padded = F.concat(F.lit("/"), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", ""), F.lit("/"))
    return F.exists(F.array(*map(F.lit, VENDORED)), lambda m: F.contains(padded, m))


def resolve(frames: DataFrame, repo_files: DataFrame, host_files: DataFrame | None = None) -> DataFrame:
    """frames: repo_id, cwd (from the root), root (the repository's absolute path, may be null or absent), path, path_hint, vendored -> these with how, resolved, candidates."""
    keys = ["repo_id", "cwd", "root", "path", "path_hint", "vendored"]
    if "root" not in frames.columns:
        frames = frames.withColumn("root", F.lit(None).cast("string"))
    # written, as it is read several times and its plan ends in the runs
    asked = staged(frames.select(*keys).distinct())
    absolute = F.col("path").rlike(r"^/|^[A-Za-z]:[/\\]")
    own = F.concat(tidy(parts(F.col("root"))), F.lit("/"))
    full = tidy(parts(F.col("path")))
    inside = F.when(F.startswith(full, own), full.substr(F.length(own) + 1, F.length(full)))
    asked = asked.withColumn("absolute", absolute).withColumn("first", F.when(F.col("absolute"), inside).otherwise(tidy(F.concat(parts(F.coalesce("cwd", F.lit(""))), parts(F.col("path"))))))
    asked = asked.withColumn("second", F.when(~F.col("absolute"), full))
    # the cap limits the search by tails, not paths that name a file outright
    exact = repo_files.where(~skipped_dir(parts(F.col("rel")))).select(F.col("repo_id").alias("x_repo"), F.col("rel").alias("x_rel"))
    cwd_hit = exact.select(F.col("x_repo").alias("c_repo"), F.col("x_rel").alias("c_rel"))
    direct = (
        asked.join(cwd_hit, (F.col("repo_id") == F.col("c_repo")) & (F.col("first") == F.col("c_rel")), "left")
        .join(exact, (F.col("repo_id") == F.col("x_repo")) & (F.col("second") == F.col("x_rel")), "left")
        .withColumn("direct", F.coalesce("c_rel", "x_rel"))
        .select(*keys, (F.col("vendored") | _vendored(F.col("path"))).alias("foreign"), "absolute", "direct")
    )
    if host_files is not None:
        outside = host_files.select(F.col("path").alias("h_path")).distinct()
        direct = direct.join(outside, F.col("absolute") & (F.col("path") == F.col("h_path")), "left").withColumn("elsewhere", F.col("h_path").isNotNull()).drop("h_path")
    else:
        direct = direct.withColumn("elsewhere", F.lit(False))
    hints = F.filter(F.array(F.struct(F.lit(0).alias("prio"), F.col("path_hint").alias("hint")), F.struct(F.lit(1).alias("prio"), F.col("path").alias("hint"))), lambda h: h["hint"].isNotNull())
    open_ = direct.where("direct is null and not foreign and not elsewhere")
    tried = open_.select(*keys, F.explode(hints).alias("h")).select(*keys, "h.prio", parts(F.col("h.hint")).alias("hint_parts")).where("size(hint_parts) > 0")
    named = tried.withColumn("name", F.element_at("hint_parts", -1))
    wanted = named.select(F.col("repo_id").alias("w_repo"), F.col("name").alias("w_name")).distinct()
    files = file_index(repo_files).join(wanted, (F.col("repo_id") == F.col("w_repo")) & (F.col("name") == F.col("w_name")), "left_semi")
    known = tail_index(files).select(F.col("repo_id").alias("i_repo"), F.col("tail").alias("i_tail"), "n", "only")
    own = named.select(*keys, "prio", F.explode(tails(F.col("hint_parts"))).alias("t")).select(*keys, "prio", "t.*")
    met = own.join(known, (F.col("repo_id") == F.col("i_repo")) & (F.col("tail") == F.col("i_tail")))
    best = met.groupBy(*keys).agg(F.min_by(F.struct("tail", "n", "only"), F.struct("prio", -F.col("depth"))).alias("b")).select(*keys, "b.*")
    many = best.where("n > 1").select(F.col("repo_id").alias("m_repo"), F.col("tail").alias("m_tail")).distinct()
    ends = files.select("repo_id", "rel", F.explode(F.transform(tails(F.col("path_parts")), lambda t: t["tail"])).alias("tail"))
    listed = ends.join(many, (F.col("repo_id") == F.col("m_repo")) & (F.col("tail") == F.col("m_tail"))).groupBy("m_repo", "m_tail").agg(F.array_sort(F.collect_list("rel")).alias("rels"))
    alike = (F.col("repo_id") == F.col("m_repo")) & (F.col("tail") == F.col("m_tail"))
    found = best.join(listed, alike, "left").select(*[F.col(k).alias(f"b_{k}") for k in keys], "n", "only", "rels")
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"b_{k}"))
        same = one if same is None else same & one
    joined = direct.join(found, same, "left")
    how = (
        F.when(F.col("direct").isNotNull(), "direct").when(F.col("foreign"), "vendored").when(F.col("elsewhere"), "outside-repo").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    )
    return joined.select(
        *keys, how.alias("how"), F.coalesce("direct", F.when(F.col("n") == 1, F.col("only"))).alias("resolved"),
        F.coalesce(F.when(F.col("direct").isNull(), F.col("rels")), F.array().cast("array<string>")).alias("candidates"),
    )
