"""Readers of runs and repositories, and writers of packets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.scalars import byte_tokens, parts
from faultline.operators.longruns import PART
from faultline.operators.resolve import skipped_dir

#: Extensions counted as source, and lock files that aren't.
SOURCE_EXTENSIONS = ["c", "cfg", "cjs", "cpp", "cs", "css", "go", "h", "hpp", "html", "ini", "java", "js", "json", "jsx", "md", "mjs", "py", "pyi", "rb", "rs", "sh", "sql", "toml", "ts", "tsx", "txt", "yaml", "yml"]
LOCK_FILES = ["Cargo.lock", "go.sum", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock"]
MAX_COUNTED = 1_000_000
#: What a captured run's folder may hold.
_CAPTURED = ["stdout", "stderr", "run.json", "environment.json", "git.json", "status", "diff", "names"]
RUNS = "run_id long, repo_id string, command array<string>, exit_code int, stdout string, stderr string, cwd string"


def runs_from_logs(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """A run per text file: the file is its stdout."""
    read = spark.read.text(path, wholetext=True).select(F.xxhash64(F.col("_metadata.file_path")).alias("run_id"), F.col("value").alias("stdout"))
    return read.select("run_id", F.lit(repo_id).alias("repo_id"), F.array().cast("array<string>").alias("command"), F.lit(1).alias("exit_code"), "stdout", F.lit("").alias("stderr"), F.lit("").alias("cwd"))


def _lines_to_parts(batches, size: int):
    """Lines of a file's splits, in order, as parts of about `size` characters; a part's place is its split's start and what was read since."""
    held: list[str] = []
    key, at, length = None, 0, 0

    def part():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([at], pa.int64()), pa.array(["\n".join(held) + "\n"], pa.string())], names=["run_id", "at", "text"])

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("run_id", "start", "value")]
        for run, start, line in zip(*columns, strict=True):
            if held and ((run, start) != key or length >= size):
                yield part()
                at += length
                held, length = [], 0
            if (run, start) != key:
                key, at = (run, start), start
            held.append(line)
            length += len(line.encode()) + 1
    if held:
        yield part()


def log_parts(spark: SparkSession, path: str, size: int = PART) -> DataFrame:
    """run_id, at, text for parse_parts: a run per text file, of any size; a file's splits are read by tasks of their own."""
    read = spark.read.text(path).select(F.xxhash64(F.col("_metadata.file_path")).alias("run_id"), F.col("_metadata.file_block_start").alias("start"), "value")
    return read.mapInArrow(lambda batches: _lines_to_parts(batches, size), "run_id long, at long, text string")


def captured_runs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """runs, git and environment of run folders, one below the other's table as packet.build takes them.

    Each folder under `path` is a run, captured by whatever ran the command: `stdout`, `stderr`
    and `run.json` (repo_id, command, exit_code, cwd, captured_at), `environment.json` (python,
    node, platform, machine, env) and, inside a worktree, `git.json` (root, branch, commit),
    `status`, `diff` and `names` as git prints them. Files that are missing are null or empty;
    a folder without git.json has no row in git. Bytes that aren't UTF-8 become replacement
    characters. Any store that Spark reads will do. run_id is a hash of the folder's path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    texts = named.where(F.col("name").isin(_CAPTURED)).groupBy("folder").agg(*[F.max(F.when(F.col("name") == n, F.col("text"))).alias(n.replace(".", "_")) for n in _CAPTURED])
    held = texts.select(
        F.xxhash64("folder").alias("run_id"), "stdout", "stderr", "status", "diff", "names",
        F.from_json("run_json", "repo_id string, command array<string>, exit_code int, cwd string, captured_at timestamp").alias("run"),
        F.from_json("git_json", "root string, branch string, commit string").alias("git"),
        F.from_json("environment_json", "python string, node string, platform string, machine string, env map<string, string>").alias("environment"),
    )
    empty = F.lit("")
    runs = held.select("run_id", F.coalesce("run.repo_id", empty).alias("repo_id"), F.coalesce("run.command", F.array().cast("array<string>")).alias("command"), "run.exit_code", F.coalesce("stdout", empty).alias("stdout"), F.coalesce("stderr", empty).alias("stderr"), F.coalesce("run.cwd", empty).alias("cwd"), F.col("git.root").alias("root"), "run.captured_at")
    lines = F.filter(F.split(F.coalesce("names", empty), "\n"), lambda n: F.trim(n) != "")
    git = held.where("git is not null").select("run_id", "git.root", "git.branch", "git.commit", F.regexp_replace(F.coalesce("status", empty), "\n+$", "").alias("status"), F.regexp_replace(F.coalesce("diff", empty), "\n+$", "").alias("diff"), lines.alias("diff_names"))
    return {"runs": runs, "git": git, "environment": held.where("environment is not null").select("run_id", "environment.*")}


def repo_tree(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """repo_id, rel, size_bytes, content of a tree; bytes that aren't UTF-8 become replacement characters."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.substring_index("path", base + "/", -1), "^/+", "")
    return read.select(F.lit(repo_id).alias("repo_id"), rel.alias("rel"), F.col("length").alias("size_bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")).where(~skipped_dir(parts(F.col("rel"))))


def repo_tokens(repo_files: DataFrame) -> DataFrame:
    """repo_id, repo_tokens: estimated tokens of source files by their bytes."""
    ext = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))
    name = F.element_at(F.split("rel", "/"), -1)
    counted = repo_files.where(ext.isin(SOURCE_EXTENSIONS) & ~name.isin(LOCK_FILES) & (F.col("size_bytes") > 0) & (F.col("size_bytes") <= MAX_COUNTED) & ~skipped_dir(parts(F.col("rel"))))
    return counted.groupBy("repo_id").agg(F.sum(byte_tokens(F.col("size_bytes"))).alias("repo_tokens"))


def write_packets(packets: DataFrame, files: DataFrame, path: str, batch: int = 0) -> None:
    """Packets and full copies of the included files as two tables, under the batch's number.

    Writing a batch again replaces its rows and no others, so a batch that failed
    half-way or is replayed leaves the tables as one write does.
    """
    packets.write.mode("overwrite").parquet(f"{path}/packets/batch={batch}")
    files.where("included").select("run_id", "rel", F.col("full_content").alias("content")).write.mode("overwrite").parquet(f"{path}/files/batch={batch}")


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """The written packets, a run's last batch only."""
    rows = spark.read.parquet(f"{path}/packets")
    last = rows.groupBy(F.col("run_id").alias("l_id")).agg(F.max("batch").alias("l_batch"))
    return rows.join(last, (F.col("run_id") == F.col("l_id")) & (F.col("batch") == F.col("l_batch"))).drop("l_id", "l_batch")
