"""The whole way from runs to packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.longruns import parse_any
from faultline.operators.parse import unique_frames
from faultline.operators.rank import _root, rank_files, rank_parts
from faultline.operators.render import packets
from faultline.operators.resolve import resolve
from faultline.operators.select import DEFAULT_BUDGET, choose_files, chosen_rows, clamp, with_texts
from faultline.sources.ingest import repo_tokens
from faultline.sources.staging import staged, weighed

#: Resolutions and their candidates, in all, up to which they may be broadcast.
MAX_BROADCAST = 100_000
_KEYS = ["repo_id", "cwd", "root", "path", "path_hint", "vendored"]


def _located(runs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Unique frames with their run's repository and directories."""
    where = runs.select(F.col("run_id").alias("w_id"), "repo_id", "cwd", _root(runs))
    return unique_frames(parsed).join(where, F.col("run_id") == F.col("w_id")).drop("w_id")


def _placed(frames: DataFrame, known: DataFrame) -> DataFrame:
    other = known.select(*[F.col(k).alias(f"n_{k}") for k in _KEYS], "how", "resolved", "candidates")
    same = None
    for k in _KEYS:
        one = F.col(k).eqNullSafe(F.col(f"n_{k}"))
        same = one if same is None else same & one
    return frames.join(other, same, "left").drop(*[f"n_{k}" for k in _KEYS])


def placed_frames(runs: DataFrame, parsed: DataFrame, repo_files: DataFrame) -> DataFrame:
    """Unique frames with how, resolved and candidates."""
    frames = _located(runs, parsed)
    return _placed(frames, resolve(frames, repo_files))


def _ranked(runs: DataFrame, repo_files: DataFrame, changed: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """parsed, frames, known (the resolution of each distinct path), own and near (see rank_parts), as written tables, as several branches read them."""
    parsed = staged(parse_any(runs))
    located = staged(_located(runs, parsed))
    known = weighed(staged(resolve(located, repo_files)), F.size("candidates") + 1, MAX_BROADCAST)
    frames = staged(_placed(located, known))
    found = frames.where("resolved is not null").select("run_id", "repo_id", F.col("resolved").alias("rel"), "line")
    return parsed, frames, known, *rank_parts(runs, parsed, found, repo_files, changed)


def ranked_files(runs: DataFrame, repo_files: DataFrame, changed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """parsed, frames and ranked files of the runs."""
    parsed, frames, _, own, near = _ranked(runs, repo_files, changed)
    return parsed, frames, rank_files(own, near, parsed)


def build(runs: DataFrame, repo_files: DataFrame, changed: DataFrame | None = None, git=None, environment=None, budget: int = DEFAULT_BUDGET, created_at=None) -> dict[str, DataFrame]:
    """parsed, frames, ranked, chosen, files and packets of the runs; parsed, frames and what the others are made from are written tables."""
    parsed, frames, known, own, near = _ranked(runs, repo_files, changed)
    lists = staged(choose_files(own, near, parsed, repo_files, clamp(budget)))
    chosen = chosen_rows(lists)
    files = with_texts(chosen, repo_files)
    return {
        "parsed": parsed, "frames": frames, "ranked": rank_files(own, near, parsed), "chosen": chosen, "files": files,
        "packets": packets(runs, parsed, frames, known, lists, files.where("included"), repo_tokens(repo_files), git, environment, created_at),
    }
