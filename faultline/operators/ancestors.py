"""Lookups from a directory upwards: a run's repository, and the packet that it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalars import parts


def upwards(path: Column) -> Column:
    """(depth, place) of an absolute path and of each directory above it; the top is an empty place."""
    steps = parts(path)
    return F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.concat_ws("/", F.slice(steps, F.lit(1), n)).alias("place")))


def place(path: Column) -> Column:
    return F.array_join(parts(path), "/")


def with_root(runs: DataFrame, roots: DataFrame) -> DataFrame:
    """runs (with cwd, an absolute path) with `root` and `in_repo` added. roots: path, the worktrees that are known.

    The nearest root at or above the working directory is a run's; without one it is the working
    directory itself, and `in_repo` is false. A null cwd has no root. Only distinct directories are looked up.
    """
    known = roots.where("path is not null").select(place(F.col("path")).alias("known")).distinct()
    asked = runs.where("cwd is not null").select("cwd").distinct()
    steps = asked.select("cwd", F.explode(upwards(F.col("cwd"))).alias("s")).select("cwd", "s.*")
    nearest = steps.join(known, F.col("place") == F.col("known")).groupBy(F.col("cwd").alias("n_cwd")).agg(F.max_by("place", "depth").alias("nearest"))
    found = runs.drop("root", "in_repo").join(nearest, F.col("cwd") == F.col("n_cwd"), "left")
    root = F.when(F.col("nearest").isNotNull(), F.concat(F.lit("/"), F.col("nearest"))).otherwise(F.col("cwd"))
    return found.withColumns({"root": root, "in_repo": F.col("nearest").isNotNull()}).drop("n_cwd", "nearest")


def latest_packet(asked: DataFrame, packets: DataFrame) -> DataFrame:
    """asked (cwd, root) with `found_in` (cwd, root or null) and `markdown`. packets: dir, created_at, markdown.

    The newest packet of the working directory comes first, then that of the root; where neither has one, both are null.
    """
    newest = packets.where("dir is not null").groupBy(place(F.col("dir")).alias("dir")).agg(F.max_by("markdown", "created_at").alias("markdown"))
    here, above = (newest.select(F.col("dir").alias(f"{x}_dir"), F.col("markdown").alias(f"{x}_text")) for x in ("cwd", "root"))
    met = asked.join(here, place(F.col("cwd")) == F.col("cwd_dir"), "left").join(above, place(F.col("root")) == F.col("root_dir"), "left")
    found = F.when(F.col("cwd_dir").isNotNull(), "cwd").when(F.col("root_dir").isNotNull(), "root")
    text = F.when(F.col("cwd_dir").isNotNull(), F.col("cwd_text")).when(F.col("root_dir").isNotNull(), F.col("root_text"))
    return met.withColumns({"found_in": found, "markdown": text}).drop("cwd_dir", "cwd_text", "root_dir", "root_text")
