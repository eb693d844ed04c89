"""Archives whose every member is also a file of its own: relational division."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def redundant_archives(members: DataFrame, on_disk: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """``(outer_path, n_members)`` of archives all of whose member hashes are in ``on_disk (full_hash)``.

    ``members (outer_path, full_hash)``. An archive with a member of unknown hash, or in ``skipped
    (outer_path)``, is never redundant, nor is one without members.
    """
    there = on_disk.select(F.col("full_hash").alias("h")).filter("h IS NOT NULL").distinct()
    known = members.filter("outer_path IS NOT NULL").join(there, F.col("full_hash") == F.col("h"), "left")
    out = known.groupBy("outer_path").agg(F.count("*").alias("n_members"), F.count("h").alias("n_found")).filter("n_members = n_found").select("outer_path", "n_members")
    if skipped is not None:
        out = out.join(skipped.select(F.col("outer_path").alias("s")).distinct(), F.col("outer_path") == F.col("s"), "left_anti")
    return out


def archive_groups(redundant: DataFrame, files: DataFrame) -> DataFrame:
    """One proposal per redundant archive: its size is reclaimed, its score is -1."""
    return redundant.join(files.select(F.col("path").alias("p"), "size", "full_hash", "mtime"), F.col("outer_path") == F.col("p")).select(F.col("outer_path").alias("path"), "n_members", "size", "mtime", "full_hash", F.lit(-1.0).alias("score"), F.col("size").alias("reclaim_bytes"))
