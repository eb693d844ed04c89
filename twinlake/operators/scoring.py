"""Which copy of an exact duplicate to keep: informational members, named contributions, keeper, reclaim."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators.exact import repeated

# Contributions to a member's score, under the names that files of weights use.
WEIGHTS = {
    "path_marker_backup": -8.0,
    "filename_copy_marker": -6.0,
    "under_active_home": 4.0,
    "under_inactive_home": -4.0,
    "downloads_transit": -2.0,
    "depth_penalty_per_level": -0.5,
    "newest_mtime": 3.0,
    "oldest_mtime_tiebreak": 1.0,
    "clean_git_repo": 2.0,
    "external_drive_penalty": -2.0,
    "larger_size": 2.0,
    "cloud_when_local_exists": -3.0,
    "is_shared_file": 0.0,
    "is_project_tree_backup_copy": -5.0,
    "git_head_older": -3.0,
}
UNLISTED_CLOUD = -0.01


def informational(df: DataFrame, trash_enabled: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``is_informational``: archive members, shared files, read-only photo sources, hard links and clones.

    Clones share a ``clone_id``, where ``df`` has that column, with another local file of their group; a null id is no clone.

    Hard links are local files that share device and inode within their group; cloud rows all carry
    inode 0 and aren't links. A null inode is no link. The counts are joined back by key, so a
    group of any size is counted map-side.
    """
    links = df.filter("NOT is_archive_member AND source_id = 'local' AND inode IS NOT NULL AND dev IS NOT NULL").groupBy("full_hash", "dev", "inode").agg(F.count("*").alias("n")).filter("n > 1")
    links = links.select(F.col("full_hash").alias("_h"), F.col("dev").alias("_d"), F.col("inode").alias("_i"))
    linked = F.col("_h").isNotNull() & ~F.col("is_archive_member") & (F.col("source_id") == "local")
    cloned = F.lit(False)
    if "clone_id" in df.columns:
        clones = df.filter("NOT is_archive_member AND source_id = 'local' AND clone_id IS NOT NULL").groupBy("full_hash", "clone_id").agg(F.count("*").alias("n")).filter("n > 1")
        df = df.join(clones.select(F.col("full_hash").alias("_ch"), F.col("clone_id").alias("_ci")), (F.col("full_hash") == F.col("_ch")) & (F.col("clone_id") == F.col("_ci")), "left")
        df = df.withColumn("_cloned", F.col("_ci").isNotNull() & ~F.col("is_archive_member") & (F.col("source_id") == "local")).drop("_ch", "_ci")
        cloned = F.col("_cloned")
    out = df.join(links, (F.col("full_hash") == F.col("_h")) & (F.col("dev") == F.col("_d")) & (F.col("inode") == F.col("_i")), "left")
    photos = F.col("source_id").startswith("icloud:") | (F.col("source_id").startswith("gphotos:") & ~F.col("source_id").isin(*trash_enabled, ""))
    return out.withColumn("is_informational", F.col("is_archive_member") | F.coalesce("is_shared", F.lit(False)) | photos | linked | cloned).drop("_h", "_d", "_i", "_cloned")


def contributions(weights: Mapping[str, float] = WEIGHTS, active_homes: Sequence[str] = (), cloud_order: Sequence[str] = ()) -> Column:
    """Array of (name, contribution) of one member, given the features of its group; in a fixed order."""
    path, cloud = F.col("path"), F.col("source_id") != "local"
    active, home = P.within(path, active_homes), P.homeish_ancestor(path)
    tests: list[tuple[str | Column, Column, Column]] = [("cloud_when_local_exists", cloud & F.col("any_local"), F.lit(weights["cloud_when_local_exists"]))]
    if cloud_order:
        place = F.array_position(F.array(*[F.lit(c) for c in cloud_order]), F.col("source_id"))
        listed = F.concat(F.lit("retained_cloud_order["), F.when(place > 0, F.col("source_id")).otherwise("unlisted"), F.lit("]"))
        tests.append((listed, cloud, F.when(place > 0, F.lit(len(cloud_order)) - place).otherwise(F.lit(UNLISTED_CLOUD)).cast("double")))
    tests += [
        ("path_marker_backup", P.has_copy_word(path), F.lit(weights["path_marker_backup"])),
        ("filename_copy_marker", P.has_copy_name(path), F.lit(weights["filename_copy_marker"])),
        ("under_active_home", active, F.lit(weights["under_active_home"])),
        ("under_inactive_home", home.isNotNull() & ~active, F.lit(weights["under_inactive_home"])),
        ("downloads_transit", home == "Downloads", F.lit(weights["downloads_transit"])),
        ("depth_penalty_per_level", F.lit(True), P.depth(path) * weights["depth_penalty_per_level"]),
        ("newest_mtime", (F.col("newest") != F.col("oldest")) & (F.col("mtime") == F.col("newest")), F.lit(weights["newest_mtime"])),
        ("oldest_mtime_tiebreak", (F.col("newest") != F.col("oldest")) & (F.col("mtime") == F.col("oldest")), F.lit(weights["oldest_mtime_tiebreak"])),
        ("clean_git_repo", F.col("in_clean_git"), F.lit(weights["clean_git_repo"])),
        ("external_drive_penalty", P.is_external(path) & F.col("any_internal"), F.lit(weights["external_drive_penalty"])),
        ("larger_size", (F.col("smallest") < F.col("largest")) & (F.col("size") == F.col("largest")), F.lit(weights["larger_size"])),
    ]
    each = F.array(*[F.when(test, F.struct((name if isinstance(name, Column) else F.lit(name)).alias("name"), w.cast("double").alias("contribution"))) for name, test, w in tests])
    return F.filter(each, lambda x: x.isNotNull())


def scored_members(df: DataFrame, active_homes: Sequence[str] = (), cloud_order: Sequence[str] = (), trash_enabled: Sequence[str] = (), weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Members of exact groups with score, contributions, ``is_informational`` and ``is_proposed_keeper``.

    ``df`` is an inventory with one row a path; an ``in_clean_git`` column is used if there is one.
    Features of a group count its non-informational members; informational ones score 0 and are never
    kept. Of the others the keeper has the highest score, then the fewest path parts, then the
    largest path. Features and keeper are map-side aggregates joined back by digest, not windows, so a
    digest shared by a third of all files needs no single task.
    """
    rows = df.filter("full_hash IS NOT NULL")
    rows = rows if "in_clean_git" in df.columns else rows.withColumn("in_clean_git", F.lit(False))
    members = informational(repeated(rows, "full_hash"), trash_enabled)
    own = ~F.col("is_informational")
    pick = lambda c: F.when(own, c)
    features = members.groupBy("full_hash").agg(
        F.max(pick(F.col("mtime"))).alias("newest"), F.min(pick(F.col("mtime"))).alias("oldest"), F.max(pick(F.col("size"))).alias("largest"), F.min(pick(F.col("size"))).alias("smallest"),
        F.max(pick(~P.is_external(F.col("path")))).alias("any_internal"), F.max(pick(F.col("source_id") == "local")).alias("any_local"),
    ).withColumnRenamed("full_hash", "_g")
    known = members.join(features, F.col("full_hash") == F.col("_g")).drop("_g")
    signals = F.when(own, contributions(weights, active_homes, cloud_order)).otherwise(F.array().cast("array<struct<name:string,contribution:double>>"))
    scored = known.withColumn("signals", signals).withColumn("score", F.aggregate("signals", F.lit(0.0), lambda a, x: a + x["contribution"]))
    best = scored.filter(own).groupBy("full_hash").agg(F.max(F.struct("score", -P.depth(F.col("path")), "path")).alias("b")).select(F.col("full_hash").alias("_g"), F.col("b.path").alias("_keeper"))
    out = scored.join(best, F.col("full_hash") == F.col("_g"), "left")
    return out.select("full_hash", "path", "source_id", "size", "mtime", "score", "signals", "is_informational", F.coalesce(F.col("path") == F.col("_keeper"), F.lit(False)).alias("is_proposed_keeper"))


def reclaim(scored: DataFrame) -> DataFrame:
    """Per group its members and the bytes of those neither kept nor informational."""
    gone = ~F.col("is_proposed_keeper") & ~F.col("is_informational")
    return scored.groupBy("full_hash").agg(F.count("*").alias("n_members"), F.sum(F.when(gone, F.col("size")).otherwise(0)).alias("reclaim_bytes"), F.max(F.when(F.col("is_proposed_keeper"), F.col("path"))).alias("keeper"))


def pending_discards(scored: DataFrame) -> DataFrame:
    """One row: how many members are neither kept nor informational, and their bytes."""
    gone = scored.filter("NOT is_proposed_keeper AND NOT is_informational")
    return gone.agg(F.count("*").alias("n_pending"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def weights_listed(spark, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``(name, weight)`` in the order of names."""
    return spark.createDataFrame(sorted((k, float(v)) for k, v in weights.items()), "name string, weight double")


def discards(scored: DataFrame) -> DataFrame:
    """What would be removed: neither kept nor informational, of groups with a keeper; local or cloud."""
    kept = scored.filter("is_proposed_keeper").select(F.col("full_hash").alias("_g"))
    gone = scored.filter("NOT is_proposed_keeper AND NOT is_informational").join(kept, F.col("full_hash") == F.col("_g"), "left_semi")
    return gone.select("full_hash", "path", "size", F.when(F.col("source_id") == "local", "local").otherwise("cloud").alias("rail"))
