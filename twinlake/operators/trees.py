"""Project trees: detection, roll-up, alike projects, file-by-file comparison, containment."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators.components import components
from twinlake.operators.scoring import WEIGHTS
from twinlake.operators.similarity import jaccard_pairs
from twinlake.operators.versions import latest

# Entries that make their folder a project.
MARKERS = ("package.json", "Cargo.toml", "pom.xml", "pyproject.toml", "Pipfile", "go.mod", "build.gradle", "build.gradle.kts", "Gemfile", ".git")
MARKER_SUFFIX = ".sln"
SHOWN_DIFFERENCES = 50


def ancestors(path: Column) -> Column:
    """All folders above a path, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def marked_folders(entries: DataFrame) -> DataFrame:
    """``(root, marker)`` of folders with a project marker among ``entries (dir, name)``; the smallest marker if several."""
    hit = entries.filter(F.col("name").isin(*MARKERS) | F.col("name").endswith(MARKER_SUFFIX))
    return hit.groupBy(F.col("dir").alias("root")).agg(F.min("name").alias("marker"))


def project_files(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Local files outside archives with their innermost project: ``(path, size, full_hash, root, rel)``.

    Each file is joined by all its ancestors with the roots and takes the longest; no prefix join.
    """
    rows = files.filter("source_id = 'local' AND NOT is_archive_member AND instr(path, '::') = 0").select("path", "size", "full_hash")
    above = rows.select("path", F.explode(ancestors(F.col("path"))).alias("dir"))
    inner = above.join(roots.select(F.col("root").alias("r")), F.col("dir") == F.col("r")).groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("root")).select(F.col("path").alias("p"), "root")
    return rows.join(inner, F.col("path") == F.col("p")).select("path", "size", "full_hash", "root", F.substr("path", F.length("root") + 2).alias("rel"))


def projects(files: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per project: marker, name, files, distinct digests and bytes."""
    out = project_files(files, roots).groupBy("root").agg(F.count("*").alias("n_files"), F.countDistinct("full_hash").alias("n_hashes"), F.sum("size").alias("total_bytes"))
    return out.join(roots.select(F.col("root").alias("r"), "marker"), F.col("root") == F.col("r")).select("root", "marker", P.base_name(F.col("root")).alias("name"), "n_files", "n_hashes", "total_bytes")


def latest_projects(infos: DataFrame) -> DataFrame:
    """``(root, rel, hash, total_bytes)``: the files of each project as scanned last; digests in lower case."""
    rows = infos.filter("root IS NOT NULL").select("root", "scanned_at", "total_bytes", F.array_sort(F.map_entries("file_hashes")).alias("files"))
    held = latest(rows, ["root"], "scanned_at", ["files", "total_bytes"])
    return held.select("root", "total_bytes", F.explode("files").alias("f")).select("root", F.col("f.key").alias("rel"), F.lower("f.value").alias("hash"), "total_bytes")


def project_groups(files: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``(component, root, similarity)`` of projects ``files (root, rel, hash)`` alike over chains.

    Similarity is the least among the pairs that met the threshold. Projects without digests are in no group.
    """
    sets = files.filter("hash IS NOT NULL").groupBy("root").agg(F.collect_set("hash").alias("items")).select(F.col("root").alias("id"), "items")
    pairs = jaccard_pairs(sets, threshold)
    found = components(pairs)
    least = pairs.join(found, F.col("a") == F.col("node")).groupBy("component").agg(F.min("similarity").alias("similarity")).withColumnRenamed("component", "c")
    return found.join(least, F.col("component") == F.col("c")).select("component", F.col("node").alias("root"), "similarity")


def tree_keepers(groups: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Members of tree groups with ``is_keeper`` and ``reason``; ``groups`` may have a ``git_head`` time.

    With two heads or more in a group the newest wins, of equal ones the first path; else members
    outside copy folders, where some are inside; then the fewest parts, then the smallest path.
    """
    rows = groups if "git_head" in groups.columns else groups.withColumn("git_head", F.lit(None).cast("bigint"))
    rows = rows.withColumn("copied", P.under_copy_folder(F.col("root"))).withColumn("depth", P.depth(F.col("root")))
    own = F.struct("depth", "root")
    facts = rows.groupBy("component").agg(
        F.count("git_head").alias("heads"), F.min(F.when(F.col("git_head").isNotNull(), F.struct((-F.col("git_head")).alias("h"), "root"))).alias("newest"), F.max("git_head").alias("head"),
        F.min(F.when(~F.col("copied"), own)).alias("outside"), F.max("copied").alias("some_copied"), F.min(own).alias("least"),
    ).withColumnRenamed("component", "c")
    pick = F.when(F.col("heads") >= 2, F.col("newest.root")).when(F.col("some_copied") & F.col("outside").isNotNull(), F.col("outside.root")).otherwise(F.col("least.root"))
    why = F.when(F.col("heads") >= 2, "newest git head").when(F.col("some_copied") & F.col("outside").isNotNull(), "outside copy folders").otherwise("shallowest path")
    out = rows.join(facts, F.col("component") == F.col("c"))
    penalty = F.when(F.col("copied"), weights["is_project_tree_backup_copy"]).otherwise(0.0) + F.when((F.col("heads") >= 2) & (F.col("git_head") < F.col("head")), weights["git_head_older"]).otherwise(0.0)
    return out.select(*groups.columns, (F.col("root") == pick).alias("is_keeper"), why.alias("reason"), F.when(F.col("root") == pick, 0.0).otherwise(penalty).alias("score"))


def tree_differences(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group and relative path the digest of each member, null where a member lacks the file.

    ``(component, rel, hashes, identical)``; members in path order. A path is identical if every member
    has it with one digest. Members of a group are few; its paths are spread over tasks.
    """
    members = groups.groupBy("component").agg(F.array_sort(F.collect_set("root")).alias("members")).withColumnRenamed("component", "c")
    held = files.join(groups.select("component", F.col("root").alias("r")), F.col("root") == F.col("r")).groupBy("component", "rel").agg(F.map_from_entries(F.collect_set(F.struct("root", "hash"))).alias("m"))
    rows = held.join(members, F.col("component") == F.col("c")).select("component", "rel", F.transform("members", lambda r: F.try_element_at("m", r)).alias("hashes"))
    return rows.withColumn("identical", F.forall("hashes", lambda h: h.isNotNull()) & (F.size(F.array_distinct("hashes")) == 1))


def tree_report(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: members, similarity, identical and differing files, the first differing ones, keeper, bytes of the rest."""
    diff = tree_differences(files, groups).groupBy("component").agg(
        F.count_if("identical").alias("identical_files"), F.count_if(~F.col("identical")).alias("differing_files"),
    ).withColumnRenamed("component", "c")
    sizes = files.select(F.col("root").alias("r"), "total_bytes").distinct()
    kept = tree_keepers(groups).join(sizes, F.col("root") == F.col("r"))
    each = kept.groupBy("component").agg(
        F.count("*").alias("n_members"), F.min("similarity").alias("similarity"), F.max(F.when(F.col("is_keeper"), F.col("root"))).alias("keeper"), F.max("reason").alias("reason"), F.sum(F.when(F.col("is_keeper"), 0).otherwise(F.col("total_bytes"))).alias("reclaim_bytes")
    )
    return each.join(diff, F.col("component") == F.col("c")).drop("c")


def shown_differences(files: DataFrame, groups: DataFrame, most: int = SHOWN_DIFFERENCES) -> DataFrame:
    """The first differing files of each group by path, at most ``most`` of them: what a report shows."""
    from pyspark.sql import Window

    rows = tree_differences(files, groups).filter(~F.col("identical"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("component").orderBy("rel"))).filter(F.col("place") <= most).select("component", "place", "rel", "hashes")


def covered(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with ``is_covered``: whether the path is one of ``roots (root)`` or below one; an equi-join over ancestors."""
    places = rows.select("path").distinct().select("path", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("dir"))
    hit = places.join(roots.select(F.col("root").alias("r")).distinct(), F.col("dir") == F.col("r"), "left_semi").select(F.col("path").alias("p")).distinct()
    return rows.join(hit, F.col("path") == F.col("p"), "left").withColumn("is_covered", F.col("p").isNotNull()).drop("p")


def uncovered_groups(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Exact groups that aren't wholly inside ``roots``: a tree stands for those that are."""
    return covered(members, roots).groupBy("full_hash").agg(F.count("*").alias("n_members"), F.count_if("is_covered").alias("n_covered")).filter("n_covered < n_members")
