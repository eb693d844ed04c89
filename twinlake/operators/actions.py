"""From findings to actions: the union of groups, rails, refusals of trees, organizer moves and their undoing, states of copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators.manifests import TIME_TOLERANCE, destination_reject
from twinlake.operators.trees import ancestors

#: Folders above a restored file that are looked at for being empty.
EMPTY_PARENTS = 8
#: Changed files that a message names.
SHOWN_CHANGES = 10


def actionable(groups: dict[str, DataFrame]) -> DataFrame:
    """``(kind, group_id, path, source_id, is_keeper, is_informational, size)`` of all groups that can be acted on.

    ``groups`` has the members of each kind: ``exact``, ``archive``, ``tree`` and the near-duplicate ones.
    A path can be in groups of several kinds; rows aren't merged.
    """
    out = None
    for kind, members in groups.items():
        rows = members.select(F.lit(kind).alias("kind"), F.col("group_id").cast("string").alias("group_id"), "path", "source_id", "is_keeper", "is_informational", F.col("size").cast("bigint").alias("size"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no kind of group is given")
    return out


def by_rail(members: DataFrame) -> DataFrame:
    """``(kind, group_id, path, size, rail)`` of what would be removed: trees whole, else local files or cloud entries.

    Neither kept nor informational; only of groups that keep a member.
    """
    kept = members.filter("is_keeper").select(F.col("kind").alias("_k"), F.col("group_id").alias("_g")).distinct()
    gone = members.filter("NOT is_keeper AND NOT is_informational").join(kept, (F.col("kind") == F.col("_k")) & (F.col("group_id") == F.col("_g")), "left_semi")
    rail = F.when(F.col("kind") == "tree", "tree").when(F.col("source_id") == "local", "local").otherwise("cloud")
    return gone.select("kind", "group_id", "path", "size", rail.alias("rail"))


def tree_refusals(discards: DataFrame, folders: DataFrame, roots: Sequence[str], active_homes: Sequence[str]) -> DataFrame:
    """``(root, refusal)``: why a project may not be removed whole; null if it may.

    ``discards (root, git_state)``: ``none``, ``clean`` or ``dirty``; null is unknown, which refuses too.
    ``folders (dir)`` are the folders there are. Tests in this order: homes are set, place, is a folder,
    below the scan roots, below an active home, git state.
    """
    there = folders.select(F.col("dir").alias("_d")).distinct()
    rows = discards.join(there, F.col("root") == F.col("_d"), "left")
    root = F.col("root")
    refusal = (
        F.when(F.lit(not active_homes), "no active homes").when(P.excluded_place(root) | P.excluded_segment(root), "excluded place").when(F.col("_d").isNull(), "not a folder").when(~P.within(root, roots), "outside roots")
        .when(~P.within(root, active_homes) if active_homes else F.lit(True), "outside active homes").when(F.col("git_state").isNull(), "git state unknown").when(F.col("git_state") == "dirty", "uncommitted changes")
    )
    return rows.select("root", refusal.alias("refusal"))


def organizer_moves(plan: DataFrame, now: DataFrame, roots: Sequence[str]) -> DataFrame:
    """``(path, destination, step)``: ``move``, or why not, for each entry of ``plan (path, destination, size, mtime)``.

    Sources must be below ``roots``, outside excluded places and as planned; destinations must stay
    below their root. ``now (path, size, mtime)`` has each path once. Destinations are already apart
    (``organize.final_names``); two entries with one are both refused.
    """
    there = now.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    often = plan.groupBy(F.col("destination").alias("_d")).agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = plan.join(there, F.col("path") == F.col("_p"), "left").join(often, F.col("destination") == F.col("_d"), "left")
    place = F.when(P.excluded_place(F.col("path")) | P.excluded_segment(F.col("path")), "excluded source").when(~P.within(F.col("path"), roots), "outside roots")
    bad = destination_reject(F.col("destination"))
    state = F.when(F.col("_p").isNull(), "missing").when(~F.col("size").eqNullSafe(F.col("_s")), "changed: size").when(F.coalesce(F.abs(F.col("mtime") - F.col("_m")) > TIME_TOLERANCE, F.lit(False)), "changed: time")
    step = F.coalesce(place, F.when(bad.isNotNull(), F.concat(F.lit("destination: "), bad)), F.when(F.col("_d").isNotNull(), "destination taken"), state)
    return rows.select("path", "destination", F.when(step.isNull(), "move").otherwise(F.concat(F.lit("refuse: "), step)).alias("step"))


def organizer_undo(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, destination, step)``: each moved file of ``manifest (path, destination)`` goes back, or why not.

    Refused are excluded places, files gone from their destination and places taken meanwhile. ``now (path)``
    are the files there are; ``destination`` is a path as in ``now``.
    """
    there = now.select("path").distinct()
    rows = manifest.join(there.select(F.col("path").alias("_d")), F.col("destination") == F.col("_d"), "left").join(there.select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left")
    why = F.when(P.excluded_place(F.col("path")) | P.excluded_segment(F.col("path")), "excluded place").when(F.col("_d").isNull(), "gone from destination").when(F.col("_p").isNotNull(), "place taken")
    return rows.select("path", "destination", F.when(why.isNull(), "restore").otherwise(F.concat(F.lit("refuse: "), why)).alias("step"))


def emptied_folders(restored: DataFrame, now: DataFrame, dest_root: str, hops: int = EMPTY_PARENTS) -> DataFrame:
    """``(dir)``: folders below ``dest_root`` that hold nothing once the ``restored (destination)`` files are gone.

    At most ``hops`` folders above each such file are looked at, and none at or above the root. A folder is
    empty if no other file is anywhere below it.
    """
    above = lambda c: F.filter(ancestors(c), lambda d: d.startswith(dest_root.rstrip("/") + "/"))
    gone = restored.select("destination").distinct()
    near = gone.select(F.explode(F.slice(F.reverse(above(F.col("destination"))), 1, hops)).alias("dir")).distinct()
    left = now.join(gone, F.col("path") == F.col("destination"), "left_anti").select(F.explode(above(F.col("path"))).alias("_d")).distinct()
    return near.join(left, F.col("dir") == F.col("_d"), "left_anti")


def new_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(name)``: base names that are in ``after (path)`` and weren't in ``before (path)``."""
    name = P.base_name(F.col("path"))
    return after.select(name.alias("name")).subtract(before.select(name.alias("name")))


def shown_changes(states: DataFrame, most: int = SHOWN_CHANGES) -> DataFrame:
    """The first ``most`` files by path whose state is not ``same``: what a message names; the count stands beside it."""
    return states.filter("status != 'same'").orderBy("path").limit(most)


def copy_states(manifest: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(source_path, state, reason)`` after a copy run over ``manifest (source_path, action, state)``.

    ``outcomes (source_path, size, uploaded_size, error)`` has one row a finished attempt. Rows done stay
    done; what isn't to be copied is skipped; without an outcome a row stays pending; an error or unequal sizes
    make it an error, which a later run tries again.
    """
    tried = outcomes.groupBy(F.col("source_path").alias("_p")).agg(F.max(F.struct(F.col("error").isNull().alias("ok"), "size", "uploaded_size", "error")).alias("o"))
    rows = manifest.join(tried, F.col("source_path") == F.col("_p"), "left")
    short = ~F.col("o.size").eqNullSafe(F.col("o.uploaded_size"))
    state = (
        F.when(F.col("state") == "done", "done").when(F.col("action") != "copy", "skipped").when(F.col("_p").isNull(), "pending").when(~F.col("o.ok") | short, "error").otherwise("done")
    )
    reason = F.when((F.col("state") != "done") & (F.col("action") == "copy"), F.when(~F.col("o.ok"), F.col("o.error")).when(F.col("_p").isNotNull() & short, "sizes differ"))
    return rows.select("source_path", state.alias("state"), reason.alias("reason"))


def content_verdicts(manifest: DataFrame) -> DataFrame:
    """``(source_path, verdict)`` of rows done by the digests read from both ends: ``verified``, ``mismatch`` or ``unread``."""
    a, b = F.lower("source_blake3"), F.lower("dest_blake3")
    verdict = F.when(a.isNull() | b.isNull(), "unread").when(a == b, "verified").otherwise("mismatch")
    return manifest.filter("state = 'done'").select("source_path", verdict.alias("verdict"))


def byte_budget(megabytes: float) -> int:
    """Megabytes as bytes; nothing for a negative number."""
    return max(0, int(megabytes * 1024 * 1024))


def signed(x: Column) -> Column:
    """A contribution as text with its sign and two decimals."""
    return F.concat(F.when(x < 0, "-").otherwise("+"), F.format_string("%.2f", F.abs(x)))
