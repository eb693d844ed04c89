"""Checks before and after moving files: drift, cloud entries, destinations, trash candidates, apply and undo plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators.copydiff import same_etag

#: Seconds by which a file's time may differ from the plan's.
TIME_TOLERANCE = 1e-3
# Shapes of provider ids.
ID_SHAPES = {"gdrive": "^[a-zA-Z0-9_-]{20,}$", "onedrive": "^[a-zA-Z0-9!]{20,}$", "gphotos": "^[A-Za-z0-9_-]{20,}$", "icloud": "^[A-Za-z0-9-]{20,}$"}


def drifted(plan: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """``(key, status)`` of planned files against what is there: ``missing``, ``size``, ``time``, ``etag`` or ``same``.

    Etags, compared without notation, only count for rows that have one on the plan's side. Null keys are ignored.
    """
    there = now.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(F.struct("mtime", "size", "etag")).alias("_v"))
    rows = plan.filter(F.col(key).isNotNull()).join(there, F.col(key) == F.col("_k"), "left")
    status = (
        F.when(F.col("_k").isNull(), "missing").when(~F.col("size").eqNullSafe(F.col("_v.size")), "size").when(F.coalesce(F.abs(F.col("mtime") - F.col("_v.mtime")) > TIME_TOLERANCE, F.lit(False)), "time")
        .when(F.col("etag").isNotNull() & ~same_etag(F.col("etag")).eqNullSafe(same_etag(F.col("_v.etag"))), "etag").otherwise("same")
    )
    return rows.select(key, status.alias("status"))


def cloud_reject(accounts: Sequence[str]) -> Column:
    """Why a cloud row may not be acted on, by the first rule it breaks; null for local and sound rows."""
    source = F.col("source_id")
    shape = F.lit(True)
    for provider, pattern in ID_SHAPES.items():
        shape = F.when(F.substring_index(source, ":", 1) == provider, F.col("cloud_file_id").rlike(pattern)).otherwise(shape)
    return F.when(source == "local", None).when(~source.isin(*accounts, ""), "unknown account").when(F.coalesce("cloud_file_id", F.lit("")) == "", "no id").when(~shape, "odd id").when(F.coalesce("etag", F.lit("")) == "", "no etag").when(F.coalesce("is_shared", F.lit(False)), "shared")


def unknown_accounts(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Source ids of ``rows`` that aren't in the registry ``accounts (source_id)``, with their number of rows."""
    known = accounts.select(F.col("source_id").alias("k"))
    used = rows.filter("source_id IS NOT NULL AND source_id != 'local'").groupBy("source_id").agg(F.count("*").alias("n"))
    return used.join(known, F.col("source_id") == F.col("k"), "left_anti")


def destination_reject(dest: Column) -> Column:
    """Why a destination path is refused; null if it stays below its root."""
    return F.when(F.coalesce(dest, F.lit("")) == "", "empty").when(dest.startswith("/"), "absolute").when(F.array_contains(F.split(dest, "/"), ".."), "leaves its root").when(P.excluded_segment(dest), "excluded place")


def apply_plan(members: DataFrame, now: DataFrame, accounts: Sequence[str], roots: Sequence[str]) -> DataFrame:
    """``(path, rail, refusal)`` for what a report would remove: its rail and why it may not be, if so.

    ``members`` are discards with size, mtime, etag, source_id, cloud_file_id, is_shared and is_archive_member.
    Local files must lie below ``roots`` and outside excluded places; all must be as planned.
    """
    state = drifted(members, now).select(F.col("path").alias("_p"), "status")
    local = F.col("source_id") == "local"
    place = F.when(~local, None).when(F.col("is_archive_member"), "archive member").when(~P.within(F.col("path"), roots), "outside roots").when(P.excluded_place(F.col("path")) | P.excluded_segment(F.col("path")), "excluded place")
    rows = members.join(state, F.col("path") == F.col("_p"))
    return rows.select("path", F.when(local, "local").otherwise("cloud").alias("rail"), F.coalesce(place, cloud_reject(accounts), F.when(F.col("status") != "same", F.concat(F.lit("changed: "), F.col("status")))).alias("refusal"))


def trash_candidates(manifest: DataFrame, trash: DataFrame) -> DataFrame:
    """``(path, n_candidates, trash_path, verdict)``: the file in the trash that a moved file became.

    A name in the trash may have got a number before its suffix: names are reduced to the one before
    and equi-joined with size; of these only equal digests count. Several are ambiguous.
    """
    name = P.base_name(F.col("trash_path"))
    plain = F.array_distinct(F.array(name, F.regexp_replace(name, r"^(.+?) \d+(\.[^.]+)?$", "$1$2")))
    held = trash.select("trash_path", F.col("size").alias("_s"), F.col("full_hash").alias("_h"), F.explode(plain).alias("_n"))
    rows = manifest.withColumn("_name", P.base_name(F.col("path")))
    found = rows.join(held, (F.col("_name") == F.col("_n")) & (F.col("size") == F.col("_s")) & (F.col("full_hash") == F.col("_h")), "left")
    out = found.groupBy("path").agg(F.countDistinct("trash_path").alias("n_candidates"), F.min("trash_path").alias("trash_path"))
    verdict = F.when(F.col("n_candidates") == 0, "missing").when(F.col("n_candidates") > 1, "ambiguous").otherwise("found")
    return out.select("path", "n_candidates", F.when(F.col("n_candidates") == 1, F.col("trash_path")).alias("trash_path"), verdict.alias("verdict"))


def undo_plan(manifest: DataFrame, trash: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, step)``: restore what is found once in the trash and whose place is free, else why not."""
    found = trash_candidates(manifest, trash)
    taken = now.select(F.col("path").alias("_p")).distinct()
    rows = found.join(taken, F.col("path") == F.col("_p"), "left")
    return rows.select("path", F.when(F.col("verdict") != "found", F.concat(F.lit("refuse: "), F.col("verdict"))).when(F.col("_p").isNotNull(), "refuse: place taken").otherwise("restore").alias("step"))
