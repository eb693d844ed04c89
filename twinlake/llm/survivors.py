"""Best representative of each duplicate group: survivorship field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def surviving_fields(df: DataFrame, keys: Sequence[str], fields: Mapping[str, Column], order: str, priority: Column | None = None) -> DataFrame:
    """Per ``keys`` one row in which every field has its best value, each judged on its own.

    One aggregation: per field the maximum of the struct (is there, source priority, ``order``,
    value). So a null never replaces a value, a trusted source beats a later one, and equal
    order is decided by the greater value. Pre-aggregates map-side; no key is gathered.
    """
    priority = F.lit(0) if priority is None else priority
    best = [F.max(F.struct(v.isNotNull().alias("a"), priority.alias("p"), F.col(order).alias("o"), v.alias("v"))).alias(f"_{n}") for n, v in fields.items()]
    return df.groupBy(*keys).agg(*best).select(*keys, *[F.col(f"_{n}.v").alias(n) for n in fields])


def best_members(df: DataFrame) -> DataFrame:
    """``(group_id, path)``: the surviving member of each duplicate group.

    A member is a group with a non-null path; its score, is_proposed_keeper and is_informational
    each take the latest non-null value, NaN counting as null. In groups of two or more members,
    those with a score and is_informational 0 compete: highest score, then is_proposed_keeper 1
    before 0 or null, then smallest path. Groups without such a member, and a null group, give no row.
    """
    value = {
        "score": F.when(~F.isnan("score"), F.col("score")),
        "is_proposed_keeper": F.col("is_proposed_keeper"),
        "is_informational": F.col("is_informational"),
    }
    members = surviving_fields(df.filter("path IS NOT NULL AND group_id IS NOT NULL"), ["group_id", "path"], value, "scored_at")
    valid = F.col("score").isNotNull() & (F.col("is_informational") == 0)
    rank = F.struct((-F.col("score")).alias("s"), (-F.coalesce("is_proposed_keeper", F.lit(0))).alias("k"), F.col("path").alias("path"))
    groups = members.groupBy("group_id").agg(F.min(F.when(valid, rank)).alias("best"), F.count("*").alias("n"))
    return groups.filter("n >= 2 AND best IS NOT NULL").select("group_id", F.col("best.path").alias("path"))
