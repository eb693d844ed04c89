"""Changes between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlake.operators.versions import latest
from twinlake.session import broadcast_if_small


def row_hash(columns: Sequence[str]):
    """Hash of the columns' values; nulls are told apart from any value and by position."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def snapshot_changes(
    df: DataFrame,
    snapshot: str = "snapshot_id",
    part: str = "source_id",
    key: str = "path",
    delivered: str = "delivered_at",
    exact: Sequence[str] = ("size",),
    tolerant: Mapping[str, float] | None = None,
) -> DataFrame:
    """Rows ``(snapshot, key, change)`` with change ``added``, ``removed`` or ``changed``.

    ``df`` holds full snapshots, possibly with repeated and late deliveries: per snapshot and key
    the row with the latest ``delivered`` holds (see ``latest``). Each snapshot of a ``part`` is
    compared with the part's latest earlier snapshot that has rows, so a part missing from a whole
    delivery isn't reported as removed. The first snapshot of a part yields nothing.

    A full outer join on the key compares canonical row hashes; a missing side is an addition or a
    removal. Where hashes differ, the values decide: ``exact`` columns null-safely, ``tolerant``
    ones by a difference above the given bound (null against a value differs, NaN equals NaN).

    Rows are shuffled once, by key: deduplication and both sides of the join use that exchange, as
    snapshot and part are compared in the join's residual condition. A key has at most as many
    rows as there are deliveries of it, so no partition is heavy. Rows with a null key or snapshot
    have no identity and are ignored; a null part is a part of its own. Empty input gives no rows.
    """
    tolerant = {"mtime": 1e-3} if tolerant is None else dict(tolerant)
    values = [*exact, *tolerant]
    rows = df.filter(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).select(
        F.col(key).alias("k"), F.col(snapshot).alias("s"), F.col(part).alias("p"), F.col(delivered).alias("d"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)]
    )
    names = [f"v{i}" for i in range(len(values))]
    held = latest(rows.repartition("k"), ["k", "s"], "d", ["p", *names]).withColumn("h", row_hash(names))

    by_part = Window.partitionBy("p").orderBy("s")
    steps = rows.select("p", "s").distinct().withColumn("before", F.lag("s").over(by_part)).withColumn("after", F.lead("s").over(by_part))
    steps = broadcast_if_small(steps.select(F.col("p").alias("sp"), F.col("s").alias("ss"), "before", "after"))
    held = held.join(steps, F.col("p").eqNullSafe(F.col("sp")) & (F.col("s") == F.col("ss")), "left")

    def side(prefix: str, at, keep) -> DataFrame:
        return held.filter(keep).select(F.col("k").alias(f"{prefix}k"), at.alias(f"{prefix}at"), F.col("p").alias(f"{prefix}p"), F.col("h").alias(f"{prefix}h"), *[F.col(c).alias(prefix + c) for c in names])

    new, old = side("n", F.col("s"), F.col("before").isNotNull()), side("o", F.col("after"), F.col("after").isNotNull())
    # Both sides are partitioned by key alone; these conditions mix the sides, so they stay residual.
    same_step = (F.col("nat") - F.col("oat")) == 0
    same_part = F.size(F.array_distinct(F.array("np", "op"))) == 1
    both = new.join(old, (F.col("nk") == F.col("ok")) & same_step & same_part, "full_outer")

    differs = F.lit(False)
    for i, c in enumerate(values):
        a, b = F.col(f"nv{i}"), F.col(f"ov{i}")
        differs = differs | (~a.eqNullSafe(b) if c in exact else (a.isNull() != b.isNull()) | F.coalesce((F.abs(a - b) > tolerant[c]) & ~a.eqNullSafe(b), F.lit(False)))
    change = F.when(F.col("ok").isNull(), "added").when(F.col("nk").isNull(), "removed").when((F.col("nh") != F.col("oh")) & differs, "changed")
    return both.select(F.coalesce("nat", "oat").alias(snapshot), F.coalesce("nk", "ok").alias(key), change.alias("change")).filter(F.col("change").isNotNull())
