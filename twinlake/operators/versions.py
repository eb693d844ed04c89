"""Keep-latest: one row per key out of several deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Per ``keys`` the row with the greatest ``order``.

    One aggregation over a maximum of structs, which combines map-side; Spark aggregates structs with
    strings by sorting each partition, but no key's rows are gathered or numbered.
    Null ``order`` counts as earliest. Equal ``order`` is decided by the greatest ``columns``,
    compared from left to right, so the result doesn't depend on row order. Null keys form keys
    of their own. Columns that aren't named are dropped.
    """
    picked = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)]))
    out = df.groupBy(*keys).agg(picked.alias("_row"))
    return out.select(*keys, *[F.col(f"_row._c{i}").alias(c) for i, c in enumerate(columns)])
