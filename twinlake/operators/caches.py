"""Caches as tables: upsert by file state, lookups with a time band, keep-latest, expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.operators.versions import latest

#: Seconds by which times of the same file state may differ.
TIME_BAND = 1e-6


def upserted(old: DataFrame, new: DataFrame, key: str = "path", state: Sequence[str] = ("size", "mtime"), values: Sequence[str] = ("partial_hash", "full_hash")) -> DataFrame:
    """The cache after ``new`` rows are put: where key and state agree, known values are kept unless given anew;
    where the state differs, the row is replaced, nulls included. Null keys are ignored; keys must be unique a side.
    """
    names = [key, *state, *values]
    a = old.filter(F.col(key).isNotNull()).select(*[F.col(c).alias(f"o_{c}") for c in names])
    b = new.filter(F.col(key).isNotNull()).select(*[F.col(c).alias(f"n_{c}") for c in names])
    both = a.join(b, F.col(f"o_{key}") == F.col(f"n_{key}"), "full_outer")
    same = F.lit(True)
    for c in state:
        kind = dict(old.dtypes)[c]
        same = same & (F.abs(F.col(f"o_{c}") - F.col(f"n_{c}")) <= TIME_BAND if kind in ("double", "float") else F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")))
    gone = F.col(f"n_{key}").isNull()
    out = [F.coalesce(f"n_{key}", f"o_{key}").alias(key)]
    out += [F.when(gone, F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in state]
    out += [F.when(gone, F.col(f"o_{c}")).when(F.coalesce(same, F.lit(False)), F.coalesce(f"n_{c}", f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in values]
    return both.select(*out)


def looked_up(files: DataFrame, cache: DataFrame, values: Sequence[str], keys: Sequence[str] = ("path", "size"), time: str = "mtime") -> DataFrame:
    """``files`` with the cached ``values`` and ``is_hit``: equal keys and a time within the band; equi-joined by key."""
    held = cache.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(time).alias("_t"), *[F.col(v).alias(f"_v_{v}") for v in values])
    on = F.abs(F.col(time) - F.col("_t")) <= TIME_BAND
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    out = files.drop(*values).join(held, on, "left")
    return out.select(*files.drop(*values).columns, *[F.col(f"_v_{v}").alias(v) for v in values], F.col("_t").isNotNull().alias("is_hit"))


def put_latest(cache: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """One row per key, the one computed last."""
    rest = [c for c in cache.columns if c not in keys and c != time]
    return latest(cache, keys, time, [time, *rest]).select(*cache.columns)


def unexpired(cache: DataFrame, time: str, now, seconds: float) -> DataFrame:
    """Rows computed no longer than ``seconds`` before ``now``; rows without a time are expired."""
    return cache.filter(F.col(time) >= F.lit(now) - F.lit(seconds))


def stage_replaced(stage: DataFrame, keys: Sequence[str] = ("scan_id", "path"), time: str = "staged_ts") -> DataFrame:
    """The staging table after every insert: a path staged again in a scan replaces its row."""
    return put_latest(stage, keys, time)


def cache_stats(cache: DataFrame, group: str, value: str) -> DataFrame:
    """Per ``group`` the rows and those with a value."""
    return cache.groupBy(group).agg(F.count("*").alias("n_rows"), F.count(value).alias("n_known"))
