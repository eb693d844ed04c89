"""Media signatures: perceptual hashes of grey pictures, and the text forms of sound and film signatures."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE, KEPT = 64, 16


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, n = np.arange(KEPT)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE))


def perceptual_hash(grid: np.ndarray) -> str | None:
    """256 bits of a 64 x 64 grey picture as hex: lowest cosine frequencies above their median; null for another shape."""
    if grid.size != SIDE * SIDE or not np.isfinite(grid).all():
        return None
    low = _cosines() @ grid.reshape(SIDE, SIDE) @ _cosines().T
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()


def picture_hash(pixels: Column) -> Column:
    """``perceptual_hash`` of an array column of 4096 grey values, in Arrow batches; null for unusable rows."""

    @F.pandas_udf("string")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if p is None else perceptual_hash(np.asarray(p, dtype=float)) for p in b], dtype=object)

    return hashed(pixels)


def sound_print(text: Column) -> Column:
    """``<seconds>:<payload>`` as struct (duration, words); the payload is URL-safe base64 of 32-bit numbers. Null if malformed."""

    @F.pandas_udf("array<bigint>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for p in b:
                try:
                    raw = base64.b64decode(p + "=" * (-len(p) % 4), altchars=b"-_", validate=True)
                    out.append(np.frombuffer(raw, dtype="<u4").astype("int64").tolist() if len(raw) % 4 == 0 else None)
                except (TypeError, ValueError):
                    out.append(None)
            yield pd.Series(out, dtype=object)

    duration = F.try_to_number(F.regexp_extract(text, r"^(\d+(?:\.\d+)?):", 1), F.lit("999999999.999999")).cast("double")
    return F.struct(duration.alias("duration"), words(F.nullif(F.regexp_replace(text, r"^[^:]*:?", ""), F.lit(""))).alias("words"))


def film_signature(text: Column) -> Column:
    """``<seconds>:<hash>,<hash>,...`` as struct (duration, frames). Null parts if malformed."""
    duration = F.try_to_number(F.regexp_extract(text, r"^(\d+(?:\.\d+)?):", 1), F.lit("999999999.999999")).cast("double")
    frames = F.filter(F.split(F.regexp_extract(text, r"^[^:]*:(.*)$", 1), ","), lambda f: f != "")
    return F.struct(duration.alias("duration"), F.when(F.size(frames) > 0, frames).alias("frames"))


def degrees(d: Column, m: Column, s: Column, reference: Column) -> Column:
    """Degrees, minutes and seconds with N, S, E or W as signed degrees."""
    value = d + F.coalesce(m, F.lit(0)) / 60.0 + F.coalesce(s, F.lit(0)) / 3600.0
    return F.when(F.upper(reference).isin("S", "W"), -value).otherwise(value)
