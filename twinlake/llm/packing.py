"""Filling containers of one fixed capacity: hierarchical multi-length packing."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlake.operators.heavykeys import running_offsets
from twinlake.session import cut

CAPACITY, TIERS, STEP_CONTAINERS = 2048, 4, 64


@dataclass(frozen=True)
class Segment:
    """The pieces of one length with ranks ``first`` to ``end``: ``copies`` windows, ``offset`` in each."""

    length: int
    first: int
    end: int
    window: int
    copies: int
    offsets: tuple[int, ...]
    tier: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY, tiers: int = TIERS) -> tuple[list[Segment], list[int]]:
    """Segments that place all pieces, and the windows of each tier.

    The input is a count per length, so planning takes time and memory bounded by ``capacity``
    whatever the number of pieces. Tier k has windows of capacity / 2^k and takes the lengths above
    half of that, the last tier all that are shorter. From the longest tier down, each length opens
    windows, and the gap is filled with the longest lengths left that still fit, from shorter
    tiers too. All windows that are filled alike form one segment per length.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths, used, out, windows = sorted(left), dict.fromkeys(left, 0), [], []

    def take(n: int, count: int) -> int:
        first = used[n]
        used[n] += count
        left[n] -= count
        if not left[n]:
            lengths.remove(n)
        return first

    for tier in range(tiers):
        size, made = capacity >> tier, 0
        floor = size // 2 if tier < tiers - 1 else 0
        while lengths and lengths[-1] > floor:
            recipe: list[int] = []
            gap, spare = size, dict(left)
            while (i := bisect_right(lengths, gap)) > 0:
                n = next((lengths[j] for j in range(i - 1, -1, -1) if spare[lengths[j]] > 0), 0)
                if not n:
                    break
                recipe.append(n)
                spare[n] -= 1
                gap -= n
            times = {n: recipe.count(n) for n in recipe}
            copies = min(left[n] // t for n, t in times.items())
            at, offsets = 0, {}
            for n in recipe:
                offsets.setdefault(n, []).append(at)
                at += n
            for n, t in times.items():
                first = take(n, copies * t)
                out.append(Segment(n, first, first + copies * t, made, copies, tuple(offsets[n]), tier))
            made += copies
        windows.append(made)
    return out, windows


def packed(df: DataFrame, capacity: int = CAPACITY, tiers: int = TIERS, step_containers: int = STEP_CONTAINERS) -> DataFrame:
    """Places of all pieces of ``df (doc_id, n_tokens)`` in containers of ``capacity`` tokens.

    Columns: doc_id, piece_no, piece_start, piece_tokens, tier, container_id, container_start and
    step_group. Only a document above the capacity is split, into full pieces and a rest.

    Pieces are counted per length (at most ``capacity`` counts reach the driver), planned there, and
    placed by their number among the pieces of their length, which is made by exact offsets per
    partition, so a length shared by most documents is no bottleneck. Windows of all tiers, longest
    first, fill the containers without gaps between windows. Steps of about ``step_containers``
    containers take them in turn, so each step gets its share of every tier and fill.

    A document of 0 tokens comes out with null container columns; null ids and counts are ignored.
    Equal rows are packed as often as they come. Empty input gives no rows.
    """
    if capacity % (1 << (tiers - 1)):
        raise ValueError("capacity must be a multiple of the shortest tier's window")
    rows = df.filter("doc_id IS NOT NULL AND n_tokens IS NOT NULL").select("doc_id", F.col("n_tokens").cast("bigint").alias("n"))
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(capacity).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    pieces = rows.select("doc_id", "n", F.posexplode(starts).alias("piece_no", "piece_start"))
    pieces = cut(pieces.select("doc_id", "piece_no", "piece_start", F.least(F.lit(capacity), F.col("n") - F.col("piece_start")).cast("int").alias("piece_tokens")))
    histogram = {r[0]: r[1] for r in pieces.filter("piece_tokens > 0").groupBy("piece_tokens").count().collect()}
    segments, windows = plan(histogram, capacity, tiers)

    shares = [1 << (tiers - 1 - t) for t in range(tiers)]  # a window's size in windows of the last tier
    base = np.cumsum([0, *(w * s for w, s in zip(windows, shares))])
    containers = -(-int(base[-1]) // shares[0])
    steps = max(1, -(-containers // step_containers))
    segments.sort(key=lambda s: (s.length, s.first))
    length, first, tier, window, copies = (np.array([getattr(s, c) for s in segments], dtype=np.int64) for c in ("length", "first", "tier", "window", "copies"))
    keys = (length << 44) + first
    offsets = np.array([o for s in segments for o in s.offsets], dtype=np.int64)
    begin = np.cumsum([0, *(len(s.offsets) for s in segments)])
    share = np.array(shares, dtype=np.int64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = b["row_no"].to_numpy(dtype=np.int64)
            at = np.searchsorted(keys, (b["piece_tokens"].to_numpy(dtype=np.int64) << 44) + rank, side="right") - 1
            r = rank - first[at]
            slot = base[tier[at]] + (window[at] + r % copies[at]) * share[tier[at]]
            container = slot // shares[0]
            start = (slot % shares[0]) * (capacity // shares[0]) + offsets[begin[at] + r // copies[at]]
            yield b.drop(columns="row_no").assign(tier=tier[at].astype("int32"), container_id=container, container_start=start.astype("int32"), step_group=container % steps)

    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, piece_no int, piece_start bigint, piece_tokens int, tier int, container_id bigint, container_start int, step_group bigint"
    placed = running_offsets(pieces.filter("piece_tokens > 0"), ["piece_tokens"], order=[F.col("doc_id"), F.col("piece_no")]).mapInPandas(place, schema)
    empty = pieces.filter("piece_tokens = 0").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("tier", "int"), ("container_id", "bigint"), ("container_start", "int"), ("step_group", "bigint"))])
    return placed.unionByName(empty)


def fill_report(places: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, containers, tokens, the fullest container and the share of capacity used."""
    full = places.filter("container_id IS NOT NULL")
    return full.groupBy("container_id").agg(F.count("*").alias("p"), F.sum("piece_tokens").alias("t")).agg(
        F.sum("p").alias("pieces"), F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), (F.sum("t") / (F.count("*") * capacity)).alias("share_used")
    )


def packing_held(places: DataFrame, docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per document ``(doc_id, whole, inside, split_only_if_long)``: whether the packing keeps its promises.

    Its pieces follow each other and are all its tokens; none reaches over the container's end or into another
    piece; more than one piece only above the capacity. ``docs (doc_id, n_tokens)`` has each id once.
    """
    by_place, by_piece = Window.partitionBy("container_id").orderBy("container_start"), F.col("container_start") + F.col("piece_tokens")
    free = F.coalesce(F.lag(by_piece).over(by_place), F.lit(0)) <= F.col("container_start")
    filled = places.filter("container_id IS NOT NULL").withColumn("fits", free & (by_piece <= capacity))
    every = filled.unionByName(places.filter("container_id IS NULL").withColumn("fits", F.lit(True)))
    pieces = every.groupBy(F.col("doc_id").alias("of")).agg(F.count("*").alias("pieces"), F.sum("piece_tokens").alias("tokens"), F.sum(F.when(F.col("piece_start") == F.col("piece_no") * capacity, 0).otherwise(1)).alias("astray"), F.min("fits").alias("fits"))
    rows = docs.join(pieces, F.col("doc_id") == F.col("of"), "left")
    whole = (F.col("tokens") == F.col("n_tokens")) & (F.col("astray") == 0)
    return rows.select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"), F.coalesce("fits", F.lit(False)).alias("inside"), F.coalesce((F.col("pieces") == 1) | (F.col("n_tokens") > capacity), F.lit(False)).alias("split_only_if_long"))
