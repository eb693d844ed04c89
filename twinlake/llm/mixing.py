"""Mixing sources to target weights over fixed-length blocks of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlake.operators.heavykeys import running_offsets
from twinlake.session import SMALL_ROWS, cut

BLOCK_TOKENS, SHARD_SLOTS, SEED = 256, 1024, 20_250


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit integer hash of ``x`` under ``key``; wraps around."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of ``index`` under a keyed pseudorandom permutation of 0 to n - 1.

    A balanced Feistel network over the next even number of bits; values of n or more are sent
    through again until they fall below it, so it stays a permutation and needs no table.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            left, right = right, left ^ (_mix(right, key * 7 + r * 0x9E3779B97F4A7C15) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def blocks_of(df: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(source, block_no, doc_id, doc_start, n_tokens)``: documents laid end to end per source and cut.

    ``df (source, doc_id, n_tokens)``. Each row is the part of a document in one block; a block may
    hold parts of several documents and a document may run over several blocks. Starts come
    from exact offsets per partition, so a source with most documents is no bottleneck.
    """
    at = running_offsets(df, ["source"], F.col("n_tokens"), [F.col("doc_id")], "start").withColumn("end", F.col("start") + F.col("n_tokens"))
    last = F.floor((F.col("end") - 1) / block_tokens)
    spans = at.select("source", "doc_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block_tokens), last)).alias("block_no"))
    begin = F.greatest("start", F.col("block_no") * block_tokens)
    stop = F.least("end", (F.col("block_no") + 1) * block_tokens)
    return spans.select("source", "block_no", "doc_id", (begin - F.col("start")).alias("doc_start"), (stop - begin).alias("n_tokens"))


def mixture(
    docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, whole_shares_first: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The selection and the shares it reaches.

    ``docs (source, doc_id, n_tokens)``, ``targets (source, target_share, max_repeats)``. The
    selection has one row per part of a document in a filled slot: shard_id, slot_no, source,
    repeat_no, block_no, doc_id, doc_start, n_tokens. The shares have one row per target.

    Tokens are packed into blocks per source. The plan has ``total_tokens`` (by default as many as
    the documents of the targeted sources hold) in output shards of ``shard_slots`` blocks. In each
    shard the sources' counts of slots are one multinomial draw over the shares, with a generator seeded by
    shard, so any shard can be made again alone; with ``whole_shares_first`` the whole part of each
    share is given outright and only the rest drawn, which narrows the spread. A source's slots are numbered over all shards by exact offsets; slot
    j takes block perm(j mod blocks) of repeat j / blocks, each repeat under its own permutation.

    Slots beyond ``max_repeats`` stay empty: a source that is too small falls short rather than
    being repeated more often, and what it lacks isn't given to others. ``share_of_plan`` is
    measured against the plan, ``share_reached`` against the tokens selected. Documents of
    other or null sources, without id or tokens, aren't used. Targets are at most ``SMALL_ROWS``
    rows, else this refuses; duplicate sources among them too. Empty documents give no rows.
    """
    goal = targets.filter("source IS NOT NULL AND target_share > 0").select("source", "target_share", F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(0))).alias("max_repeats")).orderBy("source").limit(SMALL_ROWS + 1).collect()
    if len(goal) > SMALL_ROWS or len({g["source"] for g in goal}) < len(goal):
        raise ValueError("targets must be few and name each source once")
    spark, names = docs.sparkSession, [g["source"] for g in goal]
    known = spark.createDataFrame([(n,) for n in names], "known string")
    sized = docs.filter("doc_id IS NOT NULL AND n_tokens > 0").select("source", "doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    sized = cut(sized.join(F.broadcast(known), F.col("source") == F.col("known"), "left_semi"))
    held = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    blocks = np.array([-(-held.get(n, 0) // block_tokens) for n in names], dtype=np.int64)
    repeats = np.array([g["max_repeats"] for g in goal], dtype=np.int64)
    weight = np.array([g["target_share"] for g in goal], dtype=float)
    planned = sum(held.values()) if total_tokens is None else total_tokens
    slots = int(planned // block_tokens)
    shards = -(-slots // shard_slots)
    sources = len(names)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = weight / weight.sum()
        for b in batches:
            rows = []
            for shard in b["shard_id"]:
                n = min(shard_slots, slots - shard * shard_slots)
                rng = np.random.default_rng([seed, int(shard)])
                sure = np.floor(p * n + 1e-9).astype(np.int64) if whole_shares_first else np.zeros(sources, np.int64)
                rest = np.maximum(p * n - sure, 0)
                if (m := n - int(sure.sum())) > 0:
                    sure += rng.multinomial(m, rest / rest.sum() if rest.sum() > 0 else p)
                begin = np.cumsum(sure) - sure
                rows += [(int(shard), k, int(sure[k]), int(begin[k])) for k in range(sources) if sure[k]]
            yield pd.DataFrame(rows, columns=["shard_id", "k", "slots", "slot_begin"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = cut(spark.range(shards).withColumnRenamed("id", "shard_id").repartition(parts, "shard_id").mapInPandas(draw, "shard_id bigint, k int, slots bigint, slot_begin bigint"))
    numbered = running_offsets(drawn, ["k"], F.col("slots"), [F.col("shard_id")], "first")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # One shard at a time: what is expanded at once is bounded by its slots.
            for k, shard, count, slot, first in b[["k", "shard_id", "slots", "slot_begin", "first"]].itertuples(index=False):
                n = int(blocks[k])
                if not n:
                    continue
                inner = np.arange(count)
                inner = inner[(first + inner) // n < repeats[k]]
                repeat, block = np.divmod(first + inner, n)
                for r in np.unique(repeat):
                    mine = repeat == r
                    block[mine] = permuted(block[mine], n, seed * 1_000_003 + int(k) * 1009 + int(r))
                if len(inner):
                    yield pd.DataFrame({"shard_id": shard, "slot_no": slot + inner, "source": names[k], "repeat_no": repeat, "block_no": block})

    chosen = numbered.mapInPandas(fill, "shard_id bigint, slot_no bigint, source string, repeat_no bigint, block_no bigint")
    content = blocks_of(sized, block_tokens).select(F.col("source").alias("s"), F.col("block_no").alias("b"), "doc_id", "doc_start", "n_tokens")
    selection = chosen.join(content, (F.col("source") == F.col("s")) & (F.col("block_no") == F.col("b"))).drop("s", "b")

    selection = selection.select("shard_id", "slot_no", "source", "repeat_no", "block_no", "doc_id", "doc_start", "n_tokens")
    got = selection.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("repeat_no").alias("r"))
    asked = spark.createDataFrame([(n, float(w), int(r), int(held.get(n, 0))) for n, w, r in zip(names, weight, repeats)], "name string, target_share double, max_repeats bigint, tokens_held bigint")
    shares = asked.join(got, F.col("name") == F.col("source"), "left").select(
        F.col("name").alias("source"), "target_share", "max_repeats", "tokens_held", F.coalesce("t", F.lit(0)).alias("tokens_selected"), F.coalesce(F.col("r") + 1, F.lit(0)).alias("repeats_used"),
        (F.coalesce("t", F.lit(0)) / F.lit(float(max(1, slots * block_tokens)))).alias("share_of_plan"), F.coalesce(F.col("t") / F.sum("t").over(Window.partitionBy(F.lit(0))), F.lit(0.0)).alias("share_reached"),
    )
    return selection, shares


def mixture_held(selection: DataFrame, shares: DataFrame, docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per target whether the selection keeps its promises: ``(source, target_share, max_repeats, repeats_kept, blocks_once, share_kept)``.

    No part of a document is used more than ``max_repeats`` times; no block comes twice in a repeat and no
    slot holds two blocks; the share of the plan is within four standard deviations of its draw, or all
    repeats of the source are used up.
    """
    parts = selection.groupBy("source", "doc_id", "doc_start").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("uses")).withColumnRenamed("source", "us")
    slots = selection.select("source", "shard_id", "slot_no", "repeat_no", "block_no").distinct()
    once = slots.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("shard_id", "slot_no").alias("s"), F.countDistinct("repeat_no", "block_no").alias("b")).select(F.col("source").alias("os"), ((F.col("n") == F.col("s")) & (F.col("n") == F.col("b"))).alias("once"))
    known = shares.select(F.col("source").alias("known"))
    planned = docs.join(F.broadcast(known), F.col("source") == F.col("known"), "left_semi").filter("n_tokens > 0").agg(F.sum("n_tokens")).first()[0]
    planned = max(1.0, (planned or 0) / block_tokens)
    p = F.col("target_share")
    off = F.abs(F.col("share_of_plan") - p) <= 4 * F.sqrt(p * (1 - p) / planned) + 2 / planned
    rows = shares.join(parts, F.col("source") == F.col("us"), "left").join(once, F.col("source") == F.col("os"), "left")
    spent = F.col("tokens_selected") == F.col("tokens_held") * F.col("max_repeats")
    return rows.select("source", "target_share", "max_repeats", (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"), F.coalesce("once", F.lit(True)).alias("blocks_once"), (off | spent).alias("share_kept"))
