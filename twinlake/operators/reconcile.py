"""Aligning digests across sources: which files can be compared as they are and which must be fetched, within a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.functions import paths as P
from twinlake.operators.heavykeys import running_offsets
from twinlake.session import cut


def cross_source_buckets(files: DataFrame) -> DataFrame:
    """Rows outside archives whose size occurs in two or more sources, with what their bucket has in common.

    ``bucket_algorithm`` is the one algorithm all members' provider digests have, else null.
    """
    rows = files.filter("NOT is_archive_member AND size IS NOT NULL").withColumn("algorithm", P.digest_algorithm(F.col("foreign_hash")))
    facts = rows.groupBy("size").agg(
        F.count("*").alias("n_rows"), F.countDistinct("source_id").alias("n_sources"), F.count("algorithm").alias("n_tagged"), F.min("algorithm").alias("a0"), F.max("algorithm").alias("a1"), F.min("path").alias("first_path")
    )
    facts = facts.filter("n_rows >= 2 AND n_sources >= 2").select(F.col("size").alias("_s"), "first_path", F.when((F.col("n_tagged") == F.col("n_rows")) & (F.col("a0") == F.col("a1")), F.col("a0")).alias("bucket_algorithm"))
    return rows.join(facts, F.col("size") == F.col("_s")).drop("_s")


def canonical_choice(bucketed: DataFrame, cache: DataFrame) -> DataFrame:
    """How each row gets a comparable digest: ``choice`` and, where known, ``canonical``.

    ``same algorithm``: the digest after the colon; ``local``: its own; ``cached``: from ``cache (source_id,
    cloud_file_id, etag, blake3)``; ``fetch``: must be read; ``unfetchable``: lacks id or etag and keeps
    its old digest. Null cache keys match nothing.
    """
    known = cache.filter("source_id IS NOT NULL AND cloud_file_id IS NOT NULL AND etag IS NOT NULL").groupBy(F.col("source_id").alias("cs"), F.col("cloud_file_id").alias("cf"), F.col("etag").alias("ce")).agg(F.max("blake3").alias("cached"))
    rows = bucketed.join(known, (F.col("source_id") == F.col("cs")) & (F.col("cloud_file_id") == F.col("cf")) & (F.col("etag") == F.col("ce")), "left").drop("cs", "cf", "ce")
    choice = (
        F.when(F.col("bucket_algorithm").isNotNull(), "same algorithm").when(F.col("source_id") == "local", "local").when(F.col("cached").isNotNull(), "cached")
        .when(F.col("cloud_file_id").isNull() | F.col("etag").isNull(), "unfetchable").otherwise("fetch")
    )
    rows = rows.withColumn("choice", choice)
    canonical = F.when(F.col("choice") == "same algorithm", P.digest_hex(F.col("foreign_hash"))).when(F.col("choice") == "local", F.col("full_hash")).when(F.col("choice") == "cached", F.col("cached"))
    return rows.withColumn("canonical", canonical)


def within_budget(costs: DataFrame, order: Sequence[str], cost: str, budget: int, rounds: int = 10_000) -> DataFrame:
    """``costs`` with ``taken``: in ``order``, each row that still fits into what is left of ``budget``.

    Greedy with skipping: a row that doesn't fit is passed over and later ones are still tried. Not a
    running sum, but made of some: rows are range-partitioned in order once; a distributed running sum
    takes all rows up to the first that doesn't fit, rows above the rest are dropped, and so on, one
    job a round. What reaches the driver is the row that ends each round, at most ``rounds`` of them; more is an
    error. Null and negative costs count as 0. ``order`` must be unique and without nulls.
    """
    amount = F.greatest(F.coalesce(F.col(cost), F.lit(0)), F.lit(0)).cast("bigint")
    spark = costs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(costs.withColumn("_cost", amount).withColumn("_all", F.lit(0)).repartitionByRange(parts, *order).sortWithinPartitions(*order))
    at = F.struct(*order)
    left, stops = [max(0, budget)], []
    for _ in range(rounds):
        open_rows = rows.filter(F.col("_cost") <= left[-1])
        open_rows = open_rows.filter(at > stops[-1]) if stops else open_rows
        sums = running_offsets(open_rows, ["_all"], F.col("_cost"), [F.col(c) for c in order], "_before")
        stop = sums.filter(F.col("_before") + F.col("_cost") > left[-1]).agg(F.min(F.struct(*order, "_before")).alias("o")).first()["o"]
        if stop is None:
            break
        stops.append(_literal(stop, order, rows))
        left.append(left[-1] - stop["_before"])
    else:
        raise RuntimeError(f"the budget isn't settled after {rounds} rounds")
    if not stops:
        return rows.withColumn("taken", F.col("_cost") <= left[0]).drop("_cost", "_all")
    # A row is taken if what was left at the start of its round allows it and it didn't end that round.
    past = F.filter(F.array(*stops), lambda s: s <= at)
    taken = (F.col("_cost") <= F.get(F.array(*[F.lit(x).cast("bigint") for x in left]), F.size(past))) & ~F.array_contains(past, at)
    return rows.withColumn("taken", taken).drop("_cost", "_all")


def _literal(row, order: Sequence[str], df: DataFrame):
    return F.struct(*[F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in order])


def fetch_plan(choices: DataFrame, budget: int) -> DataFrame:
    """Per bucket that needs fetching its bytes and whether they are within the budget, by order of first path."""
    need = choices.filter("choice = 'fetch'").groupBy("size", "first_path").agg(F.count("*").alias("n_fetches"), F.sum("size").alias("bytes"))
    return within_budget(need, ["first_path", "size"], "bytes", budget)


def reconciled_files(choices: DataFrame, plan: DataFrame) -> DataFrame:
    """``(path, source_id, full_hash, reconciled, status)``: rows with comparable digests where there are any.

    A bucket over budget is deferred as a whole and its rows keep their digests; fetched rows stand
    with their own digest until the content is read. A local row is marked only if its digest changes.
    """
    taken = plan.select(F.col("size").alias("s"), F.col("taken"))
    rows = choices.join(taken, F.col("size") == F.col("s"), "left")
    deferred = ~F.coalesce("taken", F.lit(True))
    status = F.when(deferred, "budget exceeded").otherwise(F.col("choice"))
    new = F.when(~deferred & F.col("canonical").isNotNull(), F.col("canonical")).otherwise(F.col("full_hash"))
    return rows.select("path", "source_id", new.alias("full_hash"), ((F.col("source_id") != "local") & ~deferred & F.col("canonical").isNotNull() | ~new.eqNullSafe(F.col("full_hash"))).alias("reconciled"), status.alias("status"))
