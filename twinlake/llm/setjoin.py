"""All similar pairs between set-valued records, by metric pivot partitioning under Jaccard distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.session import cut

#: Farthest a set may be from its pivot; beyond it a set is a pivot of its own. Below the threshold, so that guests share items with pivots.
RADIUS = 0.4
#: Hashes under which sets find pivots.
HASHES = 4
_EPS = 1e-9


def _distance(a: str, b: str) -> Column:
    common = F.size(F.array_intersect(a, b))
    return 1 - common / (F.size(a) + F.size(b) - common)


def _prefix(n: Column, t) -> Column:
    """How many of a set's first elements must hold one of any set at similarity ``t`` or more."""
    return n - F.ceil(t * n - _EPS) + 1


def _ordered(sets: DataFrame) -> DataFrame:
    """``(id, items, n, keys)``: items rarest first by exact counts; keys are minima of the shared items under ``HASHES`` hashes.

    A set without an item that another set has too is in no pair and is left out.
    """
    items = sets.select("id", F.explode("items").alias("t"))
    counts = items.groupBy("t").agg(F.count("*").alias("df")).select(F.col("t").alias("ct"), "df")
    ordered = items.join(counts, F.col("t") == F.col("ct")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("x"))
    shared = F.transform(F.filter("x", lambda e: e["df"] > 1), lambda e: e["t"])
    least = lambda j: F.array_min(F.transform(shared, lambda t: F.struct(F.xxhash64(t, F.lit(j)).alias("h"), t.alias("t"))))
    keys = F.array(*[F.struct(F.lit(j).alias("j"), least(j)["t"].alias("t")) for j in range(HASHES)])
    return cut(ordered.filter(F.exists("x", lambda e: e["df"] > 1)).select("id", F.col("x.t").alias("items"), F.size("x").alias("n"), keys.alias("keys")))


def _distances(ordered: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs (x, y, ...)`` with the distance ``d`` of the two sets."""
    a, b = [ordered.select(F.col("id").alias(f"{s}id"), F.col("items").alias(f"{s}items")) for s in "ab"]
    return pairs.join(a, F.col("x") == F.col("aid")).join(b, F.col("y") == F.col("bid")).withColumn("d", _distance("aitems", "bitems")).drop("aid", "bid", "aitems", "bitems")


def _homes(ordered: DataFrame) -> DataFrame:
    """``(id, pivot, d)``: the pivot of each set and its distance from it, at most ``RADIUS``."""
    keyed = ordered.select("id", "n", F.explode("keys").alias("k")).select("id", "n", "k.j", "k.t")
    leaders = keyed.groupBy("j", "t").agg(F.min(F.struct("id", "n")).alias("l")).select(F.col("j").alias("lj"), F.col("t").alias("lt"), F.col("l.id").alias("y"), F.col("l.n").alias("yn"))
    near = keyed.join(leaders, (F.col("j") == F.col("lj")) & (F.col("t") == F.col("lt"))).filter((F.col("id") != F.col("y")) & (F.least("n", "yn") >= (1 - RADIUS) * F.greatest("n", "yn") - _EPS))
    near = cut(_distances(ordered, near.select(F.col("id").alias("x"), "y").distinct()).filter(F.col("d") <= RADIUS + _EPS).select("x", "y", "d"))
    # A leader is smaller than those it leads: a set without a near leader is a pivot, each other one takes its nearest leader that is a pivot.
    led = near.select(F.col("x").alias("led")).distinct()
    first = near.join(led, F.col("y") == F.col("led"), "left_anti").groupBy("x").agg(F.min(F.struct("d", "y")).alias("m")).select("x", F.col("m.y").alias("y"), F.col("m.d").alias("d"))
    first = cut(first)
    # Those whose near leaders are led themselves take the nearest pivot that one of these has, if it is near enough, else they are pivots.
    over = near.join(first.select(F.col("x").alias("has")), F.col("x") == F.col("has"), "left_anti").join(first.select(F.col("x").alias("via"), F.col("y").alias("p")), F.col("y") == F.col("via")).select("x", F.col("p").alias("y")).distinct()
    second = _distances(ordered, over).filter(F.col("d") <= RADIUS + _EPS).groupBy("x").agg(F.min(F.struct("d", "y")).alias("m")).select("x", F.col("m.y").alias("y"), F.col("m.d").alias("d"))
    found = first.unionByName(second)
    return cut(ordered.select("id").join(found, F.col("id") == F.col("x"), "left").select("id", F.coalesce("y", "id").alias("pivot"), F.coalesce("d", F.lit(0.0)).alias("d")))


def _guests(ordered: DataFrame, homes: DataFrame, threshold: float) -> DataFrame:
    """``(x, cell, d, home)``: the sets of other cells within a cell's radius plus the join distance from its pivot."""
    reach = 1 - threshold

    def first(df: DataFrame, t, *more: str) -> DataFrame:
        return df.select("id", "n", *more, F.posexplode(F.slice("items", 1, _prefix(F.col("n"), t).cast("int"))).alias("pos", "t"))

    cells = homes.groupBy("pivot").agg(F.max("d").alias("radius"))
    pivots = ordered.join(cells, F.col("id") == F.col("pivot")).withColumn("s", 1 - F.col("radius") - reach)
    index = first(pivots, F.col("s"), "s").select(F.col("id").alias("p"), F.col("n").alias("pn"), "s", F.col("t").alias("pt"))
    probes = first(ordered, 1 - RADIUS - reach)
    guests = index.join(probes, (F.col("pt") == F.col("t")) & (F.col("p") != F.col("id")) & (F.col("pos") < _prefix(F.col("n"), F.col("s"))))
    guests = guests.filter(F.least("n", "pn") >= F.col("s") * F.greatest("n", "pn") - _EPS).select(F.col("id").alias("x"), F.col("p").alias("y"), "s").distinct()
    home_of = homes.select(F.col("id").alias("hid"), F.col("pivot").alias("home"))
    guests = guests.join(home_of, F.col("x") == F.col("hid")).filter(F.col("home") > F.col("y"))
    return _distances(ordered, guests).filter(F.col("d") <= 1 - F.col("s") + _EPS).select("x", F.col("y").alias("cell"), "d", "home")


def cells_of(sets: DataFrame, threshold: float) -> DataFrame:
    """``(cell, radius, hosts, guests)``: the cells that ``similar_sets`` joins within, their own sets and those replicated to them."""
    ordered = _ordered(sets)
    homes = _homes(ordered)
    guests = _guests(ordered, homes, threshold).groupBy(F.col("cell").alias("c")).agg(F.count("*").alias("g"))
    hosts = homes.groupBy(F.col("pivot").alias("cell")).agg(F.max("d").alias("radius"), F.count("*").alias("hosts"))
    return hosts.join(guests, F.col("cell") == F.col("c"), "left").select("cell", "radius", "hosts", F.coalesce("g", F.lit(0)).alias("guests"))


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, similarity)`` for all pairs of ``sets (id, items)`` of distinct, non-empty sets; id a < b.

    1. Items are ordered by exact counts, rarest first; sets that share no item are in no pair.
    2. Pivots: sets with an equal minimum of their shared items under one of ``HASHES`` hashes
       are near each other with a chance that is their similarity; the least of them leads. A set with no
       leader within ``RADIUS`` is a pivot, each other one is assigned to the nearest pivot it finds
       over its leaders. Which pivot a set gets doesn't change the result, only the work.
    3. A set is replicated to each cell whose pivot is within the cell's radius plus the join
       distance: by the triangle inequality only these can have a partner among the cell's own sets.
       They are found by an equi-join on first items at exactly that bound, then by distance.
    4. Within a cell, own sets meet own sets and guests if their distances to the pivot differ by
       no more than the join distance and their sizes allow it; similarity is then computed exactly.
       A pair with two cells is kept in that of the smaller pivot, so no pair comes twice.
    """
    if not RADIUS < threshold:
        raise ValueError(f"cells of radius {RADIUS} need a threshold above it")
    reach = 1 - threshold
    ordered = _ordered(sets)
    homes = _homes(ordered)
    guests = _guests(ordered, homes, threshold)
    sizes = ordered.select(F.col("id").alias("sid"), "n")
    visitors = guests.unionByName(homes.select(F.col("id").alias("x"), F.col("pivot").alias("cell"), "d", F.col("pivot").alias("home")))
    visitors = visitors.join(sizes, F.col("x") == F.col("sid")).select(F.col("x").alias("y"), F.col("cell").alias("ycell"), F.col("d").alias("yd"), "home", F.col("n").alias("yn"))
    hosts = homes.join(sizes, F.col("id") == F.col("sid")).select(F.col("id").alias("x"), F.col("pivot").alias("cell"), F.col("d").alias("xd"), F.col("n").alias("xn"))
    pairs = hosts.join(visitors, (F.col("cell") == F.col("ycell")) & (F.col("x") != F.col("y"))).filter(
        ((F.col("home") != F.col("cell")) | (F.col("x") < F.col("y"))) & (F.abs(F.col("xd") - F.col("yd")) <= reach + _EPS) & (F.least("xn", "yn") >= threshold * F.greatest("xn", "yn") - _EPS)
    )
    found = _distances(ordered, pairs.select("x", "y")).filter(F.col("d") <= reach + _EPS)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (1 - F.col("d")).alias("similarity"))


def similar_projects(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``(root_a, root_b)`` of all projects whose sets of file hashes overlap by ``threshold`` or more.

    Per root the latest scan holds. A set is the distinct non-null hashes in lower case; equal sets
    are joined as one and spread to their roots at the end. Empty sets (also a null map) form no
    pair; null roots are ignored. Hashes are compared by 64-bit digests of their text.
    """
    hashes = F.array_sort(F.array_distinct(F.transform(F.filter(F.map_values("file_hashes"), lambda h: h.isNotNull()), lambda h: F.xxhash64(F.lower(h)))))
    rows = df.filter("root IS NOT NULL").select("root", "scanned_at", hashes.alias("items"))
    held = rows.groupBy("root").agg(F.max(F.struct("scanned_at", "items")).alias("v")).select("root", F.col("v.items").alias("items")).filter("size(items) > 0")
    held = cut(held.withColumn("id", F.md5(F.concat_ws(",", F.transform("items", lambda h: h.cast("string"))))))
    sets = held.groupBy("id").agg(F.first("items").alias("items"))
    pairs = similar_sets(sets, threshold).select("a", "b").unionByName(sets.select(F.col("id").alias("a"), F.col("id").alias("b")))
    left, right = held.select(F.col("id").alias("lid"), F.col("root").alias("x")), held.select(F.col("id").alias("rid"), F.col("root").alias("y"))
    out = pairs.join(left, F.col("a") == F.col("lid")).join(right, (F.col("b") == F.col("rid")) & ((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))))
    return out.select(F.least("x", "y").alias("root_a"), F.greatest("x", "y").alias("root_b"))
