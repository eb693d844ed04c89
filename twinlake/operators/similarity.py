"""Near duplicates by signature: images by Hamming distance, audio and video by gated bit similarity, sets by Jaccard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.operators.components import components
from twinlake.session import cut

_EPS = 1e-9


def _words(hex_text: Column, digits: int = 8) -> Column:
    """Hex text as unsigned 32-bit numbers."""
    starts = F.sequence(F.lit(1), F.length(hex_text), F.lit(digits))
    return F.transform(starts, lambda i: F.conv(F.substr(hex_text, i, F.lit(digits)), 16, 10).cast("bigint"))


def bit_difference(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words, over the shorter one's length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    """Hamming distance of two hex texts; null for empty texts or unequal lengths."""
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), bit_difference(_words(a), _words(b)))


def hamming_pairs(codes: DataFrame, distance: int, bits: int = 256) -> DataFrame:
    """``(a, b, distance)`` of all distinct hex ``code`` values within ``distance`` bits; a < b.

    Pigeonhole bands: of distance + 1 bands, codes within the distance share one unchanged, so an
    equi-join on (band, bits) finds every pair and none is compared without sharing a band. Equal
    codes are one; codes of another length than ``bits`` and null codes are ignored.
    """
    bands, each = distance + 1, bits // 4
    cuts = [each * i // bands for i in range(bands + 1)]
    if distance >= each:
        raise ValueError("bands of whole hex digits need a distance below the number of digits")
    rows = codes.filter(F.length("code") == each).select("code").distinct()
    keys = rows.select("code", F.posexplode(F.array(*[F.substring("code", cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(bands)])).alias("band", "part"))
    other = keys.select(F.col("code").alias("b"), F.col("band").alias("bb"), F.col("part").alias("bp"))
    pairs = keys.join(other, (F.col("band") == F.col("bb")) & (F.col("part") == F.col("bp")) & (F.col("code") < F.col("b"))).select(F.col("code").alias("a"), "b").distinct()
    return pairs.withColumn("distance", hamming(F.col("a"), F.col("b"))).filter(F.col("distance") <= distance)


def audio_pairs(prints: DataFrame, threshold: float = 0.95, gate: float = 2.0) -> DataFrame:
    """``(a, b, similarity)`` of fingerprints ``(key, duration, words)`` alike by ``threshold``; a < b.

    Similarity is 1 - differing bits / (32 x samples) over the shorter print, and 0 if durations differ
    by more than ``gate`` seconds. Candidates share a duration bin and a 16-bit half at one place:
    at a threshold above 0.9375 fewer bits differ than there are halves, so one half is unchanged.
    Two empty prints within the gate are alike (they share an empty half). Null parts are ignored.
    """
    if threshold <= 1 - 1 / 16:
        raise ValueError("halves only find pairs above 0.9375")
    rows = prints.filter("key IS NOT NULL AND duration IS NOT NULL AND words IS NOT NULL").dropDuplicates(["key"])
    halves = F.flatten(F.transform("words", lambda w: F.array(F.shiftright(w, 16), w.bitwiseAND(0xFFFF))))
    halves = F.when(F.size("words") == 0, F.array(F.lit(-1).cast("bigint"))).otherwise(halves)
    keyed = rows.select("key", "duration", "words", F.floor(F.col("duration") / gate).alias("bin"), F.posexplode(halves).alias("at", "half"))
    a = keyed.select(F.col("key").alias("a"), F.col("duration").alias("da"), F.col("words").alias("wa"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("ba"), F.col("at").alias("ia"), F.col("half").alias("ha"))
    pairs = a.join(keyed, (F.col("ba") == F.col("bin")) & (F.col("ia") == F.col("at")) & (F.col("ha") == F.col("half")) & (F.col("a") < F.col("key")) & (F.abs(F.col("da") - F.col("duration")) <= gate))
    pairs = pairs.select("a", F.col("key").alias("b"), "wa", F.col("words").alias("wb")).dropDuplicates(["a", "b"])
    n = F.least(F.size("wa"), F.size("wb"))
    similarity = F.when((F.size("wa") == 0) & (F.size("wb") == 0), 1.0).when(n == 0, 0.0).otherwise(1 - bit_difference(F.col("wa"), F.col("wb")) / (32.0 * n))
    return pairs.select("a", "b", F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0)).alias("similarity")).filter(F.col("similarity") >= threshold - _EPS)


def _film_keys(rows: DataFrame, gate: float, bits: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """Both sides ``(key, id, duration, v, after)`` of the join of ``video_pairs``, the shorter and the longer film's.

    A key stands for frame count, span of durations, place, band and the band's value, either whole or
    without one hex digit; in the latter case the parities of the set bits have to differ, so equal values
    meet once only. ``v`` is the whole value, ``after`` that of the next band in the ring of bands, null
    unless the frame has all its digits. The longer film is in each span that a film up to twice the gate
    shorter is in.
    """
    digits, span = bits // 4, 4 * gate
    cuts = [digits * i // bands for i in range(bands + 1)]
    values = rows.select("id", "duration", "n", F.posexplode("frames").alias("at", "f")).select("id", "duration", "n", "at", (F.length("f") == digits).alias("full"), F.array(*[F.conv(F.substring("f", cuts[i] + 1, cuts[i + 1] - cuts[i]), 16, 10).cast("bigint") for i in range(bands)]).alias("vs"))
    v = [F.get("vs", F.lit(i)) for i in range(bands)]
    parts = [F.struct(F.lit(i).alias("band"), v[i].alias("v"), F.when(F.col("full"), v[(i + 1) % bands]).alias("after"), F.array(v[i], *[v[i].bitwiseAND(F.lit(~(15 << 4 * j)).cast("bigint")) for j in range(cuts[i + 1] - cuts[i])]).alias("masked")) for i in range(bands)]
    bands_of = values.select("id", "duration", "n", "at", F.inline(F.array(*parts))).filter("v IS NOT NULL")
    keyed = bands_of.select("id", "duration", "n", "at", "band", "v", "after", F.posexplode("masked").alias("left_out", "rest"))
    parity = lambda odd: F.when(F.col("left_out") == 0, 0).otherwise((F.bit_count("v") + odd) % 2)
    key = lambda s, odd: F.xxhash64("n", s, "at", "band", "left_out", "rest", parity(odd)).alias("key")
    shorter = keyed.select(key(F.floor(F.col("duration") / span), 0), "id", "duration", "v", "after")
    spans = F.sequence(F.floor((F.col("duration") - 2 * gate) / span), F.floor(F.col("duration") / span))
    return shorter, keyed.withColumn("span", F.explode(spans)).select(key("span", 1), "id", "duration", "v", "after")


def video_pairs(signatures: DataFrame, threshold: float = 0.9, gate: float = 5.0, bits: int = 256) -> DataFrame:
    """``(a, b, similarity)`` of signatures ``(key, duration, frames)``, frames being hex codes; a < b.

    Similarity is 1 - mean distance of frames at equal places / ``bits``; 0 for unequal numbers of
    frames or durations more than ``gate`` apart. The mean is reached by at least one frame. Of more bands
    than half of its distance, one has at most one bit changed, and with the next in the ring of bands at
    most twice the bands' mean (pigeonring): candidates share frame count, durations, place and a band but
    for one hex digit. Films are numbered and written once, so that the many keys carry numbers only; a
    plan can't tell how many keys come of a film, so their join is never a broadcast.
    """
    most, digits = int((1 - threshold) * bits + _EPS), bits // 4
    bands = most // 2 + 1
    if bands > digits or digits // bands > 14:
        raise ValueError("bands of 1 to 14 hex digits are needed")
    rows = signatures.filter("key IS NOT NULL AND duration IS NOT NULL AND size(frames) > 0").select("key", "duration", "frames")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartition(tasks, "key").dropDuplicates(["key"]).withColumn("n", F.size("frames")).withColumn("id", F.monotonically_increasing_id()))
    x, y = [side.alias(s) for side, s in zip(_film_keys(rows, gate, bits, bands), "xy")]
    apart = F.col("y.duration") - F.col("x.duration")
    changed = F.bit_count(F.col("x.v").bitwiseXOR(F.col("y.v")))
    after = F.coalesce(F.bit_count(F.col("x.after").bitwiseXOR(F.col("y.after"))), F.lit(0))
    alike = (changed <= 1) & (changed + after <= 2 * most // bands)
    ordered = ((apart > 0) | ((apart == 0) & (F.col("x.id") < F.col("y.id")))) & (apart <= gate)
    pairs = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & ordered & alike).select(F.col("x.id").alias("x"), F.col("y.id").alias("y")).distinct()
    left, right = [rows.select(F.col("id").alias(f"{s}i"), F.col("key").alias(f"{s}k"), F.col("frames").alias(f"{s}f"), F.col("n").alias(f"{s}n")) for s in "lr"]
    both = pairs.join(left, F.col("x") == F.col("li")).join(right, F.col("y") == F.col("ri"))
    total = F.aggregate(F.zip_with("lf", "rf", hamming), F.lit(0), lambda s, x: s + x)
    similarity = F.coalesce(F.least(F.greatest(1 - total / F.col("ln") / float(bits), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return both.select(F.least("lk", "rk").alias("a"), F.greatest("lk", "rk").alias("b"), similarity.alias("similarity")).filter(F.col("similarity") >= threshold - _EPS)


def jaccard_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, common, similarity)`` of sets ``(id, items)`` alike by ``threshold``; a < b; empty sets are in no pair.

    Items come rarest first; alike sets share one of their first items, so only these are joined, and
    by size where sizes allow it. Frequent items come last and are hardly ever among the first.
    """
    items = sets.filter("id IS NOT NULL").select("id", F.explode(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("t"))
    counts = items.groupBy("t").agg(F.count("*").alias("df")).select(F.col("t").alias("ct"), "df")
    ordered = items.join(counts, F.col("t") == F.col("ct")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("x")).select("id", F.col("x.t").alias("items"), F.size("x").alias("n"))
    keys = ordered.select("id", "n", F.explode(F.slice("items", 1, (F.col("n") - F.ceil(threshold * F.col("n") - _EPS) + 1).cast("int"))).alias("t"))
    other = keys.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("t").alias("bt"))
    sized = F.least("n", "nb") >= threshold * F.greatest("n", "nb") - _EPS
    pairs = keys.join(other, (F.col("t") == F.col("bt")) & (F.col("id") < F.col("b")) & sized).select(F.col("id").alias("a"), "b").distinct()
    left, right = [ordered.select(F.col("id").alias(f"{s}i"), F.col("items").alias(f"{s}x"), F.col("n").alias(f"{s}n")) for s in "lr"]
    both = pairs.join(left, F.col("a") == F.col("li")).join(right, F.col("b") == F.col("ri")).withColumn("common", F.size(F.array_intersect("lx", "rx")))
    return both.select("a", "b", "common", (F.col("common") / (F.col("ln") + F.col("rn") - F.col("common"))).alias("similarity")).filter(F.col("similarity") >= threshold - _EPS)


def near_groups(members: DataFrame, pairs: DataFrame, measure: str, worst: str) -> tuple[DataFrame, DataFrame]:
    """Groups of near duplicates: ``(component, ...)`` and ``(component, path, is_keeper, score)``.

    ``members (path, key, size, full_hash)``, ``pairs (a, b, measure)`` over keys. Groups join over
    chains of pairs; ``worst`` ('min' or 'max') of the measure is over pairs that met the threshold.
    Members with one key are in the key's group. Groups whose members all have one digest are left
    to the exact pass. The keeper is the largest file, then the largest path; the others score
    -1 - (1 - size / keeper's size).
    """
    found = components(pairs)
    part = F.min if worst == "min" else F.max
    stats = pairs.join(found, F.col("a") == F.col("node")).groupBy("component").agg(part(measure).alias(measure)).withColumnRenamed("component", "c")
    rows = members.join(found, F.col("key") == F.col("node")).select("component", "path", "size", "full_hash")
    groups = rows.groupBy("component").agg(
        F.count("*").alias("n_members"), F.min("size").alias("smallest"), F.max("size").alias("largest"), F.sum("size").alias("bytes"), F.max(F.struct("size", "path")).alias("k"), F.min("full_hash").alias("h0"), F.max("full_hash").alias("h1")
    )
    groups = groups.filter("h0 != h1").join(stats, F.col("component") == F.col("c"))
    groups = groups.select("component", "n_members", "smallest", "largest", measure, F.col("k.path").alias("keeper"), (F.col("bytes") - F.col("k.size")).alias("reclaim_bytes"))
    chosen = groups.select(F.col("component").alias("c"), "keeper", "largest")
    own = F.col("path") == F.col("keeper")
    ranked = rows.join(chosen, F.col("component") == F.col("c")).select("component", "path", own.alias("is_keeper"), F.when(own, 0.0).otherwise(F.when(F.col("largest") > 0, -1 - (1 - F.col("size") / F.col("largest"))).otherwise(-1.0)).alias("score"))
    return groups, ranked
