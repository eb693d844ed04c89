"""Films alike: complete at the edges of bins and bands, and no broadcast of the many keys of a film."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import rows
from tests.test_queries import FOLDER, _rows
from twinlake.functions import paths as P
from twinlake.operators import similarity
from twinlake.plans.inventory import SUFFIX


@pytest.fixture
def small_broadcasts(spark):
    """A broadcast above 48 MB fails, as larger ones do for want of the driver's memory; Spark counts at least a page of 32 MB."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "48MB")
    yield spark
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.fixture(scope="module")
def films(tmp_path_factory):
    """The small table's film files, 40 times with other hashes."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    import duckdb

    folder = str(tmp_path_factory.mktemp("films"))
    kinds = ", ".join(repr(x) for x in P.VIDEO_SUFFIXES)
    duckdb.sql(f"""COPY (SELECT * REPLACE ('/' || (100 + r) || path AS path, sha256(full_hash || r) AS full_hash) FROM '{FOLDER}/files.parquet', range(40) t(r)
        WHERE {SUFFIX} IN ({kinds})) TO '{folder}/files.parquet'""")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW files AS SELECT * FROM '{folder}/files.parquet'")
    return folder, con


def compared(spark, films, name):
    folder, con = films
    got, want = entry.queries()[name](spark, folder).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert _rows(got) == _rows(want) and len(want) > 0


def test_groups_of_films_broadcast_no_keys(small_broadcasts, films):
    compared(small_broadcasts, films, "video_groups")


def test_pairs_of_films_broadcast_no_keys(small_broadcasts, films):
    compared(small_broadcasts, films, "video_pairs")


def test_films_with_an_equal_frame_meet_once_a_band(spark):
    equal, one_off = "5a" * 32, "5a" * 31 + "5b"
    df = spark.createDataFrame([(1, 3.0, 1, [equal]), (2, 4.0, 1, [equal]), (3, 44.0, 1, [one_off])], "id long, duration double, n int, frames array<string>")
    x, y = similarity._film_keys(df, 5.0, 256, 13)
    met = x.join(y.select("key", y["id"].alias("other")), "key").groupBy("id", "other").count().collect()
    assert sorted(map(tuple, met)) == [(1, 1, 13), (1, 2, 13), (2, 1, 13), (2, 2, 13), (3, 3, 13)]
    x, y = similarity._film_keys(df.withColumn("duration", F.lit(1.0)), 5.0, 256, 13)
    assert x.join(y.select("key", y["id"].alias("other")), "key").filter("id = 1 AND other = 3").count() == 13


def test_films_at_the_edges_of_bins_and_bands(spark):
    rng = random.Random(9)
    films = []
    for i in range(10):
        frames, d = [rng.getrandbits(256) for _ in range(5)], rng.choice([0.0, 10.0, 19.5, 20.0, 39.5, 1e6])
        films.append((f"{i}", d, frames))
        for j in range(8):
            most = [rng.sample(range(256), n) for n in rng.sample([25, 25, 26, 26, rng.choice([24, 26, 27])], 5)]
            films.append((f"{i}{j}", max(d + rng.choice([-5.5, -5.0, -0.5, 0.0, 0.0, 4.5, 5.0, 5.5]), 0.0), [f ^ sum(1 << b for b in bits) for f, bits in zip(frames, most)]))
    near = lambda a, b: abs(a[1] - b[1]) <= 5 and sum((x ^ y).bit_count() for x, y in zip(a[2], b[2])) <= 128
    want = {(a[0], b[0]) for a, b in itertools.combinations(sorted(films), 2) if near(a, b)}
    told = [(k, d, [f"{f:064X}" if rng.random() < 0.3 else f"{f:064x}" for f in frames]) for k, d, frames in films]
    told += [(None, 0.0, told[0][2]), ("none", None, told[0][2]), ("nan", float("nan"), told[0][2]), ("inf", float("inf"), told[0][2]), ("gap", told[0][1], [None, *told[0][2][1:]]), told[0]]
    got = rows(similarity.video_pairs(spark.createDataFrame(told, "key string, duration double, frames array<string>")), "a", "b")
    assert got == sorted(want) and len(want) > 30
