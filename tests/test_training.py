"""Snapshot changes, copy differences and heavy keys against plain Python, with the awkward cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from twinlake.operators.copydiff import _matrix, copy_differences, same_etag
from twinlake.operators.heavykeys import numbered_chunks, per_key, running_offsets
from twinlake.operators.snapshots import snapshot_changes
from twinlake.operators.versions import latest

FILES = "snapshot_id int, path string, source_id string, size bigint, mtime double, delivered_at timestamp_ntz, k string, h string"


def files(spark, data):
    return spark.createDataFrame(data, FILES.replace("timestamp_ntz", "bigint"))


def test_snapshot_changes(spark):
    data = [
        (1, "a", "l", 1, 1.0, 1, "x", "x"), (1, "b", "l", 1, 1.0, 1, None, None), (1, "c", "l", 1, 1.0, 1, "", ""), (1, "n", "l", None, None, 1, None, None), (1, "far", "g", 1, 1.0, 1, None, None),
        (2, "a", "l", 1, 1.0004, 1, None, None), (2, "b", "l", 9, 1.0, 1, None, None), (2, "b", "l", 1, 1.01, 2, None, None), (2, "d", "l", 1, 1.0, 1, None, None), (2, "d", "l", 1, 1.0, 1, None, None), (2, "n", "l", 1, None, 1, None, None),
        (3, "a", "l", 1, 1.0004, 1, None, None), (3, "b", "l", 1, 1.01, 1, None, None), (3, "d", "l", 1, 1.0, 1, None, None), (3, "n", "l", 1, float("nan"), 1, None, None), (3, "far", "g", 2, 1.0, 1, None, None), (3, None, "g", 2, 1.0, 1, None, None), (None, "z", "g", 2, 1.0, 1, None, None),
    ]
    got = rows(snapshot_changes(files(spark, data)), "snapshot_id", "path", "change")
    assert got == sorted([(2, "b", "changed"), (2, "c", "removed"), (2, "d", "added"), (2, "n", "changed"), (3, "n", "changed"), (3, "far", "changed")], key=repr)
    assert rows(snapshot_changes(files(spark, []))) == []


def test_snapshot_changes_moves_rows_once(spark):
    plan = snapshot_changes(files(spark, [(1, "a", "l", 1, 1.0, 1, None, None)] * 3))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_latest_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, None), ("a", 5, 3), (None, 1, 7), (None, 1, 7)], "k string, t int, v int")
    assert rows(latest(df, ["k"], "t", ["v"])) == sorted([("a", 3), (None, 7)], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_copy_differences_against_dicts(spark, seed):
    rng = random.Random(seed)
    a = {f"k{i}": (rng.choice(["x", "y", None]), rng.choice([1, 2, None])) for i in range(300)}
    b = {k: (v if rng.random() < 0.9 else (rng.choice(["x", "y", None]), v[1])) for k, v in a.items() if rng.random() < 0.95} | {"new": ("q", 1)}
    left = spark.createDataFrame([(k, *v, k) for k, v in a.items()] * 2 + [(None, "x", 1, "z")], "id string, f string, g int, lk string")
    right = spark.createDataFrame([(k, *v, k) for k, v in b.items()], "id string, f string, g int, mask string")
    want = [(k, "*", "missing_right") for k in a.keys() - b.keys()] + [(k, "*", "missing_left") for k in b.keys() - a.keys()]
    want += [(k, n, "differs") for k in a.keys() & b.keys() for n, x, y in zip("fg", a[k], b[k]) if x != y]
    for buckets in (1, 7, 1 << 16):
        assert rows(copy_differences(left, right, "id", ["f", "g"], buckets)) == sorted(want, key=repr)
    assert rows(copy_differences(left, left, "id", ["f", "g"])) == []
    assert len(rows(copy_differences(left.limit(0), right, "id", ["f", "g"]))) == len(b)


def test_matrix_tells_swapped_values_and_nulls(spark):
    one = spark.createDataFrame([("a", "x", None), ("b", "y", "z")], "k string, f0 string, f1 string")
    two = spark.createDataFrame([("a", "y", None), ("b", "x", "z")], "k string, f0 string, f1 string")
    x, y = _matrix(one, ["f0", "f1"], 1, "l").first(), _matrix(two, ["f0", "f1"], 1, "l").first()
    assert x["l0"] == y["l0"] and x["l1"] != y["l1"] and x["l2"] == y["l2"]


def test_same_etag(spark):
    df = spark.createDataFrame([('W/"a"',), ('"a"',), ("a",), (None,)], "e string")
    assert [r[0] for r in df.select(same_etag(F.col("e"))).collect()] == ["a", "a", "a", None]


def test_numbers_are_gapless_per_key_with_a_hot_key(spark):
    data = [("hot" if i % 3 else f"k{i % 7}", i) for i in range(2000)] + [(None, i) for i in range(50)]
    df = spark.createDataFrame(data, "k string, i int").repartition(5, "i")
    got = numbered_chunks(df, ["k"], 100).collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append(r["row_no"])
        assert r["chunk_no"] == r["row_no"] // 100
    assert len(got) == len(data) and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_running_sums_follow_the_order(spark):
    df = spark.createDataFrame([(i % 2, i, i) for i in range(100)], "k int, i int, w int").repartition(3, "i")
    got = running_offsets(df, ["k"], F.col("w"), [F.col("i")], "s").orderBy("s", "i").collect()
    for k in (0, 1):
        total = 0
        for r in [r for r in got if r["k"] == k]:
            assert r["s"] == total
            total += r["w"]


@pytest.mark.parametrize("chunk", [1, 3, 1 << 18])
def test_per_key_states_don_t_depend_on_chunks(spark, chunk):
    data = [("a" if i % 4 else "b", (i * 7919) % 101, f"p{i}") for i in range(200)] + [("one", None, "p")]
    df = spark.createDataFrame(data, "k string, t int, p string").repartition(4, "p")
    got = per_key(df, ["k"], {"m": F.min(F.struct("t", "p")), "n": F.count("*")}, {"m": F.min("m"), "n": F.sum("n")}, chunk)
    want = {k: min((t if t is not None else -1, p) for x, t, p in data if x == k) for k in {d[0] for d in data}}
    assert {r["k"]: ((r["m"]["t"] if r["m"]["t"] is not None else -1), r["m"]["p"]) for r in got.collect()} == want
    assert {r["k"]: r["n"] for r in got.collect()} == {"a": 150, "b": 50, "one": 1}
    assert per_key(df.limit(0).repartition(2, "p"), ["k"], {"n": F.count("*")}, {"n": F.sum("n")}).count() == 0


def _copies_by_hand(folder):
    """Problem 5 in plain Python, from its statement."""
    import pyarrow.parquet as pq

    read = lambda name: pq.read_table(f"{folder}/{name}.parquet").to_pylist()
    tag = lambda e: None if e is None else e.replace("W/", "").replace('"', "")
    low = lambda h: None if h is None else h.lower()
    fields = ["source_file_id", "source_etag", "source_size", "source_hash", "source_mime", "dest_expected_path", "action"]
    shape = lambda r: {f: tag(r[f]) if f == "source_etag" else low(r[f]) if f == "source_hash" else r[f] for f in fields}
    found = set()

    def compare(pair, left, right):
        for k in left.keys() | right.keys():
            if k not in left:
                found.add((pair, k, "*", "missing_left"))
            elif k not in right:
                found.add((pair, k, "*", "missing_right"))
            else:
                found.update((pair, k, f, "differs") for f in left[k] if left[k][f] != right[k][f])

    newest = {}
    for r in read("migration_manifest"):
        if r["source_path"] is not None and (r["source_path"] not in newest or r["updated_at"] > newest[r["source_path"]]["updated_at"]):
            newest[r["source_path"]] = r
    compare("plan_manifest", {r["source_path"]: shape(r) for r in read("migration_entries") if r["source_path"] is not None}, {k: shape(r) for k, r in newest.items()})
    held = {}
    for r in read("files"):
        if r["snapshot_id"] == 4 and (r["path"] not in held or r["delivered_at"] > held[r["path"]]["delivered_at"]):
            held[r["path"]] = r
    there = {r["cloud_file_id"]: {"dest_etag": tag(r["etag"])} for r in held.values() if r["source_id"] == "gdrive:vault" and r["cloud_file_id"] is not None}
    compare("manifest_dest", {r["dest_cloud_file_id"]: {"dest_etag": tag(r["dest_etag"])} for r in newest.values() if r["state"] == "done" and r["dest_cloud_file_id"] is not None}, there)
    copies = {}, {}
    for r in read("tree_diff_entries"):
        for side, h in zip(copies, r["hashes_per_member"] or []):
            if h is not None and r["tree_group_id"] is not None and r["relative_path"] is not None:
                side[f"{r['tree_group_id']}:{r['relative_path']}"] = {"hashes_per_member": low(h)}
    compare("tree", *copies)
    return sorted(found)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_copies_by_hand(spark):
    from twinlake.plans.training import p5_found

    want = _copies_by_hand("/root/testdata/sf0.01")
    assert rows(p5_found(spark, "/root/testdata/sf0.01"), "copy_pair", "row_key", "field_name", "difference") == want
    assert {w[0] for w in want if w[3] == "missing_left"} == {"plan_manifest", "manifest_dest", "tree"}


def test_many_unequal_buckets_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("twinlake.operators.copydiff.broadcast_if_small", lambda df: df)
    left, right = spark.range(5000).selectExpr("id", "id % 7 AS v"), spark.range(100, 5100).selectExpr("id", "id % 3 AS v")
    got = copy_differences(left, right, "id", ["v"]).groupBy("difference").count()
    assert dict(rows(got)) == {"missing_left": 100, "missing_right": 100, "differs": sum(i % 7 != i % 3 for i in range(100, 5000))}


def test_cut_frames_can_be_deleted(spark):
    from twinlake.session import cut, drop_cut

    df = cut(spark.range(10).withColumn("x", F.col("id") * 2))
    folder = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(folder) and df.count() == 10
    drop_cut(df.filter("x > 3"))
    assert os.path.isdir(folder)
    drop_cut(df)
    drop_cut(df)
    assert not os.path.exists(folder)
