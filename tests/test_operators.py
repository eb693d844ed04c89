"""Near duplicates, trees, archives, reconciliation, caches, organizing, migration and checks on small cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_inventory import inv
from twinlake.functions import signatures
from twinlake.operators import archives, caches, components, manifests, migrate, organize, reconcile, similarity, trees
from twinlake.operators.copydiff import same_etag


def flip(code, *bits):
    return f"{int(code, 16) ^ sum(1 << b for b in bits):0{len(code)}x}"


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "a int, b int"))))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert rows(components.components(spark.createDataFrame([], "a int, b int"))) == []


@pytest.mark.parametrize("a,b,want", [("00", "01", 1), ("00", "ff", 8), ("0f", "f0", 8), ("", "", None), ("00", "000", None), (None, "00", None)])
def test_hamming(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(similarity.hamming(F.col("a"), F.col("b"))).first()[0] == want


def test_hamming_pairs_are_lossless(spark):
    rng = random.Random(1)
    base = [f"{rng.getrandbits(256):064x}" for _ in range(20)]
    codes = base + [flip(c, *rng.sample(range(256), rng.randrange(1, 12))) for c in base for _ in range(4)]
    df = spark.createDataFrame([(c,) for c in codes + codes[:5] + ["ab", None]], "code string")
    dist = lambda x, y: bin(int(x, 16) ^ int(y, 16)).count("1")
    want = {(x, y, dist(x, y)) for x, y in itertools.combinations(sorted(set(codes)), 2) if dist(x, y) <= 8}
    pairs = similarity.hamming_pairs(df, 8)
    assert {tuple(r) for r in pairs.collect()} == want and want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_audio_pairs_are_lossless(spark):
    rng = random.Random(2)
    prints = []
    for i in range(15):
        words, d = [rng.getrandbits(32) for _ in range(rng.randrange(3, 9))], rng.random() * 9
        prints.append((f"{i:02}", d, words))
        for j in range(5):
            other = [w ^ (1 << rng.randrange(32)) if rng.random() < 0.9 else w ^ 7 for w in words][: rng.randrange(2, len(words) + 1)]
            prints.append((f"{i:02}{j}", d + rng.uniform(-2.5, 2.5), other))
    prints += [("e1", 3.0, []), ("e2", 4.0, []), ("e3", 9.5, [])]

    def like(a, b):
        n = min(len(a[2]), len(b[2]))
        if abs(a[1] - b[1]) > 2 or (n == 0 and (a[2] or b[2])):
            return 0
        return 1.0 if n == 0 else 1 - sum(bin(x ^ y).count("1") for x, y in zip(a[2], b[2])) / (32 * n)

    want = {(a[0], b[0]) for a, b in itertools.combinations(sorted(prints), 2) if like(a, b) >= 0.95 - 1e-9}
    df = spark.createDataFrame([*prints, ("n", None, [1]), ("m", 1.0, None)], "key string, duration double, words array<bigint>")
    assert {(r["a"], r["b"]) for r in similarity.audio_pairs(df).collect()} == want and len(want) > 10
    with pytest.raises(ValueError):
        similarity.audio_pairs(df, 0.9)


def test_video_pairs_are_lossless(spark):
    rng = random.Random(3)
    films = []
    for i in range(8):
        frames, d = [f"{rng.getrandbits(256):064x}" for _ in range(5)], rng.random() * 20
        films.append((f"{i}", d, frames))
        films += [(f"{i}{j}", d + rng.uniform(-6, 6), [flip(f, *rng.sample(range(256), rng.randrange(10, 42))) for f in frames]) for j in range(6)]
    films += [("s", 1.0, films[0][2][:4]), ("x", 1.0, [])]
    dist = lambda x, y: bin(int(x, 16) ^ int(y, 16)).count("1")

    def like(a, b):
        if abs(a[1] - b[1]) > 5 or len(a[2]) != len(b[2]) or not a[2]:
            return 0
        return 1 - sum(map(dist, a[2], b[2])) / len(a[2]) / 256

    want = {(a[0], b[0]) for a, b in itertools.combinations(sorted(films), 2) if like(a, b) >= 0.9 - 1e-9}
    df = spark.createDataFrame(films, "key string, duration double, frames array<string>")
    assert {(r["a"], r["b"]) for r in similarity.video_pairs(df).collect()} == want and len(want) > 10


def test_jaccard_pairs_are_lossless(spark):
    rng = random.Random(4)
    sets = {f"s{i:02}": {f"t{rng.randrange(25)}" for _ in range(rng.randrange(0, 9))} | {"common"} for i in range(60)} | {"empty": set()}
    for t in (0.45, 0.8, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}
        df = spark.createDataFrame([(k, [*v, None, *list(v)[:1]]) for k, v in sets.items()], "id string, items array<string>")
        assert {(r["a"], r["b"]) for r in similarity.jaccard_pairs(df, t).collect()} == want


def test_near_groups(spark):
    members = spark.createDataFrame([("/a", "k1", 10, "h1"), ("/b", "k2", 30, "h2"), ("/c", "k3", 30, "h3"), ("/d", "k4", 5, "same"), ("/e", "k5", 5, "same"), ("/z", "k9", 1, "h")], "path string, key string, size bigint, full_hash string")
    pairs = spark.createDataFrame([("k1", "k2", 3), ("k2", "k3", 7), ("k4", "k5", 1)], "a string, b string, distance int")
    groups, ranked = similarity.near_groups(members, pairs, "distance", "max")
    assert rows(groups) == [("k1", 3, 10, 30, 7, "/c", 40)]
    assert [(r[1], r[2], round(r[3], 4)) for r in rows(ranked)] == [("/a", False, -1.6667), ("/b", False, -1.0), ("/c", True, 0.0)]


def test_chain_of_projects_is_one_group_and_keeps_all_but_one(spark):
    sets = {"A": "abcdef", "B": "cdefgh", "C": "efghij", "D": "ghijkl", "X": "z"}
    files = spark.createDataFrame([(f"/p/{r}", x, x, 100) for r, s in sets.items() for x in s], "root string, rel string, hash string, total_bytes bigint")
    groups = trees.project_groups(files, 0.45)
    assert {r["root"] for r in groups.collect()} == {f"/p/{r}" for r in "ABCD"}
    report = trees.tree_report(files, groups).collect()
    assert len(report) == 1 and report[0]["reclaim_bytes"] == 300 and report[0]["keeper"] == "/p/A" and report[0]["identical_files"] == 0 and report[0]["differing_files"] == 12
    assert trees.shown_differences(files, groups, 5).count() == 5


def test_tree_keepers(spark):
    df = spark.createDataFrame([(1, "/a/old/p", None), (1, "/a/b/c/p", None), (2, "/x/p", 5), (2, "/x/bak/p", 9), (3, "/b/p", None), (3, "/a/p", 7), (4, "/b", 3), (4, "/a", 3)], "component int, root string, git_head bigint")
    got = {(r["component"], r["root"]): (r["is_keeper"], r["score"]) for r in trees.tree_keepers(df).collect()}
    assert got == {(1, "/a/old/p"): (False, -5.0), (1, "/a/b/c/p"): (True, 0.0), (2, "/x/p"): (False, -3.0), (2, "/x/bak/p"): (True, 0.0), (3, "/b/p"): (False, 0.0), (3, "/a/p"): (True, 0.0), (4, "/a"): (True, 0.0), (4, "/b"): (False, 0.0)}


def test_innermost_project_and_cover(spark):
    files = inv(spark, dict(path="/p/go.mod", full_hash="1"), dict(path="/p/in/pom.xml", full_hash="2"), dict(path="/p/in/x/y.c", full_hash="3"), dict(path="/q/z.c", full_hash="3"), dict(path="/p/a.zip::go.mod", is_archive_member=True))
    entries = spark.createDataFrame([("/p", "go.mod"), ("/p", ".git"), ("/p/in", "pom.xml"), ("/q", "a.slnx")], "dir string, name string")
    roots = trees.marked_folders(entries)
    assert rows(roots) == [("/p", ".git"), ("/p/in", "pom.xml")]
    assert rows(trees.project_files(files, roots).select("root", "rel")) == [("/p", "go.mod"), ("/p/in", "pom.xml"), ("/p/in", "x/y.c")]
    members = spark.createDataFrame([("3", "/p/in/x/y.c"), ("3", "/q/z.c"), ("1", "/p/go.mod"), ("1", "/p"), ("4", "/pq/x")], "full_hash string, path string")
    assert rows(trees.uncovered_groups(members, roots)) == [("3", 2, 1), ("4", 1, 0)]


def test_redundant_archives(spark):
    members = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "9"), ("c", "1"), ("d", None), ("d", "1"), (None, "1")], "outer_path string, full_hash string")
    disk = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "full_hash string")
    assert rows(archives.redundant_archives(members, disk)) == [("a", 2), ("c", 1)]
    assert rows(archives.redundant_archives(members, disk, spark.createDataFrame([("c",)], "outer_path string"))) == [("a", 2)]


@pytest.mark.parametrize("seed", range(4))
def test_budget_is_greedy_with_skips(spark, seed):
    rng = random.Random(seed)
    costs = [(f"p{i:03}", rng.choice([None, 0, 1, 5, 20, 60, 300])) for i in range(120)]
    rest, want = 400, {}
    for p, c in costs:
        fits = (c or 0) <= rest
        want[p] = fits
        rest -= (c or 0) if fits else 0
    shuffled = rng.sample(costs, len(costs))
    got = reconcile.within_budget(spark.createDataFrame(shuffled, "p string, c bigint"), ["p"], "c", 400)
    assert {r["p"]: r["taken"] for r in got.collect()} == want
    assert reconcile.within_budget(got.select("p", "c").limit(0), ["p"], "c", 5).count() == 0


def test_reconciliation(spark):
    files = inv(
        spark, dict(path="/a", size=1, full_hash="L"), dict(path="g://a", size=1, source_id="gdrive:v", foreign_hash="md5:X", cloud_file_id="i", etag="e", full_hash="X"), dict(path="g://b", size=1, source_id="gdrive:v", foreign_hash="md5:Y", cloud_file_id="j", etag="e", full_hash="Y"),
        dict(path="g://n", size=1, source_id="gdrive:v", cloud_file_id=None, etag="e", full_hash="N"), dict(path="g://c", size=2, source_id="gdrive:v", foreign_hash="md5:AB", full_hash="m"), dict(path="h://c", size=2, source_id="gdrive:w", foreign_hash="MD5:ab", full_hash="k"),
        dict(path="/only", size=3), dict(path="/only2", size=3),
    )
    cache = spark.createDataFrame([("gdrive:v", "i", "e", "B3"), ("gdrive:v", None, "e", "no")], "source_id string, cloud_file_id string, etag string, blake3 string")
    choices = reconcile.canonical_choice(reconcile.cross_source_buckets(files), cache)
    assert {r["path"]: (r["choice"], r["canonical"]) for r in choices.collect()} == {"/a": ("local", "L"), "g://a": ("cached", "B3"), "g://b": ("fetch", None), "g://n": ("unfetchable", None), "g://c": ("same algorithm", "ab"), "h://c": ("same algorithm", "ab")}
    for budget, status in ((1, "cached"), (0, "budget exceeded")):
        got = {r["path"]: (r["full_hash"], r["status"]) for r in reconcile.reconciled_files(choices, reconcile.fetch_plan(choices, budget)).collect()}
        assert got["g://a"] == (("B3" if budget else "X"), status) and got["g://c"] == ("ab", "same algorithm")


def test_caches(spark):
    schema = "path string, size bigint, mtime double, full_hash string"
    old = spark.createDataFrame([("a", 1, 1.0, "A"), ("b", 1, 1.0, "B"), ("c", 1, 1.0, "C")], schema)
    new = spark.createDataFrame([("a", 1, 1.0 + 1e-7, None), ("b", 2, 1.0, None), ("d", 1, None, "D"), (None, 1, 1.0, "Z")], schema)
    assert {r["path"]: r["full_hash"] for r in caches.upserted(old, new, values=["full_hash"]).collect()} == {"a": "A", "b": None, "c": "C", "d": "D"}
    assert {r["path"]: (r["full_hash"], r["is_hit"]) for r in caches.looked_up(new, old, ["full_hash"]).collect()} == {"a": ("A", True), "b": (None, False), "d": (None, False), None: (None, False)}
    staged = spark.createDataFrame([("s", "p", 1, 1.0), ("s", "p", 2, 2.0), ("t", "p", 3, 1.0)], "scan_id string, path string, size bigint, staged_ts double")
    assert rows(caches.stage_replaced(staged)) == [("s", "p", 2, 2.0), ("t", "p", 3, 1.0)]
    assert rows(caches.unexpired(staged, "staged_ts", 2.5, 1.0).select("size")) == [(2,)]
    assert rows(caches.cache_stats(new, "size", "full_hash")) == [(1, 3, 2), (2, 1, 0)]


def test_name_signals(spark):
    df = spark.createDataFrame([("/x/payslip_2024-03-15.pdf",), ("/x/IMG_0042.JPG",), ("/x/my company.txt",), ("/x/wells-fargo_1999.pdf",), ("/x/12024-03-151",)], "path string")
    got = {r["path"][3:]: r for r in organize.name_signals(df).collect()}
    assert (got["payslip_2024-03-15.pdf"]["fname_date"], got["payslip_2024-03-15.pdf"]["fname_year"], got["payslip_2024-03-15.pdf"]["fname_keywords"]) == ("2024-03-15", 2024, ["payslip"])
    assert got["IMG_0042.JPG"]["fname_seqno"] == 42 and got["my company.txt"]["fname_keywords"] == ["pan"] and got["12024-03-151"]["fname_date"] is None
    assert got["wells-fargo_1999.pdf"]["fname_issuer"] == "Wells Fargo" and got["wells-fargo_1999.pdf"]["fname_year"] == 1999


def test_text_classes(spark):
    df = spark.createDataFrame([(1, "NET PAY and gross pay, pay period"), (2, "nothing"), (3, None), (4, ""), (5, "Salary Offer")], "id int, text string")
    got = {r["id"]: r for r in organize.classified_texts(df, "id", "text").collect()}
    assert got[1]["label"] == "payslip" and abs(got[1]["confidence"] - 8 / 15) < 1e-9 and got[1]["n_hits"] == 3 and got[5]["label"] == "offer_letter"
    assert [got[i]["label"] for i in (2, 3, 4)] == [None] * 3
    tie = organize.classified_texts(df.filter("id = 1"), "id", "text", {"b": {"net pay": 1}, "a": {"net pay": 2}}).first()
    assert tie["label"] == "b"


SIGNAL = dict(mime_top=None, mtime_year=2020, mtime_month=5, fname_year=None, fname_issuer=None, fname_keywords=[], id3_artist=None, id3_albumartist=None, id3_album=None, exif_year=None, exif_month=None, video_year=None, pdf_author=None, pdf_year=None, pdf_class=None, pdf_class_confidence=0.0)
TYPES = "path string, mime_top string, mtime_year int, mtime_month int, fname_year int, fname_issuer string, fname_keywords array<string>, id3_artist string, id3_albumartist string, id3_album string, exif_year int, exif_month int, video_year int, pdf_author string, pdf_year int, pdf_class string, pdf_class_confidence double"


@pytest.mark.parametrize("given,domain,subfolder,confidence", [
    (dict(), "Unsorted", "", 0.0), (dict(id3_artist="A/B", id3_album="C"), "Media", "Music/A B/C", 0.9), (dict(id3_album="C"), "Unsorted", "", 0.36), (dict(mime_top="IMAGE"), "Unsorted", "Photos", 0.7),
    (dict(pdf_class="payslip", pdf_class_confidence=0.9, pdf_year=2019), "HR", "Payslips/2019", 0.81), (dict(pdf_class="payslip", pdf_class_confidence=0.1), "Unsorted", "HR", 0.63), (dict(fname_keywords=["pan"]), "Unsorted", "Personal", 0.7),
    (dict(pdf_class="receipt", pdf_class_confidence=1.0, fname_issuer="amazon"), "Finances", "Receipts/2020/amazon", 0.9),
])
def test_classified(spark, given, domain, subfolder, confidence):
    r = organize.classified(spark.createDataFrame([("/x", *(SIGNAL | given).values())], TYPES)).first()
    assert (r["domain"], r["subfolder"], round(r["confidence"], 6)) == (domain, subfolder, confidence)


def test_merged_signals(spark):
    df = spark.createDataFrame([("p", 1, "a", [], 1.0), ("p", 2, None, ["k"], 0.0), ("p", 3, "c", [], None)], "path string, t int, s string, l array<string>, d double")
    assert rows(organize.merged_signals(df, ["path"], "t", ["s", "l", "d"])) == [("p", "c", ["k"], 1.0)]


def test_folders_and_splits(spark):
    data = [(f"/f/{i}", "Media", "Music/A/B") for i in range(4)] + [("/f/x", "HR", "T")] + [(f"/g/{i}", "Unsorted", "") for i in range(5)] + [("/h/1", "HR", "T"), ("/h/2", "HR", "T")]
    df = spark.createDataFrame(data, "path string, domain string, subfolder string")
    groups = organize.coherent_folders(df)
    assert rows(groups) == [("/f", 5, 4, "Media/Music/A/B", "music_album:f")]
    assert rows(organize.split_groups(df, groups)) == [("music_album:f", "/f", 2)]


@pytest.mark.parametrize("keys", [[], ["u"]])
def test_sessions(spark, keys):
    rng = random.Random(6)
    times = sorted(rng.uniform(0, 400) for _ in range(300)) + [401.0, 411.0, 421.0]
    df = spark.createDataFrame([("u", t) for t in times] + [("u", None)], "u string, t double").repartition(4)
    got = {r["t"]: r["session_no"] for r in organize.sessions(df, "t", 3.0, keys).collect()}
    no, want = 0, {}
    for before, t in zip([times[0], *times], times):
        no += t - before >= 3.0
        want[t] = no
    assert got == want and no > 2
    assert organize.sessions(df.limit(0), "t", 3.0, keys).count() == 0


def test_events_and_names(spark):
    day = 86400.0
    df = spark.createDataFrame([(f"/a{i}", i * 3600.0, "Videos" if i == 0 else "Unsorted") for i in range(30)] + [("/b", 9 * day, "Photos"), ("/c", None, "Photos")], "path string, ts double, domain string")
    assert rows(organize.media_events(df).select("event", "domain", "n_files", "subfolder")) == [("1970-01-01_to_1970-01-02", "Videos", 30, "1970/1970-01-01_to_1970-01-02")]
    files = spark.createDataFrame([("/a/x.txt", "T", day), ("/b/x.txt", "T", day), ("/b/y", "", day)], "path string, folder string, mtime double")
    got = {r["path"]: (r["destination"], r["is_collision"]) for r in organize.final_names(files, "prefix_date").collect()}
    assert got["/a/x.txt"] == ("T/1970-01-02_x.txt", False) and got["/b/x.txt"][1] and got["/b/x.txt"][0].startswith("T/x_") and got["/b/y"][0] == "1970-01-02_y"


def test_migration_plan_order(spark):
    src = inv(
        spark, dict(path="g:a://s", is_shared=True, size=1, source_id="g:a"), dict(path="g:a://x.tmp", source_id="g:a"), dict(path="g:a://small", size=1, source_id="g:a"), dict(path="g:a://max", size=500, source_id="g:a"), dict(path="g:a://big", size=450, source_id="g:a"),
        dict(path="g:a://same", source_id="g:a", foreign_hash="md5:AA"), dict(path="g:a://cross", source_id="g:a", foreign_hash="md5:AA"), dict(path="g:a://nohash", source_id="g:a"),
    )
    dst = inv(spark, dict(path="g:b://same", source_id="g:b", foreign_hash="md5:aa"), dict(path="g:b://cross", source_id="g:b", foreign_hash="sha256:aa"), dict(path="g:b://nohash", source_id="g:b"))
    got = {r["source_path"][6:]: r["action"] for r in migrate.migration_plan(src, dst, 400, exclude=["*.tmp"], min_size=10, max_size=450).collect()}
    assert got == {"s": "defer", "big": "error", "same": "skip", "cross": "copy", "nohash": "copy"}
    assert migrate.file_limit("onedrive:x") == 250 * 1024**3 and migrate.file_limit("local") is None and migrate.file_limit("local", 1) == 1024**3


def test_manifest_states(spark):
    schema = "source_path string, action string, state string, dest_cloud_file_id string, dest_etag string, source_hash string, uploaded_hash_algo string, uploaded_hash string, verified boolean, verified_ts double, cleanup_done boolean, source_cloud_trash_id string, updated_at int"
    m = spark.createDataFrame([
        ("a", "copy", "done", "i", '"e"', "md5:1", "md5", "1", True, 1.0, True, None, 2), ("a", "copy", "pending", None, None, "md5:1", None, None, False, None, False, None, 1), ("b", "copy", "done", "j", "e", "md5:1", "md5", "2", True, None, False, None, 1),
        ("c", "copy", "done", "gone", "e", None, None, None, False, 1.0, True, "t", 1), ("d", "copy", "error", "k", "e", None, None, None, False, None, False, None, 1), ("e", "copy", "done", "k", "other", None, None, None, None, 1.0, False, None, 1),
    ], schema)
    dest = spark.createDataFrame([("i", 'W/"e"'), ("j", "e"), ("k", "e"), (None, "e")], "cloud_file_id string, etag string")
    held = m.filter("NOT (source_path = 'a' AND state = 'pending')")
    assert {r["source_path"]: r["status"] for r in migrate.verified(held, dest, same_etag).collect()} == {"a": "verified", "b": "mismatch", "c": "missing", "e": "drifted"}
    assert rows(migrate.cleanup_refusals(held)) == [("b", "no time of verification"), ("c", "not verified"), ("e", "not verified")]
    assert {r["source_path"]: r["state_after"] for r in migrate.undo_plan(held).collect()} == {"a": "done", "b": "pending", "c": "pending", "e": "pending"}
    plan = spark.createDataFrame([("a", "copy"), ("d", "copy"), ("n", "defer"), ("a", "copy")], "source_path string, action string")
    assert {r["source_path"]: (r["state"], r["is_resumed"], r["verified"]) for r in migrate.resumed(plan, m).collect()} == {"a": ("skipped", True, True), "d": ("pending", False, False), "n": ("skipped", False, False)}


def test_checks_around_moves(spark):
    plan = inv(spark, dict(path="/Users/me/a"), dict(path="/Users/me/b", size=7), dict(path="/Users/me/c", mtime=1.0005), dict(path="/Users/me/d"), dict(path="/etc/e"), dict(path="g://f", source_id="gdrive:v", cloud_file_id="x" * 20, etag="1"), dict(path="g://g", source_id="gdrive:v", cloud_file_id="../x", etag="1"), dict(path="/Users/me/h", mtime=2.0))
    now = inv(spark, dict(path="/Users/me/a"), dict(path="/Users/me/b"), dict(path="/Users/me/c"), dict(path="/etc/e"), dict(path="g://f", etag='"2"'), dict(path="g://g", etag="1"), dict(path="/Users/me/h"))
    got = {r["path"]: r["refusal"] for r in manifests.apply_plan(plan, now, ["gdrive:v"], ["/Users/me", "/etc"]).collect()}
    assert got == {"/Users/me/a": None, "/Users/me/b": "changed: size", "/Users/me/c": None, "/Users/me/d": "changed: missing", "/etc/e": "excluded place", "g://f": "changed: etag", "g://g": "odd id", "/Users/me/h": "changed: time"}
    d = spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), (None,), (".git/x",), ("a..b",)], "d string")
    assert [r[0] for r in d.select(manifests.destination_reject(F.col("d"))).collect()] == [None, "absolute", "leaves its root", "empty", "excluded place", None]


def test_trash(spark):
    moved = spark.createDataFrame([("/a/x.txt", 1, "h"), ("/a/y.txt", 1, "h"), ("/a/z.txt", 1, "h"), ("/a/w 2.txt", 1, "h")], "path string, size bigint, full_hash string")
    trash = spark.createDataFrame([("/T/x 3.txt", 1, "h"), ("/T/y.txt", 1, "h"), ("/T/y 2.txt", 1, "h"), ("/T/z.txt", 2, "h"), ("/T/w 2.txt", 1, "h")], "trash_path string, size bigint, full_hash string")
    got = {r["path"]: (r["verdict"], r["trash_path"]) for r in manifests.trash_candidates(moved, trash).collect()}
    assert got == {"/a/x.txt": ("found", "/T/x 3.txt"), "/a/y.txt": ("ambiguous", None), "/a/z.txt": ("missing", None), "/a/w 2.txt": ("found", "/T/w 2.txt")}
    now = spark.createDataFrame([("/a/x.txt",)], "path string")
    assert dict(rows(manifests.undo_plan(moved, trash, now))) == {"/a/x.txt": "refuse: place taken", "/a/y.txt": "refuse: ambiguous", "/a/z.txt": "refuse: missing", "/a/w 2.txt": "restore"}


def test_signatures(spark):
    rng = np.random.default_rng(1)
    grid = rng.random(4096)
    blurred = grid + rng.normal(0, 1e-6, 4096)
    df = spark.createDataFrame([(grid.tolist(),), (blurred.tolist(),), ([1.0],), (None,)], "p array<double>")
    got = [r[0] for r in df.select(signatures.picture_hash(F.col("p"))).collect()]
    assert len(got[0]) == 64 and bin(int(got[0], 16)).count("1") == 128 and bin(int(got[0], 16) ^ int(got[1], 16)).count("1") <= 8 and got[2:] == [None, None]
    texts = spark.createDataFrame([("12.500:AQAAAAIAAAA=",), ("3:!",), ("x:AQAAAA==",), ("",), (None,), ("4:",)], "t string")
    assert [(r[0]["duration"], r[0]["words"]) for r in texts.select(signatures.sound_print(F.col("t"))).collect()] == [(12.5, [1, 2]), (3.0, None), (None, [1]), (None, None), (None, None), (4.0, None)]
    films = spark.createDataFrame([("9.5:ab,,cd",), ("9:",), ("zz",)], "t string")
    assert [(r[0]["duration"], r[0]["frames"]) for r in films.select(signatures.film_signature(F.col("t"))).collect()] == [(9.5, ["ab", "cd"]), (9.0, None), (None, None)]


def test_budget_that_takes_too_many_rounds_is_an_error(spark):
    costs = spark.createDataFrame([("a", 9), ("b", 1), ("c", 9), ("d", 1)], "p string, c bigint")
    assert rows(reconcile.within_budget(costs, ["p"], "c", 2, 3), "p", "taken") == [("a", False), ("b", True), ("c", False), ("d", True)]
    with pytest.raises(RuntimeError):
        reconcile.within_budget(costs, ["p"], "c", 10, 1)


def test_summed_tests_of_a_rule(spark):
    rules = (("s", "Work", "{year}", 1, (("sum", (("word", ("cv",), 0.6), ("mime", "text", 0.7)), 1.0),)), ("o", "HR", "x", 0, (("word", ("bill",), 0.8),)))
    data = [("/a", ["CV"], "text"), ("/b", ["cv"], None), ("/c", ["bill"], "text"), ("/d", None, None)]
    fields = {c: "string" for c in ("id3_artist", "id3_albumartist", "id3_album", "fname_issuer", "pdf_author", "pdf_class")} | {c: "int" for c in ("fname_year", "pdf_year", "exif_year", "video_year", "mtime_year", "mtime_month", "exif_month")} | {"pdf_class_confidence": "double", "exif_ts_epoch": "double", "video_ts_epoch": "double"}
    df = spark.createDataFrame(data, "path string, fname_keywords array<string>, mime_top string").withColumns({c: F.lit(None).cast(t) for c, t in fields.items()})
    got = {r["path"]: (r["domain"], round(r["confidence"], 6)) for r in organize.classified(df, rules).collect()}
    assert got["/a"] == ("Work", 1.0) and got["/c"] == ("HR", 0.8) and got["/b"][1] == 0.6 and got["/d"][1] == 0.0
