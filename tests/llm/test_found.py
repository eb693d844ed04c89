"""Consolidation, names, survivors and similar sets against plain Python."""

import itertools
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from twinlake.llm import names as N
from twinlake.llm.groups import connected_groups, consolidated
from twinlake.llm.setjoin import cells_of, similar_projects, similar_sets
from twinlake.llm.survivors import best_members


def _components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_connected_groups(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 380)] + [(7, 7)]
    edges += edges[:10]
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "a int, b int")
    assert dict(rows(connected_groups(df))) == _components(edges)


def test_consolidated(spark):
    data = [(1, "b", "x"), (1, "c", "x"), (2, "c", "x"), (2, "a", "x"), (3, "z", "x"), (3, None, "x"), (4, None, "x"), (4, "y", "x"), (None, "w", "x"), (None, "v", "x"), (1, "b", "x"), (5, "", "x"), (5, "é", "x")]
    df = spark.createDataFrame(data, "group_id bigint, path string, node string")
    assert dict(rows(consolidated(df))) == {"a": "a", "b": "a", "c": "a", "z": "z", "y": "y", "w": "w", "v": "v", "": "", "é": ""}
    assert rows(consolidated(df.limit(0))) == []


def test_best_members(spark):
    nan = float("nan")
    data = [
        (1, "a", 1.0, 0, 0, 1), (1, "b", 5.0, 0, 0, 1), (1, "b", None, None, None, 2), (1, "b", nan, None, None, 3), (1, "c", 9.0, 1, 1, 1), (2, "a", 1.0, 0, 0, 1), (2, "b", 1.0, 1, 0, 1), (3, "b", 1.0, 0, 0, 1), (3, "a", 1.0, None, 0, 1),
        (4, "only", 9.0, 1, 0, 1), (4, None, 9.0, 1, 0, 1), (5, "a", None, 1, 0, 1), (5, "b", 2.0, 1, None, 1), (None, "a", 2.0, 1, 0, 1), (None, "b", 2.0, 1, 0, 1), (6, "a", 3.0, 0, 0, None), (6, "a", 1.0, 0, 0, 1), (6, "b", 2.0, 0, 0, 1),
    ]
    df = spark.createDataFrame(data, "group_id bigint, path string, score double, is_proposed_keeper int, is_informational int, scored_at bigint")
    assert rows(best_members(df)) == [(1, "b"), (2, "b"), (3, "a"), (6, "b")]
    assert rows(best_members(df.limit(0))) == []


def _jaccard(sets, t):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("seed,threshold", [(1, 0.6), (2, 0.6), (3, 0.8), (4, 0.45)])
def test_similar_sets_against_all_pairs(spark, seed, threshold):
    rng = random.Random(seed)
    common, sets = [f"c{i}" for i in range(6)], {}
    for i in range(60):
        base = {f"t{rng.randrange(400)}" for _ in range(rng.randrange(1, 12))} | {c for c in common if rng.random() < 0.5}
        for j in range(rng.randrange(1, 4)):
            s = {x for x in base if rng.random() < 0.9} | ({f"n{i}{j}"} if rng.random() < 0.4 else set())
            if s and s not in sets.values():
                sets[f"s{i:03}_{j}"] = s
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, items array<string>")
    got = {(r["a"], r["b"]): r["similarity"] for r in similar_sets(df, threshold).collect()}
    assert set(got) == _jaccard(sets, threshold)
    assert all(abs(v - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 1e-9 for (a, b), v in got.items())


def test_cells_hold_near_sets_and_every_set_once(spark):
    rng = random.Random(9)
    sets = {}
    for c in range(12):
        base = [f"c{c}_{i}" for i in range(30)] + ["everywhere"]
        for j in range(8):
            sets[f"{c:02}_{j}"] = sorted(x for x in base if rng.random() < 0.9)
    sets |= {"lone": ["x1", "x2"], "other": ["x3", "everywhere"]}
    cells = cells_of(spark.createDataFrame(list(sets.items()), "id string, items array<string>"), 0.6).collect()
    assert sum(r["hosts"] for r in cells) == len(sets) - 1 and max(r["radius"] for r in cells) <= 0.4 + 1e-9
    assert len(cells) <= 40 and sum(r["hosts"] > 1 for r in cells) >= 12
    with pytest.raises(ValueError):
        similar_sets(spark.createDataFrame([], "id string, items array<string>"), 0.3)


def test_similar_projects(spark):
    data = [
        ("a", {"x": "AA", "y": "bb", "z": None}, 1, "id"), ("b", {"q": "aa", "r": "BB", "s": "bb"}, 1, "id"), ("c", {"q": "aa", "r": "cc", "s": "bb"}, 1, "id"), ("d", {}, 1, "id"), ("e", {}, 1, "id"), ("f", {"x": None}, 1, "id"), ("g", None, 1, "id"),
        ("h", {"q": "zz"}, 2, "id"), ("h", {"q": "aa", "r": "bb"}, 1, "id"), ("h", {"q": "zz"}, 2, "id"), (None, {"q": "aa", "r": "bb"}, 1, "id"),
    ]
    df = spark.createDataFrame(data, "root string, file_hashes map<string,string>, scanned_at bigint, id string")
    assert rows(similar_projects(df)) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert rows(similar_projects(df, 0.9)) == [("a", "b")]
    assert rows(similar_projects(df.limit(0))) == []


ALIKE = [
    ("Margaret Stone", "Stone, M."), ("Margaret Stone", "M.B. Stone"), ("Margaret Stone", 'Margaret "Peggy" Stone'), ("Margaret Stone", "stone, peggy"), ("Hélène Marchand", "HÃ©lÃ¨ne Marchand"), ("Hélène Marchand", "MARCHAND, HELENE"), ("Oskar Tischner", "Oskar Tishcner"),
    ("Oslo Chamber Orchestra", "Oslo C.O."), ("Oslo Chamber Orchestra", "Ch. Orch. of Oslo"), ("Oslo Chamber Orchestra", "Chamber Orchestra, Oslo"), ("Riga String Quartet", "Riga SQ"), ("Riga String Quartet", "RIGA String\xa0Qt."), ("Malmö Jazz Trio", "Malmo Jazz 3"),
    ("The Midnight Harvest", "Midnight_Harvest, The"), ("The Midnight Harvest", "the Midnight Harvest (band)"), ("Bernstein & the Foxes", "Foxes, Bernstein and The"),
]
UNLIKE = [("Margaret Stone", "Margaret Sharp"), ("Margaret Stone", "Robert Stone"), ("Margaret Stone", "R. Stone"), ("Oslo Chamber Orchestra", "Oslo Symphony Orchestra"), ("Oslo Jazz Trio", "Riga Jazz Trio"), ("M. Stone", "W.M. Stone"), ("Stone", "Margaret Stone")]
ALBUMS = [("The Harvest Sessions", "Harvest Sess."), ("Harvest, Vol. 2", "Harvest (II)"), ("Harvest, Vol. 2", "Vol. 2: Harvest"), ("Harvest, Vol. 2", "Harvest Volume Two"), ("Harvest Original Soundtrack", "Harvest (O.S.T.)"), ("Harvest: The Quiet Years", "harvest the quiet yrs"), ("Songs from Harvest", "Songs frm Harvest")]
APART = [("Harvest, Vol. 2", "Harvest, Vol. 1"), ("Harvest Sessions", "Harvest Original Soundtrack"), ("Love & Harvest", "Songs from Harvest")]


@pytest.mark.parametrize("kind,a,b,want", [("artist", *p, True) for p in ALIKE] + [("artist", *p, False) for p in UNLIKE] + [("album", *p, True) for p in ALBUMS] + [("album", *p, False) for p in APART])
def test_alignment(kind, a, b, want):
    x, y = N.tokens(a, kind), N.tokens(b, kind)
    found = sorted(x) == sorted(y) or N.align(y, x, kind == "artist") is not None or N.align(x, y, kind == "artist") is not None
    assert found is want


@pytest.mark.parametrize("name", ["", "V.A.", "Various Artists", "-", "unknown", "<Unknown Artist>", "A Stone feat. B Sharp", "A Stone vs. B Sharp", "A Stone with B Sharp", "A Stone / B Sharp"])
def test_nobody_and_credits(name):
    assert N.tokens(name, "artist") is None


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", min_size=1, max_size=7), st.text("abcd", min_size=1, max_size=7))
def test_one_edit(a, b):
    edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abcd"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abcd"}
    edits |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    assert N.one_edit(a, b) is (b in edits and a != b)
    near = {x: i for i, x in enumerate([a])}
    for depth in (1, 2):
        for x in list(near):
            for y in [x[:i] + x[i + 1 :] for i in range(len(x))] + [x[:i] + c + x[i:] for i in range(len(x) + 1) for c in "abcd"] + [x[:i] + c + x[i + 1 :] for i in range(len(x)) for c in "abcd"]:
                near.setdefault(y, depth)
    assert N.two_edits(a, b) is (b in near)


def test_index_finds_all_near_tokens(spark):
    """Tokens with up to two edits of all kinds, against all pairs."""
    rng = random.Random(3)
    tokens = set()
    for n in [3, 4, 5, 6, 9, 11, 12, 14] * 4:
        t = "".join(rng.choice("abcdefgh") for _ in range(n))
        tokens.add(t)
        for _ in range(4):
            u = list(t)
            for _ in range(rng.randrange(1, 3)):
                i = rng.randrange(len(u))
                how = rng.randrange(4)
                u[i : i + 1] = [[], [rng.choice("abcdefgh")], [u[i], rng.choice("abcdefgh")], [u[i]]][how]
                if how == 3 and i + 1 < len(u):
                    u[i], u[i + 1] = u[i + 1], u[i]
            tokens.add("".join(u))
    tokens = sorted(t for t in tokens if t)
    df = spark.createDataFrame([("artist", t, 1) for t in tokens] + [("album", tokens[0] + "x", 1), ("artist", "#12345", 1), ("artist", "#12346", 1)], "kind string, t string, names int")
    got = {tuple(sorted((r["rare"], r["often"]))) for r in N._near_tokens(df).collect()}
    want = {(x, y) for x, y in itertools.combinations(tokens, 2) if N.token_cost(x, y, False) in (N.TYPO, N.TWO_TYPOS)}
    assert got == want and any(min(map(len, p)) >= 10 and not N.one_edit(*p) for p in want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_candidates_against_all_pairs_of_names(spark):
    """Recall of the candidate search over all names of the small table; what it misses must not part an entity."""
    table = spark.read.parquet("/root/testdata/sf0.01/signal_sets.parquet")
    names = {("artist", r[i]) for r in table.select("id3_artist", "id3_albumartist").collect() for i in (0, 1)} | {("album", r[0]) for r in table.select("id3_album").collect()}
    classes = sorted({(k, tuple(sorted(t))) for k, n in names if n is not None and (t := N.tokens(n, k))})
    df = spark.createDataFrame([(i.to_bytes(4, "big"), k, list(t)) for i, (k, t) in enumerate(classes)], "id binary, kind string, tokens array<string>")
    got = {tuple(sorted((int.from_bytes(r["id"], "big"), int.from_bytes(r["oid"], "big")))) for r in N.aligned_pairs(df).select("id", "oid").collect()}
    want = {(i, j) for (i, (k, a)), (j, (m, b)) in itertools.combinations(enumerate(classes), 2) if k == m and (N.align(list(a), list(b), k == "artist") or N.align(list(b), list(a), k == "artist"))}
    assert got <= want and len(got) >= 0.95 * len(want)
    whole, found = _components(want), _components(got)
    assert sum(found.get(i, i) != c for i, c in whole.items()) <= 0.02 * len(whole)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.lists(st.integers(0, 9), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_assignment_is_optimal(cost):
    n = len(cost)
    total, to = N.assign(cost)
    assert sorted(to) == list(range(n)) and total == min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_same_names(spark):
    people = ["Margaret Stone", "Stone, M.", "M.B. Stone", "Peggy Stone", "Margaret Stome", "Robert Stone", "J. Marsh", "Julia Marsh", "James Marsh", "Various Artists", "A Stone feat. Margaret Stone", None, "", "word " * 3000, "Margaret Stone"]
    df = spark.createDataFrame([("artist", n, 1) for n in people] + [("album", "Stone, M.", 1), (None, "x", 1)], "kind string, name string, id int")
    got = {(r["a"], r["b"]) for r in N.same_names(df).collect()}
    one = ["Margaret Stome", "Margaret Stone", "M.B. Stone", "Peggy Stone", "Stone, M."]
    assert got == {tuple(sorted(p)) for p in itertools.combinations(one, 2)}
    assert rows(N.same_names(df.limit(0))) == []


def test_same_names_of_short_words(spark):
    want = [("Ray Fox", "R. Fox"), ("Kim Lee", "K. Lee"), ("Z.Z. Top", "ZZ Top"), ("Quen", "Queen"), ("Raymond Nye", "Ray Nye")]
    df = spark.createDataFrame([("artist", n) for p in want for n in p] + [("artist", "Tom Box")], "kind string, name string")
    assert {(r["a"], r["b"]) for r in N.same_names(df).collect()} == {tuple(sorted(p)) for p in want}
