"""Packing, mixing and subjects: round trips, bounds and held-out accuracy."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from twinlake.llm import subjects as S
from twinlake.llm.mixing import blocks_of, mixture, mixture_held, permuted
from twinlake.llm.packing import packed, packing_held, plan
from twinlake.llm.tokens import _encoding, sized_documents, vocabulary_path


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_piece_once(histogram):
    segments, windows = plan(histogram, 64, 3)
    ranks = defaultdict(list)
    filled = Counter()
    for s in segments:
        ranks[s.length] += range(s.first, s.end)
        assert s.end - s.first == s.copies * len(s.offsets)
        for w in range(s.window, s.window + s.copies):
            filled[s.tier, w] += s.length * len(s.offsets)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    assert all(filled[t, w] <= 64 >> t for t, w in filled) and len(filled) == sum(windows)


@pytest.mark.parametrize("capacity", [64, 256])
def test_packing_round_trip(spark, capacity):
    rng = random.Random(5)
    sizes = {i: (7 if i % 3 else rng.randrange(0, 3 * capacity)) for i in range(900)}
    df = spark.createDataFrame([(i, n, i) for i, n in sizes.items()] + [(None, 5, 1), (1000, None, 1)], "doc_id bigint, n_tokens int, tier int").repartition(3)
    got = packed(df, capacity, 3, 8).collect()
    by, full, used = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        by[r["doc_id"]].append((r["piece_no"], r["piece_start"], r["piece_tokens"]))
        if r["piece_tokens"]:
            places = set(range(r["container_start"], r["container_start"] + r["piece_tokens"]))
            assert max(places) < capacity and not places & used[r["container_id"]]
            used[r["container_id"]] |= places
            full[r["container_id"]] += r["piece_tokens"]
        else:
            assert r["container_id"] is None
    for i, n in sizes.items():
        pieces = sorted(by[i])
        assert sum(p[2] for p in pieces) == n and [p[1] for p in pieces] == [capacity * k for k in range(len(pieces))]
        assert len(pieces) == max(1, -(-n // capacity))
    assert sorted(full) == list(range(len(full)))
    assert sum(full.values()) > 0.97 * capacity * len(full)
    steps = Counter(r["step_group"] for r in got if r["container_id"] is not None)
    assert len(steps) == -(-len(full) // 8)
    assert rows(packed(df.limit(0), capacity, 3)) == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 1000])
def test_permutation(n):
    for key in (1, 99):
        assert sorted(permuted(np.arange(n), n, key)) == list(range(n))
    assert n < 10 or list(permuted(np.arange(n), n, 1)) != list(permuted(np.arange(n), n, 2))


def test_blocks_hold_each_token_once(spark):
    rng = random.Random(2)
    docs = [("a" if i % 3 else "b", i, rng.randrange(1, 50)) for i in range(300)]
    got = blocks_of(spark.createDataFrame(docs, "source string, doc_id bigint, n_tokens bigint").repartition(3, "doc_id"), 16).collect()
    size, parts = Counter(), defaultdict(list)
    for r in got:
        size[r["source"], r["block_no"]] += r["n_tokens"]
        parts[r["doc_id"]].append((r["doc_start"], r["n_tokens"]))
    for s in "ab":
        total = sum(n for x, _, n in docs if x == s)
        assert [size[s, i] for i in range(-(-total // 16))] == [16] * (total // 16) + ([total % 16] if total % 16 else [])
    for _, d, n in docs:
        at = 0
        for start, m in sorted(parts[d]):
            assert start == at
            at += m
        assert at == n


def test_mixture_shares_and_repeats(spark):
    rng = random.Random(3)
    docs = [(rng.choice("aaaaab"), i, rng.randrange(1, 60)) for i in range(3000)] + [("c", 9000 + i, 20) for i in range(10)] + [(None, 1, 5), ("zzz", 2, 5), ("a", None, 5), ("a", 77777, 0)]
    df = spark.createDataFrame(docs, "source string, doc_id bigint, n_tokens bigint").repartition(3)
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    selection, shares = mixture(df, goal, block_tokens=32, shard_slots=64)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["a"]["share_of_plan"] - 0.5) < 0.02 and abs(got["b"]["share_of_plan"] - 0.3) < 0.02
    assert got["none"]["tokens_selected"] == 0 and got["c"]["tokens_selected"] == 2 * 200 and got["c"]["repeats_used"] == 2
    assert abs(sum(r["share_reached"] for r in got.values()) - 1) < 1e-9
    uses = Counter()
    for r in selection.collect():
        for t in range(r["doc_start"], r["doc_start"] + r["n_tokens"]):
            uses[r["source"], r["doc_id"], t] += 1
    assert max(n for (s, *_), n in uses.items() if s == "a") == 1 and max(n for (s, *_), n in uses.items() if s == "b") <= 3 and {s for s, *_ in uses} == {"a", "b", "c"}
    slots = Counter(selection.select("shard_id", "slot_no").distinct().groupBy("shard_id").count().rdd.map(tuple).collect())
    assert max(n for (_, n) in slots) <= 64
    again, _ = mixture(df.repartition(5), goal, block_tokens=32, shard_slots=64)
    assert rows(again.groupBy("source").agg(F.sum("n_tokens"))) == rows(selection.groupBy("source").agg(F.sum("n_tokens")))
    empty, none = mixture(df.limit(0), goal)
    assert empty.count() == 0 and [r["tokens_selected"] for r in none.collect()] == [0] * 4


def test_broken_packings_and_mixtures_are_told(spark):
    schema = "doc_id bigint, piece_no int, piece_start bigint, piece_tokens int, container_id bigint, container_start int"
    places = spark.createDataFrame([(1, 0, 0, 4, 0, 0), (1, 1, 8, 2, 1, 0), (2, 0, 0, 6, 1, 1), (3, 0, 0, 3, 2, 6), (4, 0, 0, 2, 3, 0), (4, 1, 8, 2, 3, 2), (5, 0, 0, 0, None, None)], schema)
    docs = spark.createDataFrame([(1, 6), (2, 6), (3, 3), (4, 4), (5, 0), (6, 1)], "doc_id bigint, n_tokens bigint")
    got = {r["doc_id"]: (r["whole"], r["inside"], r["split_only_if_long"]) for r in packing_held(places, docs, 8).collect()}
    assert got == {1: (True, True, False), 2: (True, False, True), 3: (True, False, True), 4: (True, True, False), 5: (True, True, True), 6: (False, False, False)}
    docs = spark.createDataFrame([("a", i, 10) for i in range(40)] + [("b", 100, 10)], "source string, doc_id bigint, n_tokens bigint")
    goal = spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 3)], "source string, target_share double, max_repeats int")
    selection, shares = mixture(docs, goal, block_tokens=8, shard_slots=16)
    held = lambda s: {r["source"]: (r["repeats_kept"], r["blocks_once"], r["share_kept"]) for r in mixture_held(s, shares, docs, 8).collect()}
    assert held(selection) == {"a": (True,) * 3, "b": (True,) * 3}
    twice = held(selection.unionByName(selection).unionByName(selection))
    assert not twice["a"][0] and not twice["b"][0]
    moved = held(selection.unionByName(selection.filter("source = 'a'").withColumn("slot_no", F.col("slot_no") + 1000)))
    assert not moved["a"][1] and moved["b"][1]


def test_counts_are_drawn_from_the_multinomial(spark):
    docs = spark.createDataFrame([("a", i, 64) for i in range(400)] + [("b", 1000 + i, 64) for i in range(400)], "source string, doc_id bigint, n_tokens bigint")
    goal = spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    per_shard = lambda **k: [r["n"] for r in mixture(docs, goal, block_tokens=64, shard_slots=100, **k)[0].filter("source = 'a'").groupBy("shard_id").agg(F.countDistinct("slot_no").alias("n")).collect()]
    drawn, even = per_shard(), per_shard(whole_shares_first=True)
    assert set(even) == {50} and len(set(drawn)) > 2 and all(25 < n < 75 for n in drawn)


def test_token_counts(spark):
    texts = [(1, "hello world", "a"), (2, "", "a"), (3, None, "a"), (4, "Größe und Maß " * 3000, "a"), (5, "<|endoftext|>", "a"), (None, "x", "a")]
    got = dict(rows(sized_documents(spark.createDataFrame(texts, "doc_id bigint, text string, n_tokens string").drop("n_tokens"))))
    encoding = _encoding(vocabulary_path())
    for i, text in ((1, "hello world"), (2, ""), (4, "Größe und Maß " * 3000), (5, "<|endoftext|>")):
        ids = encoding.encode_ordinary(text)
        assert got[i] == len(ids) and encoding.decode(ids) == text
    assert sorted(got) == [1, 2, 4, 5]


def _sentences(text):
    """The sentences of a text as lists of folded words, read back from the codes."""
    index = {}
    code, _ = S.Codes(index, grow=True).of([text])
    words, out, there = list(index), [[]], [False]
    for c in code.tolist():
        if c == S._END:
            out.append([])
            there.append(False)
        else:
            there[-1] |= c != S._NUMBER
            if c >= 0:
                out[-1].append(words[c])
    return [s for s, is_there in zip(out, there) if is_there]


def test_sentences_and_folding():
    text = 'The rn burn was "quoted words" fine. (Unrelated: an aside.) Next (15 of 48) one?\n- Enc1osure 110\n\n'
    assert _sentences(text) == [["the", "bum", "was", "fine"], [], ["next", "one"], ["eneiosure"]]
    assert _sentences("No end (an aside.) here 12345") == [["end"], ["here"]] and _sentences("") == [] and _sentences("12 345. !") == []
    assert _sentences("Verslon enc1osure BURN déjà 110 ab") == [[S.fold(w) for w in ["verslon", "enc1osure", "burn", "déjà"]]]


TEXTS = [(1, "Flour and dough. More flour!", "en"), (2, "Flour, dough.", "EN"), (3, "Mast and rudder", None), (4, "", "en"), (5, None, "en"), (None, "dough", "en"), (6, "mast. rudder. mast", "en"), (6, "mast", "en")]


def test_words_and_pairs_by_hand(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string, lang string").withColumn("t", F.lit("x")).repartition(3)
    got = {(r["lang"], r["t"]): (r["docs"], r["words"]) for r in S.word_counts(docs).collect()}
    f = S.fold
    assert got["en", ""] == (5, 0) and got["", ""] == (1, 0) and got["en", f("flour")] == (2, 3) and got["en", f("mast")] == (2, 3) and got["", f("mast")] == (1, 1)
    index = {f(w): i for i, w in enumerate(["flour", "dough", "mast", "rudder"])}
    told = spark.createDataFrame([(1, [0.5, 0.5]), (6, [0.0, 1.0]), (77, [1.0, 0.0])], "lid bigint, given array<double>")
    cells = {(r["kind"], r["i"], r["j"]): r["n"] for r in S.word_pairs(docs, told, index, 2).collect()}
    assert cells == {(0, 0, 1): 2, (0, 2, 3): 2, (1, 0, 0): 0.5, (1, 0, 1): 0.5, (1, 1, 0): 0.5, (1, 1, 1): 0.5, (1, 2, 1): 2, (1, 3, 1): 1}


def test_cells_add_up():
    cells, want = S._Cells(7), defaultdict(float)
    rng = np.random.default_rng(1)
    for _ in range(5):
        i, j, n = rng.integers(0, 9, 40), rng.integers(0, 7, 40), rng.random(40)
        cells.add(i, j, n)
        for a, b, x in zip(i, j, n):
            want[a, b] += x
    got = {(a, b): x for _, a, b, x in cells.frame(0).itertuples(index=False)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and cells.frame(0).empty


def test_contexts_leave_out_what_languages_explain(spark):
    """Words 0 and 1 share more documents than by chance, words 2 and 3 only because they are in the small language."""
    f = lambda *n: [x / s**0.5 for x, s in zip(n, (900, 100))]
    words = spark.createDataFrame([(0, f(90, 0)), (1, f(90, 0)), (2, f(0, 100)), (3, f(0, 100))], "i bigint, f array<double>")
    pairs = spark.createDataFrame([(0, 1, 80.0), (2, 3, 100.0)], "i bigint, j bigint, n double")
    got = {r["i"]: r["features"] for r in S.contexts(pairs, words).collect()}
    assert sorted(got) == [0, 1] and list(got[0].indices) == [1] and abs(got[1].values.sum() - S.CONTEXT) < 1e-9


def _model(flat=False):
    words = ["dough", "flour", "mast", "rudder", "bow", "the"]
    topics = np.array([[0.3, 1e-4], [0.3, 1e-4], [1e-4, 0.3], [1e-4, 0.3], [0.09, 0.09], [1e-3, 1e-3]])
    everywhere = np.array([0.02, 0.02, 0.02, 0.02, 0.02, 0.9])
    labelled = np.array([[20.0, 2.0], [20.0, 2.0], [2.0, 20.0], [2.0, 20.0], [6.0, 10.0], [50.0, 50.0]])
    if flat:
        topics = np.repeat(everywhere[:, None], 2, axis=1)
    names = S.named_topics(topics / topics.sum(0), everywhere, labelled)
    on = np.zeros((3, 2), np.float32)
    on[np.flatnonzero(names >= 0), names[names >= 0]] = 1
    return names, S.Topics({S.fold(w): i for i, w in enumerate(words)}, np.hstack([topics / topics.sum(0), everywhere[:, None]]).astype(np.float32), on)


def test_topics_say_what_a_word_is_on():
    """A word of two topics follows the topics of its text, and labels alone tell nothing."""
    names, model = _model()
    assert names.tolist() == [0, 1]
    share, each = model.proportions(np.array([0, 1, 4, 2, 3, 4]), np.array([2, 2, 1, 2, 2, 1], np.float32), np.array([0, 3]))
    assert np.allclose(share.sum(1), 1, atol=1e-5) and each[2, 0] > 3 * each[2, 1] and each[5, 1] > 3 * each[5, 0]
    texts = ["Flour and dough. The flour. The.", "", "Mast and rudder. Rudder!", "The the.", "Nothing known (at all.)"]
    assert [{k: round(v, 6) for k, v in x.items()} for x in S.sentence_shares(texts, model)] == [{0: round(2 / 3, 6)}, {}, {1: 1.0}, {}, {}]
    names, flat = _model(flat=True)
    assert names.tolist() == [-1, -1] and S.sentence_shares(texts, flat) == [{}] * 5


def test_shares_don_t_depend_on_batches(monkeypatch):
    _, model = _model()
    rng = random.Random(5)
    texts = [". ".join(" ".join(rng.choices(["dough", "flour", "mast", "rudder", "bow", "the", "other"], k=rng.randrange(6))) for _ in range(rng.randrange(9))) for _ in range(200)]
    want = S.sentence_shares(texts, model)
    monkeypatch.setattr(S, "INFERENCE_WORDS", 1)
    assert S.sentence_shares(texts, model) == want and want == [S.sentence_shares([t], model)[0] for t in texts]


def test_subjects_on_held_out_texts(spark):
    """Two invented subjects, a third of the labels wrong; texts of one subject, of both, of none, and with a passing mention."""
    rng = random.Random(4)
    words = {"baking": [f"bake{x}{y}" for x in "abcdefgh" for y in "mnopqrs"], "sailing": [f"sail{x}{y}" for x in "abcdefgh" for y in "mnopqrs"]}
    say = lambda s: f"we saw the {rng.choice(words[s])} and then {rng.choice(words[s])}"
    dull = lambda: rng.choice(["the page is blank today", "someone wrote this again", "it rained all the time", "more on this next week"])
    docs, truth = [], {}
    for i in range(600):
        kind = i % 4
        on = [["baking"], ["sailing"], ["baking", "sailing"], []][kind]
        lines = [say(s) for s in on for _ in range(4)] + [dull() for _ in range(3 if on else 8)]
        if kind == 0:
            lines.append("(By the way: sailam and sailbn.)")
        rng.shuffle(lines)
        docs.append((i, ". ".join(lines) + ".", "en"))
        truth[i] = set(on)
    labels = [(i, rng.choice(["baking", "sailing"]) if rng.random() < 0.3 else rng.choice(sorted(truth[i]))) for i in range(0, 400) if truth[i]]
    schema = "doc_id bigint, text string, lang string"
    documents = spark.createDataFrame([*docs, (None, "x", "en"), (9999, None, None), (9998, "", None)], schema).repartition(3)
    areas = spark.createDataFrame([("baking", "bread"), ("sailing", "boats"), (None, None)], "subject string, description string")
    given = spark.createDataFrame([*labels, (3, "nothing"), (None, "baking"), (1, None)], "doc_id bigint, subject string")
    found = defaultdict(set)
    for d, s in rows(S.subjects_of(documents, given, areas)):
        found[d].add(s)
    held = [i for i in range(400, 600)]
    assert sum(found[i] == truth[i] for i in held) >= 0.95 * len(held)
    assert rows(S.subjects_of(documents.limit(0), given, areas)) == []


def test_sentences_in_quotes_count():
    text = '"The oven is hot." He read "a short name" aloud. "We sail at noon," she said. A stray " quote. Here it goes on. Then " ends.'
    words = [w for s in _sentences(text) for w in s]
    assert len(_sentences(text)) == 6 and S.fold("oven") in words and S.fold("sail") in words and S.fold("goes") in words and S.fold("short") not in words
