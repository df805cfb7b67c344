"""Exact distances and matching: any number of objects, tokens and cells."""

import random
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import texts_df
from tests.reference_loops import edit_distance
from tests.reference_loops import greedy as loop_greedy
from tests.reference_loops import sentence as loop_sentence
from tuplespark.operators import distance as D
from tuplespark.operators import packed as packed_tuples
from tuplespark.operators.matching import greedy_match
from tuplespark.operators.metrics import distance_histogram
from tuplespark.plans.evaluate import EvalConfig, evaluate, parse_sentences

tokens = st.lists(st.sampled_from("abcd"), max_size=5)


@settings(max_examples=150, deadline=None)
@given(tokens, tokens, st.lists(st.lists(st.sampled_from("abc"), max_size=3), max_size=5))
def test_subset_recurrence_equals_all_orders(gold, head, objs):
    want = min(edit_distance(gold, head + [t for o in order for t in o]) for order in permutations(objs))
    assert D.least_distance(gold, head, objs) == want


@pytest.mark.parametrize("n", [8, 12])
def test_many_objects_in_any_order_are_equal(spark, n):
    objs = [f"o{i} x{i}" for i in range(n)]
    gold = "s ,, p ,, " + " ,, ".join(objs)
    pred = "s ,, p ,, " + " ,, ".join(objs[::-1])
    same = "s ,, p ,, " + " ,, ".join(["one thing"] * n)
    rows = {r.doc_id: list(r.levenshtein_dists) for r in evaluate(texts_df(spark, [(1, gold, pred), (2, same, same)])).collect()}
    assert rows == {1: [0], 2: [0]}


def test_levels_as_rows_equal_the_local_recurrence(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice("abcde") for _ in range(rng.randint(0, 8))], [rng.choice("ab")],
             [[rng.choice("abcde") for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 5))]) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, g array<string>, h array<string>, o array<array<string>>")
    want = {i: D.least_distance(g, h, o) for i, g, h, o in rows}
    assert {r.k: r.d for r in D.least_distances(df, ["k"], local_states=4).collect()} == want
    assert {r.k: r.d for r in D.least_distances(df, ["k"]).collect()} == want


def test_distance_of_thousands_of_distinct_tokens(spark):
    words = [f"w{i}" for i in range(4100)]
    df = spark.createDataFrame([(1, words, words), (2, words, words[1:] + ["new"]), (3, [], words[:3]), (4, words[:5], ["x"] * 5)],
                               "k long, a array<string>, b array<string>")
    got = {r.k: r.d for r in df.select("k", F.expr(D.token_distance_sql("a", "b")).alias("d")).collect()}
    assert got == {1: 0, 2: 2, 3: 3, 4: 5}


def test_coding_limit_falls_back_to_an_exact_form(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice("abcdef") for _ in range(rng.randint(0, 9))], [rng.choice("abcdef") for _ in range(rng.randint(0, 9))])
            for i in range(40)]
    df = spark.createDataFrame(rows, "k long, a array<string>, b array<string>")
    want = {i: edit_distance(a, b) for i, a, b in rows}
    for codes in (D.CODES, 1):
        assert {r.k: r.d for r in df.select("k", F.expr(D.token_distance_sql("a", "b", codes)).alias("d")).collect()} == want


def test_codes_beyond_the_basic_plane_are_distinct(spark):
    # 60,000 tokens reach the characters outside the basic plane.
    df = spark.range(1).select(F.expr("transform(sequence(1, 60000), i -> concat('t', i))").alias("t"))
    row = df.select("t", F.expr(D.vocabulary_sql("t")).alias("v")).select(F.expr(D.code_sql("t", "v")).alias("c")).first()
    assert len(row.c) == 60000 and len(set(row.c)) == 60000 and max(map(ord, row.c)) > 0xFFFF


def _long_text(rng, n):
    lines = []
    for k in range(n):
        objs = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 3))]
        parts = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 2))), rng.choice("ab")] + objs
        lines.append((f"{k + 1}. " if k else "") + " ,, ".join(parts))
    return "\n".join(lines)


@pytest.mark.parametrize("fold_cells", [7, 20000])
def test_matched_distances_equal_the_loop_over_blocks_and_bands(spark, fold_cells):
    rng = random.Random(21)
    # More gold tuples than a block holds, and bands of a few events.
    rows = [(1, _long_text(rng, 70 if fold_cells > 7 else 9), _long_text(rng, 12)), (2, _long_text(rng, 3), _long_text(rng, 8)), (3, "a ,, b", "")]
    for mode in ("sequential", "pairwise"):
        got = {r.doc_id: list(r.levenshtein_dists) for r in
               evaluate(texts_df(spark, rows), cfg=EvalConfig(gold_truncation=mode, fold_cells=fold_cells)).collect()}
        assert got == {i: loop_sentence(g, p, mode)["dists"] for i, g, p in rows}


def test_decreasing_chain_is_folded_in_bands(spark):
    # Each cell is dominated by the one before it: no round of dominant cells takes more than one.
    n = 60
    cells = [(1, i, i, 1000.0 - 2 * i) for i in range(n)] + [(1, i + 1, i, 999.0 - 2 * i) for i in range(n - 1)] + [(2, 0, 0, 1.0)]
    df = spark.createDataFrame(cells, "k long, g long, p long, s double")
    got = sorted((r.k, r.g, r.p, r.s) for r in greedy_match(df, "k", "g", "p", "s", fold_cells=12).collect())
    want = [(k, i, j, s) for k in (1, 2) for (i, j), s in loop_greedy({(i, j): s for kk, i, j, s in cells if kk == k})]
    assert got == sorted(want)


def _random_tuples(rng, most):
    tokens = lambda n: [rng.randrange(5) for _ in range(rng.randint(0, n))]
    golds = [tokens(9) for _ in range(rng.randint(1, most))]
    return golds, [(tokens(3), [tokens(3) for _ in range(rng.randint(0, 5))]) for _ in range(rng.randint(1, most))]


def test_packed_gold_tuples_equal_the_recurrence_and_the_loop():
    rng = random.Random(5)
    for _ in range(150):
        golds, preds = _random_tuples(rng, 6)
        cells = {(i, j): D.least_distance(g, *p) for i, g in enumerate(golds) for j, p in enumerate(preds)}
        packed = packed_tuples.Golds(golds)
        for j, p in enumerate(preds):
            assert packed.distances(p).tolist() == [cells[i, j] for i in range(len(golds))]
            assert [packed_tuples.is_order(g, p) for g in golds] == [cells[i, j] == 0 for i in range(len(golds))]
        assert packed_tuples.match(golds, preds) == [d for _, d in loop_greedy(cells, higher=False)]


def test_sentences_in_their_row_equal_those_in_blocks(spark):
    rng = random.Random(8)
    rows = [(i, _long_text(rng, rng.randint(0, 12)), _long_text(rng, rng.randint(0, 12))) for i in range(12)] + [(90, "", ""), (91, None, "a ,, b")]
    sents = parse_sentences(texts_df(spark, rows)).localCheckpoint()
    cut = spark.createDataFrame([(i, 0, 1) for i in range(12)], "doc_id long, gidx long, g_n_cut int")
    for given in (None, cut):
        got = [{r.doc_id: list(r.levenshtein_dists) for r in D.sentence_distances(sents, gold_cut=given, local_pairs=n).collect()}
               for n in (0, D.LOCAL_PAIRS)]
        assert got[0] == got[1] and len(got[0]) == len(rows)


def test_histogram_reads_the_distances_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    df = spark.range(50).selectExpr("array(CAST(id % 3 AS INT)) AS levenshtein_dists").mapInArrow(count, "levenshtein_dists array<int>")
    assert [(r.distance, r.n) for r in distance_histogram(df).collect()] == [(0, 17), (1, 17), (2, 16)]
    assert read.value == 50
