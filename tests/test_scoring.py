"""Scoring, matching and distances (U7-U10, E2, G1-G4) and brute force."""

import random

from tests.conftest import texts_df
from tests.reference_loops import greedy as loop_greedy
from tests.reference_loops import sentence as loop_sentence
from tuplespark.operators.matching import greedy_match
from tuplespark.plans.evaluate import EvalConfig, evaluate, pair_scores, parse_sentences

U7_GOLD = "ann ,, gave ,, the red book ,, to ### bob smith"
U7_PRED = "ann ,, gave ,, the book\n2. ann ,, gave ,, the red book ,, to ### bob jones"


def _eval(spark, rows, mode="sequential"):
    ev = evaluate(texts_df(spark, rows), cfg=EvalConfig(gold_truncation=mode))
    return {r.doc_id: r for r in ev.collect()}


def test_u7_sequential_and_pairwise(spark):
    seq = _eval(spark, [(1, U7_GOLD, U7_PRED)])[1]
    pw = _eval(spark, [(1, U7_GOLD, U7_PRED)], "pairwise")[1]
    assert abs(seq.prec - 0.5) < 1e-12 and abs(pw.prec - 0.5) < 1e-12
    assert abs(seq.rec - 1.0) < 1e-12 and abs(pw.rec - 0.875) < 1e-12
    assert list(seq.levenshtein_dists) == [1] and list(pw.levenshtein_dists) == [1]
    sc = {(r.gidx, r.pidx): (r.prec, r.rec) for r in pair_scores(parse_sentences(texts_df(spark, [(1, U7_GOLD, U7_PRED)]))).collect()}
    assert sc[(0, 0)] == (1.0, 0.8) and sc[(0, 1)] == (1.0, 1.0)


def test_u8_greedy_ties(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.9), (1, 1, 1, 0.5)],
                                  "k long, g long, p long, s double")
    got = sorted((r.g, r.p, r.s) for r in greedy_match(cells, "k", "g", "p", "s").collect())
    assert got == [(0, 0, 0.9), (1, 1, 0.5)]


def test_u9_u10_object_counts(spark):
    r9 = _eval(spark, [(1, "a ,, b ,, c", "a ,, b")])[1]
    assert r9.prec == 0.0 and r9.rec == 0.0
    r10 = _eval(spark, [(1, "a ,, b", "a ,, b ,, c ,, d")])[1]
    assert r10.prec == 1.0 and r10.rec == 1.0


def test_e2_no_predictions(spark):
    r = _eval(spark, [(1, "a ,, b", "")])[1]
    assert r.prec == 1.0 and r.rec == 0.0 and r.f_score == 0.0


def _random_text(rng, n_lines):
    words = ["a", "b", "c", "d"]
    lines = []
    for k in range(n_lines):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(2, 4))]
        if rng.random() < 0.3:
            parts[1] = "not ### " + parts[1]
        if len(parts) > 2 and rng.random() < 0.5:
            parts[2] = rng.choice(words) + " ### " + parts[2]
        line = " ,, ".join(parts)
        lines.append(line if k == 0 else f"{k + 1}. {line}")
    return "\n".join(lines)


def test_evaluate_matches_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, _random_text(rng, rng.randint(1, 4)), _random_text(rng, rng.randint(0, 4))) for i in range(60)]
    for mode in ("sequential", "pairwise"):
        got = _eval(spark, rows, mode)
        for i, g, p in rows:
            want = loop_sentence(g, p, mode)
            r = got[i]
            assert abs(r.prec_num - want["prec_num"]) < 1e-9, (i, mode)
            assert abs(r.rec_num - want["rec_num"]) < 1e-9, (i, mode)
            assert sorted(r.levenshtein_dists) == want["dists"], (i, mode, g, p)


def test_greedy_rounds_equal_fold(spark):
    """Hot groups go through locally-dominant rounds; result equals the fold."""
    rng = random.Random(3)
    cells = [(k, i, j, float(rng.randint(0, 5))) for k in range(3) for i in range(12) for j in range(9) if rng.random() < 0.7]
    df = spark.createDataFrame(cells, "k long, g long, p long, s double")
    for higher in (True, False):
        fold = sorted(tuple(r) for r in greedy_match(df, "k", "g", "p", "s", higher=higher).collect())
        rounds = sorted(tuple(r) for r in greedy_match(df, "k", "g", "p", "s", higher=higher, fold_cells=5).collect())
        want = []
        for k in range(3):
            picked = loop_greedy({(i, j): s for kk, i, j, s in cells if kk == k}, higher)
            want += [(k, i, j, s) for (i, j), s in picked]
        assert fold == sorted(want) and rounds == sorted(want)


def test_distance_fallback(spark):
    ev = evaluate(texts_df(spark, [(1, "a ,, b ,, c ,, d", "a ,, b ,, c ,, d\n2. x ,, y")]),
                  cfg=EvalConfig(max_effort=1)).first()
    assert ev.fallback and list(ev.levenshtein_dists) == [20]


def test_pairs_of_whole_sentences_equal_the_joined_tuples(spark, monkeypatch):
    from tuplespark.operators import scoring as S
    from tuplespark.plans.evaluate import parse_sentences
    monkeypatch.setattr(S, "BLOCK", 2)
    text = "cats see ,, do ### eat ,, in ### the houses ,, mice\n2. cats ,, eat ,, mice\n3. dogs ,, eat\n4. cats ,, eats ,, a ,, b c"
    rows = [(1, text, text.replace("houses", "house")), (2, "a ,, b", ""), (3, "a ,, b", "a c ,, b ,, d"), (4, None, "a ,, b")]
    sents = parse_sentences(spark.createDataFrame(rows, "doc_id long, gold_str string, pred_str string")).localCheckpoint()
    lemmas = spark.createDataFrame([("cats", "cat"), ("eats", "eat"), ("houses", "house"), ("dogs", "cats")], "word string, lemma string")
    for table in (None, lemmas):
        want = S.candidate_pairs(S.tuple_table(sents, "doc_id", "gold", "gidx", "g_", table), S.tuple_table(sents, "doc_id", "pred", "pidx", "p_", table))
        got = S.sentence_pairs(sents if table is None else S.sentence_lemmas(sents, "doc_id", table))
        assert "g_tuple" not in got.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
        assert got.count() > 5


def test_words_move_once_per_sentence_and_not_once_per_pair(spark):
    from tuplespark.operators import scoring as S
    from tuplespark.plans.evaluate import parse_sentences
    sents = parse_sentences(spark.createDataFrame([(1, "a ,, b", "a ,, b")], "doc_id long, gold_str string, pred_str string")).localCheckpoint()
    plan = S.score_pairs(S.sentence_pairs(sents))._jdf.queryExecution().optimizedPlan().toString()
    # One join finds the ids, one brings the sentences.
    assert plan.count("Join Inner") == 2
