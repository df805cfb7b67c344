"""Tuple scoring: candidate pairs, pair precision/recall, sentence scores
(JON-1, JON-4, JON-6, SCO-1..3, SCO-7, AGG-2, AGG-3).

Pair scores (M1-M7): a pair is a match only when subject and predicate share a
(lemmatized) word, so candidates are found with an *exact* blocking join on
``(key, subject word, predicate word)`` that moves ids only; pairs outside it
are NULL by definition and never materialised. Gold objects shortened by
earlier predictions (M5, ``sequential``) is a running minimum over a window
partitioned by ``(key, gold)``, also on ids. The words join last: those of a
sentence once, not once per pair (``sentence_pairs``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuplespark.functions import sqlexpr as SQL
from tuplespark.functions.arrays import explode_rows
from tuplespark.operators.matching import FOLD_CELLS, greedy_match
from tuplespark.session import materialize

#: Gold tuples of a sentence whose pairs meet the sentence's words in one row.
BLOCK = 256
DEFAULT_WEIGHTS = {"subj": 1.0, "pred": 1.0, "auxi": 1.0, "obj": 1.0}


def lemma_table(words: DataFrame, column: str, lemmatizer: Callable[[Column], Column]) -> DataFrame:
    """UDF-3: dictionary ``(word, lemma)`` of the distinct words of ``column``
    (an array of words), from a plug-in ``array<string> -> array<string>``
    (``operators.generate.pandas_lemmatizer``); each word is looked up once."""
    distinct = explode_rows(words, [], F.array_distinct(column), "word").distinct()
    return distinct.select("word", lemmatizer(F.array("word"))[0].alias("lemma")).where("lemma IS NOT NULL")


def with_lemmas(df: DataFrame, columns: dict[str, int], lemmas: DataFrame, key: list[str]) -> DataFrame:
    """JON-4: words replaced by their lemmas from a table ``(word, lemma)``;
    words without an entry stay. ``columns`` names word arrays and their depth
    (1: array of words, 2: array of arrays).

    The distinct words of each row meet the dictionary in a shuffle join that
    AQE broadcasts or splits by measured bytes; a row gets back only its own
    words' entries. ``key`` identifies a row."""
    table = lemmas.where("word IS NOT NULL AND lemma IS NOT NULL").groupBy("word").agg(F.min("lemma").alias("lemma"))
    flat = F.array_distinct(F.concat(*[F.flatten(c) if depth == 2 else F.col(c) for c, depth in columns.items()]))
    found = explode_rows(df, key, flat, "word").join(table.where("word <> lemma"), "word")
    maps = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("word", "lemma"))).alias("__lemmas"))
    joined = df.join(maps, key, "left")
    one = "transform({0}, w_l -> coalesce(element_at(__lemmas, w_l), w_l))"
    for c, depth in columns.items():
        body = one.format(f"`{c}`") if depth == 1 else f"transform(`{c}`, a_l -> {one.format('a_l')})"
        joined = joined.withColumn(c, F.expr(f"IF(__lemmas IS NULL, `{c}`, {body})"))
    return joined.drop("__lemmas")


def tuple_table(df: DataFrame, key: str, triples: str, idx: str, prefix: str,
                lemmas: DataFrame | None = None) -> DataFrame:
    """One row per tuple: ``key, idx`` and word arrays of each part."""
    w = SQL.words
    obj_words = w("concat(o_t.prep, ' ', o_t.obj)")
    rows = explode_rows(df, [key], triples, "__t", idx).selectExpr(
        key, f"CAST({idx} AS BIGINT) AS {idx}", f"{w('__t.subj')} AS {prefix}subj_w",
        f"{w('__t.pred')} AS {prefix}pred_w", f"transform(__t.auxi, a_t -> {w('a_t')}) AS {prefix}aux_w",
        f"transform(__t.objs, o_t -> {obj_words}) AS {prefix}obj_w",
        f"size(__t.objs) AS {prefix}n_objs", f"__t AS {prefix}tuple")
    if lemmas is None:
        return rows
    return with_lemmas(rows, {f"{prefix}subj_w": 1, f"{prefix}pred_w": 1, f"{prefix}aux_w": 2, f"{prefix}obj_w": 2},
                       lemmas, [key, idx])


def candidate_ids(gold: DataFrame, pred: DataFrame, key: str = "doc_id") -> DataFrame:
    """JON-1: ``key, gidx, pidx, g_n_objs, p_n_objs`` of the (gold, predicted)
    pairs whose subjects and predicates share a word: exactly the pairs that
    can score non-NULL, never all pairs.

    Each tuple's ids are replicated once per (subject word, predicate word) of
    its own, and the two sides are joined on ``(key, subject word, predicate
    word)``: a hot sentence spreads over many join keys (AQE splits any skewed
    one). A pair found through several word combinations is kept once; the
    result is hash-partitioned by ``(key, gidx)``."""
    def block(df, p, idx):
        ids = [key, idx, f"{p}n_objs"]
        subj = explode_rows(df, ids + [f"{p}pred_w"], F.array_distinct(f"{p}subj_w"), "__sw")
        return explode_rows(subj, ids + ["__sw"], F.array_distinct(f"{p}pred_w"), "__pw")
    joined = block(gold, "g_", "gidx").join(block(pred, "p_", "pidx"), [key, "__sw", "__pw"]).drop("__sw", "__pw")
    return joined.repartition(key, "gidx").dropDuplicates([key, "gidx", "pidx"])


def candidate_pairs(gold: DataFrame, pred: DataFrame, key: str = "doc_id") -> DataFrame:
    """JON-1 with the words of both tuples attached, once per pair. Also
    ``g_n_before`` and ``g_n_cut``: objects that earlier predictions, and all
    predictions, leave to the gold tuple (SCO-3)."""
    ids = with_cuts(candidate_ids(gold, pred, key), key)
    return (ids.join(gold.drop("g_n_objs"), [key, "gidx"]).join(pred.drop("p_n_objs"), [key, "pidx"]))


def with_cuts(ids: DataFrame, key: str) -> DataFrame:
    """``g_n_before, g_n_cut`` of candidate ids: a running minimum per gold tuple."""
    every = Window.partitionBy(key, "gidx")
    before = every.orderBy("pidx").rowsBetween(Window.unboundedPreceding, -1)
    shortest = F.when(F.col("p_n_objs") > 0, F.col("p_n_objs"))
    return (ids.withColumn("g_n_before", F.least("g_n_objs", F.min(shortest).over(before)))
               .withColumn("g_n_cut", F.least("g_n_objs", F.min(shortest).over(every))))


def _words_sql(text: str, lemmas: bool) -> str:
    """SQL text: the words of ``text``, by their lemmas where the row has ``__lemmas``."""
    w = SQL.words(text)
    return f"transform({w}, w_l -> coalesce(element_at(coalesce(__lemmas, map()), w_l), w_l))" if lemmas else w


def _tuple_words_sql(tuples: str, lemmas: bool) -> str:
    """SQL text: the word arrays of each part of each tuple."""
    w = lambda x: _words_sql(x, lemmas)
    obj = w("concat(o_t.prep, ' ', o_t.obj)")
    return (f"transform({tuples}, t_t -> named_struct('subj_w', {w('t_t.subj')}, 'pred_w', {w('t_t.pred')}, "
            f"'aux_w', transform(t_t.auxi, a_t -> {w('a_t')}), 'obj_w', transform(t_t.objs, o_t -> {obj})))")


def sentence_words(sents: DataFrame, key: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """``key, w``: the distinct words of each sentence's tuples."""
    both = SQL.let(_tuple_words_sql(f"concat(`{gold}`, `{pred}`)", False), "s_s", "array_distinct(flatten(transform(s_s, t_s -> "
                   "concat(t_s.subj_w, t_s.pred_w, flatten(t_s.aux_w), flatten(t_s.obj_w)))))")
    return sents.select(key, F.expr(both).alias("w"))


def sentence_lemmas(sents: DataFrame, key: str, lemmas: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``sents`` with a map ``__lemmas`` of its own words' lemmas (JON-4): the
    distinct words of a sentence (``found``: written ``sentence_words``) meet the
    table ``(word, lemma)`` once."""
    table = lemmas.where("word IS NOT NULL AND lemma IS NOT NULL").groupBy("word").agg(F.min("lemma").alias("lemma"))
    found = explode_rows(sentence_words(sents, key) if found is None else found, [key], "w", "word").join(table.where("word <> lemma"), "word")
    maps = found.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("word", "lemma"))).alias("__lemmas"))
    return sents.join(maps, key, "left")


def sentence_pairs(sents: DataFrame, key: str = "doc_id", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """``candidate_pairs`` (without the tuples) from parsed sentences, a written
    table; with ``__lemmas`` (``sentence_lemmas``) words are compared by their
    lemmas. Only ids are grouped and joined; the text of a sentence moves once
    for every ``BLOCK`` gold tuples and is split after it has moved."""
    lemmas = "__lemmas" in sents.columns

    def rows(column: str, p: str, idx: str) -> DataFrame:
        return explode_rows(sents, [key] + ["__lemmas"] * lemmas, column, "__t", idx).selectExpr(
            key, f"CAST({idx} AS BIGINT) AS {idx}", f"{_words_sql('__t.subj', lemmas)} AS {p}subj_w",
            f"{_words_sql('__t.pred', lemmas)} AS {p}pred_w", f"size(__t.objs) AS {p}n_objs")
    ids = with_cuts(candidate_ids(rows(gold, "g_", "gidx"), rows(pred, "p_", "pidx"), key), key)
    fields = ["gidx", "pidx", "g_n_objs", "p_n_objs", "g_n_before", "g_n_cut"]
    blocks = ids.groupBy(key, F.floor(F.col("gidx") / BLOCK).alias("__block")).agg(F.collect_list(F.struct(*fields)).alias("__ids")).drop("__block")
    pair = ", ".join([f"'{f}', x_i.{f}" for f in fields]
                     + [f"'{s}_{c}', {s}_i.{c}" for s in "gp" for c in ("subj_w", "pred_w", "aux_w", "obj_w")])
    # Bound, so that the words of a sentence are split once and not once per pair.
    every = SQL.let(_tuple_words_sql(f"`{gold}`", lemmas), "gw_i", SQL.let(
        _tuple_words_sql(f"`{pred}`", lemmas), "pw_i", "transform(__ids, x_i -> " + SQL.let(
            "get(gw_i, CAST(x_i.gidx AS INT))", "g_i", SQL.let("get(pw_i, CAST(x_i.pidx AS INT))", "p_i", f"named_struct({pair})")) + ")"))
    return explode_rows(sents.join(blocks, key), [key], F.expr(every), "x").select(key, "x.*")


def score_pairs(pairs: DataFrame, key: str = "doc_id", weights: dict | None = None,
                gold_truncation: str = "sequential") -> DataFrame:
    """SCO-2/SCO-3: ``(key, gidx, pidx, prec, rec, n_cmp_objs, g_n_cut)``;
    prec/rec are NULL when the pair is not a match; ``g_n_cut`` is the gold
    object count after all predictions (for the distance step)."""
    w = dict(DEFAULT_WEIGHTS, **(weights or {}))
    ws, wp, wa, wo = (SQL.dbl(w[k]) for k in ("subj", "pred", "auxi", "obj"))
    ov = SQL.overlap
    if gold_truncation not in ("sequential", "pairwise"):
        raise ValueError(gold_truncation)
    current, cut = ("g_n_before", "g_n_cut") if gold_truncation == "sequential" else ("g_n_objs", "g_n_objs")
    df = (pairs.selectExpr("*", f"{ov('g_subj_w', 'p_subj_w')} AS __ovs", f"{ov('g_pred_w', 'p_pred_w')} AS __ovp")
               .where(f"__ovs * {ws} > 0 AND __ovp * {wp} > 0")
               .withColumn("__ncur", F.col(current)).withColumn("g_n_cut", F.col(cut)))

    def zip_stats(a, b, n):
        return (f"zip_with(slice({a}, 1, {n}), slice({b}, 1, {n}), (za, zb) -> "
                f"named_struct('ov', {ov('za', 'zb')}, 'ng', size(za), 'np', size(zb)))")

    def total(stats, f):
        return f"aggregate({stats}, 0, (sa, sx) -> sa + sx.{f})"

    df = df.selectExpr(
        "*", "CASE WHEN p_n_objs = 0 THEN CASE WHEN __ncur = 0 THEN 0 END ELSE least(__ncur, p_n_objs) END AS n_cmp_objs")
    df = df.selectExpr(
        "*", f"{zip_stats('g_aux_w', 'p_aux_w', 'least(size(g_aux_w), size(p_aux_w))')} AS __aux",
        f"{zip_stats('g_obj_w', 'p_obj_w', 'coalesce(n_cmp_objs, 0)')} AS __obj")
    ok = f"n_cmp_objs IS NOT NULL AND NOT exists(__obj, so -> so.ov * {wo} = 0)"
    num = f"{ws} * __ovs + {wp} * __ovp + {wa} * {total('__aux', 'ov')} + {wo} * {total('__obj', 'ov')}"
    den_p = (f"{ws} * size(p_subj_w) + {wp} * size(p_pred_w) + {wa} * {total('__aux', 'np')} "
             f"+ {wo} * {total('__obj', 'np')}")
    den_g = (f"{ws} * size(g_subj_w) + {wp} * size(g_pred_w) + {wa} * {total('__aux', 'ng')} "
             f"+ {wo} * {total('__obj', 'ng')}")
    return df.selectExpr(key, "gidx", "pidx",
                         f"CASE WHEN {ok} THEN try_divide({num}, {den_p}) END AS prec",
                         f"CASE WHEN {ok} THEN try_divide({num}, {den_g}) END AS rec",
                         "n_cmp_objs", "g_n_cut")


def f_beta(p: Column, r: Column, beta: float) -> Column:
    """SCO-7: F-beta, 0 when both are 0."""
    b2 = beta * beta
    return F.when(p + r > 0, F.try_divide((1 + b2) * p * r, b2 * p + r)).otherwise(F.lit(0.0))


def sentence_scores(sents: DataFrame, scores: DataFrame, key: str = "doc_id",
                    gold: str = "gold", pred: str = "pred", beta: float = 1.0,
                    fold_cells: int = FOLD_CELLS) -> DataFrame:
    """AGG-2/AGG-3 + E1/E2: per sentence precision (greedy one-to-one) and
    recall (best prediction per gold, several gold may share one)."""
    valid = scores.where(F.col("prec").isNotNull())
    rec_num = (valid.groupBy(key, "gidx").agg(F.max("rec").alias("__r"))
                    .groupBy(key).agg(F.sum("__r").alias("rec_num")))
    matched = greedy_match(valid, key, "gidx", "pidx", "prec", higher=True, fold_cells=fold_cells)
    prec_num = matched.groupBy(key).agg(F.sum("prec").alias("prec_num"))
    base = sents.select(key, F.size(gold).cast("bigint").alias("rec_den"),
                        F.size(pred).cast("bigint").alias("prec_den"))
    out = (base.join(prec_num, key, "left").join(rec_num, key, "left")
               .withColumn("prec_num", F.coalesce("prec_num", F.lit(0.0)))
               .withColumn("rec_num", F.coalesce("rec_num", F.lit(0.0))))
    p = F.when(F.col("prec_den") > 0, F.col("prec_num") / F.col("prec_den")).otherwise(F.lit(1.0))
    r = F.when(F.col("rec_den") > 0, F.col("rec_num") / F.col("rec_den")).otherwise(F.lit(0.0))
    return (out.withColumn("prec", p).withColumn("rec", r)
               .withColumn("f_score", f_beta(F.col("prec"), F.col("rec"), beta))
               .withColumn("f_beta", F.lit(float(beta))))
