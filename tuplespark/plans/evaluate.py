"""Chain A, evaluate: parse both texts of each sentence, score, match, sum up.

Shuffles: the blocking join on ids and the per-(sentence, gold) window of the
scoring step, the join of the sentences' words, one aggregation per sentence for
matching and recall, the blocks and events of the distances.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespark.functions.parse import parse_tuples
from tuplespark.operators.distance import sentence_distances, whitespace_tokens
from tuplespark.operators.matching import FOLD_CELLS
from tuplespark.operators.scoring import (lemma_table, score_pairs, sentence_lemmas, sentence_pairs, sentence_scores,
                                          sentence_words)
from tuplespark.session import materialize, release


@dataclass
class EvalConfig:
    """``lemmas``: a table ``(word, lemma)``; or ``lemmatizer``: a plug-in over
    arrays of words, called once per distinct word. ``max_effort`` is the
    over-limit rule of the distances (SCO-6), off by default."""
    beta: float = 1.0
    weights: dict | None = None
    gold_truncation: str = "sequential"
    lemmas: DataFrame | None = None
    lemmatizer: object = None
    tokenizer: object = whitespace_tokens
    max_effort: int | None = None
    fold_cells: int = FOLD_CELLS


def parse_sentences(df: DataFrame, key: str = "doc_id", gold: str = "gold_str", pred: str = "pred_str") -> DataFrame:
    """``(key, gold, pred)`` tuple arrays from the two texts (P1-P9 on both)."""
    g = parse_tuples(df.select(key, gold, pred), gold, out="gold")
    return parse_tuples(g, pred, out="pred").select(key, "gold", "pred")


def pair_scores(sents: DataFrame, key: str = "doc_id", cfg: EvalConfig | None = None) -> DataFrame:
    cfg = cfg or EvalConfig()
    lemmas = cfg.lemmas
    if cfg.lemmatizer is not None:
        # Split once: the dictionary and the sentences read the same words.
        found = materialize(sentence_words(sents, key))
        lemmas = materialize(lemma_table(found, "w", cfg.lemmatizer))
        sents = materialize(sentence_lemmas(sents, key, lemmas, found))
        release(found)
    elif lemmas is not None:
        sents = materialize(sentence_lemmas(sents, key, lemmas))
    return score_pairs(sentence_pairs(sents, key), key, cfg.weights, cfg.gold_truncation)


def evaluate(df: DataFrame, key: str = "doc_id", gold: str = "gold_str", pred: str = "pred_str",
             cfg: EvalConfig | None = None) -> DataFrame:
    """Per sentence: ``prec_num, prec_den, prec, rec_num, rec_den, rec,
    f_score, f_beta, levenshtein_dists, fallback``."""
    return evaluate_tuples(materialize(parse_sentences(df, key, gold, pred)), key, cfg)


def evaluate_tuples(sents: DataFrame, key: str = "doc_id", cfg: EvalConfig | None = None) -> DataFrame:
    """``evaluate`` for sentences whose tuples are parsed: ``key, gold, pred``
    (a written table: it is read several times)."""
    cfg = cfg or EvalConfig()
    scores = materialize(pair_scores(sents, key, cfg))
    per_sent = sentence_scores(sents, scores, key, beta=cfg.beta, fold_cells=cfg.fold_cells)
    cut = scores if cfg.gold_truncation == "sequential" else None
    dists = sentence_distances(sents, key, gold_cut=cut, tokenizer=cfg.tokenizer, max_effort=cfg.max_effort,
                               fold_cells=cfg.fold_cells)
    return per_sent.join(dists, key)
