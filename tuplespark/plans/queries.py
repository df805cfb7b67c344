"""Named queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver tables (or data Spark derives from them), so its
work grows with them. Computed columns carry the same names as the DuckDB SQL
in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplespark.functions.arrays import explode_rows
from tuplespark.functions.parse import parse_tuples as _parse
from tuplespark.operators.facts import explode_facts, widen_objects
from tuplespark.sources.fixtures import oie_pairs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _tuple_rows(df: DataFrame, key: str = "doc_id", triples: str = "triples") -> DataFrame:
    """One row per parsed tuple with flat string columns."""
    t = F.col("t")
    return explode_rows(df, [key], triples, "t", "tidx").select(
        key, F.col("tidx").cast("bigint").alias("tidx"), t["subj"].alias("subj"), t["pred"].alias("pred"),
        F.array_join(t["auxi"], " ### ").alias("auxi"), F.size(t["auxi"]).cast("bigint").alias("n_auxi"),
        F.array_join(F.transform(t["objs"], lambda o: F.concat(o["prep"], F.lit(" ### "), o["obj"])), " ,, ").alias("objs"),
        F.size(t["objs"]).cast("bigint").alias("n_objs"))


@query("parse_tuples")
def q_parse_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of each sentence parsed in one pass over the fixture."""
    sides = _parse(_parse(oie_pairs(spark, sf_dir), "gold_str", out="g"), "pred_str", out="p")
    tagged = F.concat(F.transform("g", lambda t, i: F.struct(F.lit("gold").alias("side"), i.alias("i"), t.alias("t"))),
                      F.transform("p", lambda t, i: F.struct(F.lit("pred").alias("side"), i.alias("i"), t.alias("t"))))
    rows = explode_rows(sides, ["doc_id"], tagged, "x")
    t = F.col("x.t")
    return rows.select(
        "doc_id", F.col("x.side").alias("side"), F.col("x.i").cast("bigint").alias("tidx"),
        t["subj"].alias("subj"), t["pred"].alias("pred"),
        F.array_join(t["auxi"], " ### ").alias("auxi"), F.size(t["auxi"]).cast("bigint").alias("n_auxi"),
        F.array_join(F.transform(t["objs"], lambda o: F.concat(o["prep"], F.lit(" ### "), o["obj"])), " ,, ").alias("objs"),
        F.size(t["objs"]).cast("bigint").alias("n_objs"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = oie_pairs(spark, sf_dir)
    parsed = _parse(pairs, "pred_str").select(
        F.col("doc_id").cast("string").alias("articleId"), F.lit(0).cast("bigint").alias("lineId"), "triples")
    return widen_objects(explode_facts(parsed)).withColumn("factId", F.col("factId").cast("bigint")) \
        .withColumn("n_objs", F.col("n_objs").cast("bigint"))


@query("facts_wide")
def q_facts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir)


# ---------------------------------------------------------------------------
# M1: text side
# ---------------------------------------------------------------------------
from tuplespark import constants as K  # noqa: E402
from tuplespark.functions.parse import parse_annotation as _parse_anno  # noqa: E402
from tuplespark.functions.text import (linearize, obj_text, pred_text, render_plain,  # noqa: E402
                                       render_target, words)
from tuplespark.operators.corpus import (group_by_sentence, record_violations,  # noqa: E402
                                         render_annotation_prompt, reply_violations, to_template,
                                         valid_reply)
from tuplespark.operators.facts import split_ident, with_ident  # noqa: E402
from tuplespark.operators.prompts import build_messages, render_chat  # noqa: E402
from tuplespark.operators.sentences import split_sentences  # noqa: E402
from tuplespark.sources.tables import table  # noqa: E402


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return split_sentences(docs.withColumn("articleId", F.col("doc_id").cast("string")))


def gold_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parse(oie_pairs(spark, sf_dir), "gold_str")


def gold_tuples(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """Parsed gold tuples, one row per tuple: ``doc_id, tidx, t``."""
    parsed = gold_parsed(spark, sf_dir) if parsed is None else parsed
    return explode_rows(parsed, ["doc_id"], "triples", "t", "tidx") \
                 .withColumn("tidx", F.col("tidx").cast("bigint"))


def gold_records(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """Gold tuples as ragged TSV records ``(sent, pred, args, line_no)``."""
    t = F.col("t")
    return gold_tuples(spark, sf_dir, parsed).select(
        F.concat(F.lit("sentence "), F.col("doc_id").cast("string")).alias("sent"),
        pred_text(t).alias("pred"),
        F.concat(F.array(t["subj"]), F.transform(t["objs"], obj_text)).alias("args"),
        (F.col("doc_id") * 1000000 + F.col("tidx")).alias("line_no"))


def gold_replies(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """Annotation replies: gold tuples predicate first, every line numbered."""
    parsed = gold_parsed(spark, sf_dir) if parsed is None else parsed
    reply = F.array_join(F.transform("triples", lambda t, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), linearize(t, "pred_first"))), "\n")
    return parsed.select("doc_id", reply.alias("reply"))


def pred_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw generated text re-separated with ``;;`` (subject first): a reply
    stream with non-numeric items and separators in the subject."""
    return oie_pairs(spark, sf_dir).select(
        "doc_id", F.regexp_replace("pred_str", " ,, ", K.PRED_FIRST_SEP).alias("reply"))


@query("split_sentences")
def q_split_sentences(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", F.col("lineId").cast("bigint").alias("lineId"), "s")


@query("ident_build")
def q_ident_build(spark, sf_dir):
    return with_ident(sentences(spark, sf_dir)).select(
        "articleId", F.col("lineId").cast("bigint").alias("lineId"), "ident")


@query("ident_split")
def q_ident_split(spark, sf_dir):
    built = with_ident(sentences(spark, sf_dir)).select("ident")
    return split_ident(built).select("ident", "articleId", F.col("lineId").cast("bigint").alias("lineId"))


@query("template_reformat")
def q_template_reformat(spark, sf_dir):
    tpl = to_template(gold_records(spark, sf_dir))
    cols = [F.col(f"obj{i}.{f}").alias(f"obj{i}_{f}") for i in range(K.TEMPLATE_OBJECTS) for f in ("prep", "obj")]
    return tpl.select("line_no", "sent", "pred", "subj", *cols, "auxilliary")


@query("linearize_tuples")
def q_linearize(spark, sf_dir):
    return gold_tuples(spark, sf_dir).select("doc_id", "tidx", linearize(F.col("t")).alias("text"))


@query("linearize_pred_first")
def q_linearize_pf(spark, sf_dir):
    return gold_tuples(spark, sf_dir).select("doc_id", "tidx", linearize(F.col("t"), "pred_first").alias("text"))


@query("render_target")
def q_render_target(spark, sf_dir):
    parsed = _parse(oie_pairs(spark, sf_dir), "gold_str")
    return parsed.select("doc_id", render_target(F.col("triples")).alias("target"))


@query("render_plain")
def q_render_plain(spark, sf_dir):
    return gold_tuples(spark, sf_dir).select("doc_id", "tidx", render_plain(F.col("t")).alias("plain"))


@query("annotation_prompt")
def q_annotation_prompt(spark, sf_dir):
    grouped = group_by_sentence(gold_records(spark, sf_dir))
    return render_annotation_prompt(grouped).select(
        "sent", F.col("sidx").cast("bigint").alias("sidx"), F.size("records").cast("bigint").alias("n_records"), "prompt")


@query("build_messages")
def q_build_messages(spark, sf_dir):
    msgs = build_messages(sentences(spark, sf_dir), "s", shots="none")
    return explode_rows(msgs.withColumn("lineId", F.col("lineId").cast("bigint")), ["doc_id", "lineId"],
                        "messages", "m", "msg_idx").select(
        "doc_id", "lineId", F.col("msg_idx").cast("bigint").alias("msg_idx"),
        F.col("m.role").alias("role"), F.col("m.content").alias("content"))


@query("render_chat")
def q_render_chat(spark, sf_dir):
    return render_chat(table(spark, sf_dir, "conversations"))


@query("parse_lines")
def q_parse_lines(spark, sf_dir):
    """FLT-1..4 / SET-1: kept lines of each output, the text left after the
    number is cut (NULL = rejected) and its number of ``,,`` parts."""
    pairs = oie_pairs(spark, sf_dir)
    lines = F.array_distinct(F.filter(F.split(F.lower("pred_str"), "\n", -1), lambda s: F.trim(s) != ""))
    from tuplespark.functions.parse import DIGITS, _after_first_dot
    body = F.transform(lines, lambda s, i: F.struct(s.alias("line"), F.when(i == 0, s).when(
        F.get(F.split(s, "[.]", -1), 0).rlike(DIGITS), _after_first_dot(s)).alias("body")))
    return explode_rows(pairs, ["doc_id"], body, "b", "line_idx").select(
        "doc_id", F.col("line_idx").cast("bigint").alias("line_idx"), F.col("b.line").alias("line"),
        F.col("b.body").alias("body"),
        F.when(F.col("b.body").isNotNull(), F.size(F.split(F.col("b.body"), K.PART_SPLIT, -1)))
         .cast("bigint").alias("n_parts"))


@query("parse_annotation")
def q_parse_annotation(spark, sf_dir):
    return _tuple_rows(_parse_anno(gold_replies(spark, sf_dir), "reply"))


@query("valid_replies")
def q_valid_replies(spark, sf_dir):
    r = pred_replies(spark, sf_dir)
    return r.select("doc_id", F.length("reply").cast("bigint").alias("n_chars"), valid_reply(F.col("reply")).alias("valid"))


@query("annotation_violations")
def q_annotation_violations(spark, sf_dir):
    replies = reply_violations(pred_replies(spark, sf_dir), "reply", ["doc_id"]) \
        .select(F.col("doc_id").cast("string").alias("key"), "item_idx", "rule", "detail")
    recs = record_violations(gold_records(spark, sf_dir), ["sent"]) \
        .select(F.col("sent").alias("key"), F.lit(None).cast("bigint").alias("item_idx"), "rule", "detail")
    return replies.unionByName(recs)


@query("long_outputs")
def q_long_outputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(words(F.col("text"))).alias("n_tokens"))
    return docs.where(F.col("n_tokens") > K.LONG_OUTPUT_TOKENS).select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"))


# ---------------------------------------------------------------------------
# M2 / M3: scoring, matching, distances, corpus metrics
# ---------------------------------------------------------------------------
from tuplespark.operators.matching import greedy_match  # noqa: E402
from tuplespark.operators.metrics import (distance_histogram, macro_metrics, mean_distance,  # noqa: E402
                                          micro_metrics)
from tuplespark.operators.distance import (pair_distances, sentence_distances,  # noqa: E402
                                           token_distance_sql)
from tuplespark.operators.scoring import (candidate_ids, candidate_pairs, score_pairs,  # noqa: E402
                                          sentence_pairs, sentence_scores, tuple_table)
from tuplespark.functions import sqlexpr as SQL  # noqa: E402
from tuplespark.plans.evaluate import EvalConfig, evaluate, parse_sentences  # noqa: E402
from tuplespark.session import materialize  # noqa: E402

BETA = 0.5   # the published evaluation runs use F-0.5 as the F-beta


def _r6(c):
    return F.round(c, 6)


def _sents(spark, sf_dir):
    """Parsed sentences, written once to the checkpoint folder."""
    return materialize(parse_sentences(oie_pairs(spark, sf_dir)))


def _pairs(spark, sf_dir, sents=None):
    s = sents if sents is not None else _sents(spark, sf_dir)
    return candidate_pairs(tuple_table(s, "doc_id", "gold", "gidx", "g_"),
                           tuple_table(s, "doc_id", "pred", "pidx", "p_"), "doc_id")


def _scored(spark, sf_dir):
    """``(sents, scores)`` with both materialized once."""
    s = _sents(spark, sf_dir)
    return s, materialize(score_pairs(sentence_pairs(s)))


@query("candidate_pairs")
def q_candidate_pairs(spark, sf_dir):
    s = _sents(spark, sf_dir)
    ids = candidate_ids(tuple_table(s, "doc_id", "gold", "gidx", "g_"), tuple_table(s, "doc_id", "pred", "pidx", "p_"))
    return ids.select("doc_id", "gidx", "pidx")


@query("word_overlap")
def q_word_overlap(spark, sf_dir):
    """SCO-1 by the expression that scoring uses."""
    # Bound, so that a pair's texts are split once and not once per common word.
    texts = [SQL.words(SQL.plain(t)) for t in ("g_tuple", "p_tuple")]
    ov_text = SQL.let(texts[0], "a_t", SQL.let(texts[1], "b_t", SQL.overlap("a_t", "b_t")))
    return _pairs(spark, sf_dir).selectExpr(
        "doc_id", "gidx", "pidx", f"CAST({SQL.overlap('g_subj_w', 'p_subj_w')} AS BIGINT) AS ov_subj",
        f"CAST({SQL.overlap('g_pred_w', 'p_pred_w')} AS BIGINT) AS ov_pred", f"CAST({ov_text} AS BIGINT) AS ov_text")


@query("pair_scores")
def q_pair_scores(spark, sf_dir):
    sc = _scored(spark, sf_dir)[1]
    return sc.select("doc_id", "gidx", "pidx", _r6(F.col("prec")).alias("prec"), _r6(F.col("rec")).alias("rec"),
                     F.col("n_cmp_objs").cast("bigint").alias("n_cmp_objs"))


@query("gold_truncation")
def q_gold_truncation(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    sc = score_pairs(p).join(p.select("doc_id", "gidx", "g_n_objs").distinct(), ["doc_id", "gidx"])
    return (sc.where(F.col("g_n_cut") < F.col("g_n_objs"))
              .select("doc_id", "gidx", F.col("g_n_objs").cast("bigint").alias("n_objs"),
                      F.col("g_n_cut").cast("bigint").alias("n_cut")).distinct())


@query("greedy_precision")
def q_greedy_precision(spark, sf_dir):
    sc = _scored(spark, sf_dir)[1].where(F.col("prec").isNotNull())
    m = greedy_match(sc, "doc_id", "gidx", "pidx", "prec", higher=True)
    return m.select("doc_id", "gidx", "pidx", _r6(F.col("prec")).alias("prec"))


def _sentence_scores(spark, sf_dir):
    s, sc = _scored(spark, sf_dir)
    return sentence_scores(s, sc, beta=BETA)


@query("sentence_scores")
def q_sentence_scores(spark, sf_dir):
    ss = _sentence_scores(spark, sf_dir)
    return ss.select("doc_id", *[_r6(F.col(c)).alias(c) for c in ("prec_num", "prec", "rec_num", "rec", "f_score", "f_beta")],
                     "prec_den", "rec_den")


@query("macro_metrics")
def q_macro(spark, sf_dir):
    m = macro_metrics(_sentence_scores(spark, sf_dir), BETA)
    return m.select(F.col("n_sentences").cast("bigint").alias("n_sentences"),
                    *[_r6(F.col(c)).alias(c) for c in ("macro_prec", "macro_rec", "macro_f_beta", "macro_f1")])


@query("micro_metrics")
def q_micro(spark, sf_dir):
    m = micro_metrics(_sentence_scores(spark, sf_dir), BETA)
    return m.select(*[_r6(F.col(c)).alias(c) for c in ("micro_prec", "micro_rec", "micro_f_beta", "micro_f1")])


@query("token_distance")
def q_token_distance(spark, sf_dir):
    d = token_distance_sql(SQL.words(SQL.plain("g_tuple")), SQL.words(SQL.plain("p_tuple")))
    return _pairs(spark, sf_dir).select("doc_id", "gidx", "pidx", F.expr(d).cast("bigint").alias("dist"))


@query("min_perm_distance")
def q_min_perm_distance(spark, sf_dir):
    d = pair_distances(_pairs(spark, sf_dir), ["doc_id", "gidx", "pidx"], "g_tuple", "p_tuple")
    return d.withColumn("dist", F.col("dist").cast("bigint"))


@query("object_permutations")
def q_object_permutations(spark, sf_dir):
    """JON-8 as rows, by the expression that the distances use."""
    s = _sents(spark, sf_dir)
    t = explode_rows(s, ["doc_id"], "pred", "t", "pidx").withColumn("pidx", F.col("pidx").cast("bigint"))
    per = explode_rows(t, ["doc_id", "pidx", "t"], F.expr(SQL.all_orders("size(t.objs)")), "perm", "perm_idx")
    return per.select("doc_id", "pidx", F.col("perm_idx").cast("bigint").alias("perm_idx"),
                      F.array_join(F.transform("perm", lambda k: F.get(F.col("t.objs"), k)["obj"]), " | ").alias("objs"))


def _dist(spark, sf_dir, **kw):
    s, sc = _scored(spark, sf_dir)
    return sentence_distances(s, gold_cut=sc, **kw)


def _distances(spark, sf_dir, mode="sequential", **kw):
    return evaluate(oie_pairs(spark, sf_dir), cfg=EvalConfig(beta=BETA, gold_truncation=mode, **kw))


@query("greedy_distance")
def q_greedy_distance(spark, sf_dir):
    ev = _dist(spark, sf_dir)
    return ev.select("doc_id", F.posexplode_outer("levenshtein_dists").alias("match_idx", "dist")) \
             .where(F.col("dist").isNotNull()).select(
        "doc_id", F.col("match_idx").cast("bigint").alias("match_idx"), F.col("dist").cast("bigint").alias("dist"))


@query("distance_histogram")
def q_distance_histogram(spark, sf_dir):
    return distance_histogram(_dist(spark, sf_dir))


@query("distance_histogram_pairwise")
def q_distance_histogram_pw(spark, sf_dir):
    return distance_histogram(sentence_distances(_sents(spark, sf_dir)))


@query("mean_distance")
def q_mean_distance(spark, sf_dir):
    m = mean_distance(_dist(spark, sf_dir))
    return m.select(_r6(F.col("mean_distance")).alias("mean_distance"), F.col("n_matches").cast("bigint").alias("n_matches"))


@query("distance_fallback")
def q_distance_fallback(spark, sf_dir):
    """SCO-6 with a small effort limit (12 edit distances per sentence) so the
    over-limit rule is exercised on the fixture."""
    d = _dist(spark, sf_dir, max_effort=12)
    return d.select("doc_id", "fallback", F.size("levenshtein_dists").cast("bigint").alias("n_dists"),
                    F.aggregate("levenshtein_dists", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_dists"))


@query("evaluate_chain")
def q_evaluate(spark, sf_dir):
    ev = _distances(spark, sf_dir)
    return ev.select("doc_id", *[_r6(F.col(c)).alias(c) for c in ("prec", "rec", "f_score")],
                     F.array_join(F.transform("levenshtein_dists", lambda x: x.cast("string")), ",").alias("dists"))


# ---------------------------------------------------------------------------
# M4: corpus sources/sinks, resume, splits, corpus statistics
# ---------------------------------------------------------------------------
from tuplespark.operators.corpus import resume_split, seeded_split  # noqa: E402
from tuplespark.operators.metrics import corpus_stats, usage_totals  # noqa: E402
from tuplespark.operators.sentences import chunk_slice  # noqa: E402
from tuplespark.session import dropping_shuffles, release, scratch_path  # noqa: E402
from tuplespark.sources import corpus as C  # noqa: E402
from tuplespark.sources.tables import read_documents  # noqa: E402

import os as _os  # noqa: E402


def _flat_tuples(df: DataFrame, keep: list[str], triples: str = "triples") -> DataFrame:
    t = F.col("t")
    return explode_rows(df, keep, triples, "t", "tidx").select(
        *keep, F.col("tidx").cast("bigint").alias("tidx"), t["subj"].alias("subj"), t["pred"].alias("pred"),
        F.array_join(t["auxi"], " ### ").alias("auxi"),
        F.array_join(F.transform(t["objs"], lambda o: F.concat(o["prep"], F.lit(" ### "), o["obj"])), " ,, ").alias("objs"))


def annotated_corpus(spark, sf_dir, parsed=None, sent=None):
    """Annotated records ``(sidx, sent, triples)`` from the gold side."""
    parsed = gold_parsed(spark, sf_dir) if parsed is None else parsed
    sent = F.concat(F.lit("sentence "), F.col("doc_id").cast("string")) if sent is None else sent
    return parsed.select(F.col("doc_id").cast("int").alias("sidx"), sent.alias("sent"), "triples")


@query("src_annotated")
def q_src_annotated(spark, sf_dir):
    path = scratch_path(spark, "annotated")
    C.write_annotated(annotated_corpus(spark, sf_dir), path)
    back = C.read_annotated(spark, path)
    return _flat_tuples(back.withColumn("sidx", F.col("sidx").cast("bigint")), ["sidx", "sent"])


@query("src_gold_tsv")
def q_src_gold_tsv(spark, sf_dir):
    """Records over several files, read back with their place in file order."""
    path = scratch_path(spark, "gold-tsv")
    C.write_gold_tsv(gold_records(spark, sf_dir), path, order_by=["line_no"])
    back = C.read_gold_tsv(spark, path, drop_empty=True)
    return back.select("sent", "pred", F.array_join("args", " | ").alias("args"),
                       F.size("args").cast("bigint").alias("n_args"), "line_no")


@query("src_sentences")
def q_src_sentences(spark, sf_dir):
    path = scratch_path(spark, "sentences")
    C.write_sentences(sentences(spark, sf_dir), path)
    back = C.read_sentences(spark, path)
    return back.select("articleId", F.col("lineId").cast("bigint").alias("lineId"), "s")


@query("src_documents")
def q_src_documents(spark, sf_dir):
    d = read_documents(spark, _os.path.join(sf_dir, "documents.parquet"))
    return d.select("id", "url", "title", F.length("text").cast("bigint").alias("n_chars"))


@query("chunk_slice")
def q_chunk_slice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return chunk_slice(docs, ["doc_id"], size=128).select("doc_id", "corpus_idx", "chunk_id")


def predictions(spark, sf_dir):
    """Prediction lines: ident, source text, parsed generated tuples."""
    parsed = _parse(oie_pairs(spark, sf_dir), "pred_str")
    return parsed.select(F.concat(F.col("doc_id").cast("string"), F.lit("_0")).alias("idents"),
                         F.concat(F.lit("sentence "), F.col("doc_id").cast("string")).alias("text"),
                         "gold_str", "triples")


@query("sink_predictions")
def q_sink_predictions(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    C.write_predictions(predictions(spark, sf_dir), path)
    return _flat_tuples(C.read_predictions(spark, path), ["idents", "text"])


@query("sink_labelled")
def q_sink_labelled(spark, sf_dir):
    path = scratch_path(spark, "predictions-labelled")
    C.write_predictions(predictions(spark, sf_dir).withColumnRenamed("gold_str", "labels"), path, labelled=True)
    back = C.read_predictions(spark, path)
    return back.select("labels", F.size("triples").cast("bigint").alias("n_triples"),
                       F.col("idents").isNull().alias("no_idents"))


@query("group_by_sentence")
def q_group_by_sentence(spark, sf_dir):
    g = group_by_sentence(gold_records(spark, sf_dir))
    return g.select("sent", F.col("sidx").cast("bigint").alias("sidx"), F.size("records").cast("bigint").alias("n_records"),
                    F.col("first_pos").cast("bigint").alias("first_pos"),
                    F.array_join(F.transform("records", lambda r: r["pred"]), " | ").alias("preds"))


def stored_annotations(spark, sf_dir):
    """Stored replies for the documents that have a ``labels`` row, each
    stored twice (an older and a newer version); the newer one must win."""
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    older = pred_replies(spark, sf_dir).join(labelled, "doc_id", "left_semi").withColumn("pos", F.lit(0))
    newer = gold_replies(spark, sf_dir).join(labelled, "doc_id", "left_semi").withColumn("pos", F.lit(1))
    both = older.unionByName(newer)
    return both.select(F.concat(F.lit("sentence "), F.col("doc_id").cast("string")).alias("sent"),
                       ((F.col("doc_id") * 2) + F.col("pos")).alias("line_no"), "reply")


def _todo(spark, sf_dir):
    return group_by_sentence(gold_records(spark, sf_dir)).select("sent", "sidx")


@query("resume_reused")
def q_resume_reused(spark, sf_dir):
    reused, _ = resume_split(_todo(spark, sf_dir), stored_annotations(spark, sf_dir))
    return reused.select("sent", F.col("sidx").cast("bigint").alias("sidx"), "reply")


@query("resume_pending")
def q_resume_pending(spark, sf_dir):
    _, pending = resume_split(_todo(spark, sf_dir), stored_annotations(spark, sf_dir))
    return pending.select("sent", F.col("sidx").cast("bigint").alias("sidx"))


@query("resume_union")
def q_resume_union(spark, sf_dir):
    """SET-3: reused replies plus newly made ones (here: the gold replies
    stand in for fresh annotation of the pending sentences)."""
    reused, pending = resume_split(_todo(spark, sf_dir), stored_annotations(spark, sf_dir))
    fresh = gold_replies(spark, sf_dir).select(
        F.concat(F.lit("sentence "), F.col("doc_id").cast("string")).alias("sent"), "reply")
    new = pending.join(fresh, "sent").withColumn("source", F.lit("new"))
    return (reused.withColumn("source", F.lit("reused")).select("sent", "reply", "source")
            .unionByName(new.select("sent", "reply", "source")))


@query("seeded_split")
def q_seeded_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return seeded_split(docs, F.col("doc_id"))


@query("corpus_stats")
def q_corpus_stats(spark, sf_dir):
    """AGG-8 + SPL-2: sentences and tuples per subset of the 1:2 split."""
    parsed = _parse(oie_pairs(spark, sf_dir), "gold_str")
    split = seeded_split(parsed, F.col("doc_id"))
    named = split.withColumn("subset", F.when(F.col("bucket") == 0, F.lit("test1")).otherwise(F.lit("test2")))
    st = corpus_stats(named, "subset")
    return st.select("subset", F.col("n_sentences").cast("bigint").alias("n_sentences"),
                     F.col("n_tuples").cast("bigint").alias("n_tuples"))


@query("usage_totals")
def q_usage_totals(spark, sf_dir):
    """AGG-9: whitespace tokens of every annotation request and reply."""
    parsed = _written_gold(spark, sf_dir)
    prompts = render_annotation_prompt(group_by_sentence(gold_records(spark, sf_dir, parsed)))
    replies = gold_replies(spark, sf_dir, parsed).select(F.concat(F.lit("sentence "), F.col("doc_id").cast("string")).alias("sent"), "reply")
    both = prompts.join(replies, "sent").select(F.concat_ws("\n", "prompt", "reply").alias("t"))
    u = usage_totals(both.select(words(F.col("t")).alias("tok")), "tok")
    return u.select(F.col("total_tokens").cast("bigint").alias("total_tokens"), F.col("n_requests").cast("bigint").alias("n_requests"))


# ---------------------------------------------------------------------------
# M5: supervised-example building, numbering and batching
# ---------------------------------------------------------------------------
from tuplespark.operators.examples import (batch_longest, build_examples, build_inference_examples, build_vocab,  # noqa: E402
                                           checksum, count_value, encode, pad_batch)
from tuplespark.operators.indexing import length_buckets, with_batch, with_index  # noqa: E402
from tuplespark.operators.prompts import render_messages  # noqa: E402

MAX_LENGTH = K.DEFAULT_MAX_LENGTH


def example_texts(spark, sf_dir):
    """Per document: the rendered chat prompt (document text as the sentence)
    and the target text of its gold tuples, as whitespace tokens."""
    parsed = _parse(oie_pairs(spark, sf_dir), "gold_str")
    # The same exchange as in the fixture: the texts move once for both.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    j = parsed.join(docs, "doc_id")
    msgs = build_messages(j, "text", shots="none")
    return msgs.select("doc_id", words(render_messages(F.col("messages"))).alias("prompt_tok"),
                       words(render_target(F.col("triples"))).alias("target_tok"))


def _vocab_input(ex):
    return ex.select(F.concat("prompt_tok", "target_tok").alias("tok"))


def encoded_examples(spark, sf_dir, min_count=1, max_length=MAX_LENGTH, texts=None):
    ex = materialize(example_texts(spark, sf_dir)) if texts is None else texts
    vocab = build_vocab(_vocab_input(ex), "tok", min_count=min_count)
    return encode(ex, ["doc_id"], ["prompt_tok", "target_tok"], vocab, ["prompt_ids", "target_ids"], max_length=max_length)


@query("build_vocab")
def q_build_vocab(spark, sf_dir):
    ex = example_texts(spark, sf_dir)
    return build_vocab(_vocab_input(ex), "tok", min_count=1)


@query("encode_tokens")
def q_encode_tokens(spark, sf_dir):
    enc = encoded_examples(spark, sf_dir, min_count=2, max_length=None)
    return enc.select("doc_id", F.size("prompt_ids").cast("bigint").alias("n_ids"),
                      count_value(F.col("prompt_ids"), K.UNK_ID).cast("bigint").alias("n_unk"),
                      checksum(F.col("prompt_ids")).alias("id_check"),
                      checksum(F.col("target_ids")).alias("target_check"))


def _examples(spark, sf_dir):
    return build_examples(encoded_examples(spark, sf_dir), "prompt_ids", "target_ids", MAX_LENGTH)


@query("build_examples")
def q_build_examples(spark, sf_dir):
    ex = _examples(spark, sf_dir)
    return ex.select("doc_id", F.col("length").cast("bigint").alias("length"),
                     count_value(F.col("labels"), K.IGNORE_INDEX).cast("bigint").alias("n_ignored"),
                     checksum(F.col("input_ids")).alias("ids_check"), checksum(F.col("labels")).alias("labels_check"))


@query("build_inference_examples")
def q_build_inference_examples(spark, sf_dir):
    ex = build_inference_examples(encoded_examples(spark, sf_dir), "prompt_ids", MAX_LENGTH)
    return ex.select("doc_id", F.col("length").cast("bigint").alias("length"), checksum(F.col("input_ids")).alias("ids_check"))


def _padded(spark, sf_dir, method):
    # Numbers and batches are made of lengths alone; the ids meet them once, and examples are built after that.
    texts = materialize(example_texts(spark, sf_dir))
    coded = materialize(encoded_examples(spark, sf_dir, texts=texts).withColumn("__row", F.monotonically_increasing_id()))
    release(texts)
    made = build_examples(coded, "prompt_ids", "target_ids", MAX_LENGTH)
    places = batch_longest(with_batch(with_index(made.select("doc_id", "__row", "length"), ["doc_id"]), 8))
    ex = build_examples(coded.join(places.select("__row", "batch_id", "longest"), "__row"), "prompt_ids", "target_ids", MAX_LENGTH)
    p = pad_batch(ex, method, longest="longest")
    return p.select("doc_id", "batch_id", F.size("input_ids").cast("bigint").alias("padded_len"),
                    F.col("n_pad").cast("bigint").alias("n_pad"),
                    checksum(F.col("input_ids")).alias("ids_check"), checksum(F.col("labels")).alias("labels_check"))


@query("pad_batch_bos")
def q_pad_bos(spark, sf_dir):
    return _padded(spark, sf_dir, "bos")


@query("pad_batch_ign")
def q_pad_ign(spark, sf_dir):
    return _padded(spark, sf_dir, "ign")


@query("pad_batch_pad")
def q_pad_pad(spark, sf_dir):
    return _padded(spark, sf_dir, "pad")


@query("length_buckets")
def q_length_buckets(spark, sf_dir):
    ex = with_index(materialize(_examples(spark, sf_dir).select("doc_id", "length")), ["doc_id"])
    return length_buckets(ex, size=8, mega=4).select("doc_id", F.col("length").cast("bigint").alias("length"), "batch_id")


@query("row_index")
def q_row_index(spark, sf_dir):
    s = sentences(spark, sf_dir).select("doc_id", "lineId")
    return with_index(s, ["doc_id", "lineId"]).select("doc_id", F.col("lineId").cast("bigint").alias("lineId"), "idx")


@query("batch_assign")
def q_batch_assign(spark, sf_dir):
    s = with_index(sentences(spark, sf_dir).select("doc_id", "lineId"), ["doc_id", "lineId"])
    return with_batch(s, 1000).select("doc_id", F.col("lineId").cast("bigint").alias("lineId"), "batch_id")


# ---------------------------------------------------------------------------
# M6: plug-ins, stored outputs, class metrics, SQL functions
# ---------------------------------------------------------------------------
from tuplespark.functions.sql import register_sql_functions  # noqa: E402
from tuplespark.operators.generate import first_words_generator, generate, replay  # noqa: E402
from tuplespark.operators.metrics import classification_metrics  # noqa: E402
from tuplespark.operators.scoring import with_lemmas  # noqa: E402
from tuplespark.plans import predict as P  # noqa: E402


def _docs_in(spark, sf_dir):
    return read_documents(spark, _os.path.join(sf_dir, "documents.parquet"))


@query("generate_batch")
def q_generate_batch(spark, sf_dir):
    """UDF-1 with the stand-in generator over every sentence prompt."""
    g = generate(P.prompts(_docs_in(spark, sf_dir)), "prompt", first_words_generator, out="output", batch=64)
    return g.select("ident", "output", "error")


@query("predict_chain")
def q_predict_chain(spark, sf_dir):
    f = P.predict(_docs_in(spark, sf_dir), first_words_generator)
    return f.select("ident", F.col("factId").cast("bigint").alias("factId"), "text", "subj", "pred", "auxi",
                    "prep1", "obj1", "prep2", "obj2", F.col("n_objs").cast("bigint").alias("n_objs"))


def stored_outputs(spark, sf_dir):
    """Stored generations for the documents that have a ``labels`` row."""
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    return oie_pairs(spark, sf_dir).join(labelled, "doc_id", "left_semi").select("doc_id", F.col("pred_str").alias("output"))


@query("replay_generation")
def q_replay(spark, sf_dir):
    r = replay(oie_pairs(spark, sf_dir).select("doc_id"), stored_outputs(spark, sf_dir), "doc_id")
    return r.select("doc_id", F.col("output").isNotNull().alias("has_output"),
                    F.length("output").cast("bigint").alias("n_chars"))


@query("attach_gold")
def q_attach_gold(spark, sf_dir):
    """JON-2: predicted text joined with its gold text by key."""
    j = stored_outputs(spark, sf_dir).join(oie_pairs(spark, sf_dir).select("doc_id", "gold_str"), "doc_id")
    return j.select("doc_id", F.length("gold_str").cast("bigint").alias("gold_chars"),
                    F.length("output").cast("bigint").alias("pred_chars"))


@query("attach_gold_audit")
def q_attach_gold_audit(spark, sf_dir):
    """JON-2 audit mode: full outer join, every key reported once."""
    outs = table(spark, sf_dir, "labels").select("doc_id").join(
        table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("output")), "doc_id")
    j = oie_pairs(spark, sf_dir).select("doc_id", "gold_str").join(outs, "doc_id", "full_outer")
    return j.select("doc_id", F.col("gold_str").isNotNull().alias("has_gold"), F.col("output").isNotNull().alias("has_pred"))


def lemma_dictionary(spark, sf_dir):
    """A ``(word, lemma)`` table derived from the words of both texts:
    plural-looking words (longer than 3, ending in ``s``) map to the word
    without the ``s``."""
    both = oie_pairs(spark, sf_dir).select(words(F.lower(F.concat_ws(" ", "gold_str", "pred_str"))).alias("w"))
    w = explode_rows(both, [], F.array_distinct("w"), "word").distinct()
    return w.where((F.length("word") > 3) & F.col("word").endswith("s")) \
            .select("word", F.expr("substring(word, 1, length(word) - 1)").alias("lemma"))


@query("lemma_lookup")
def q_lemma_lookup(spark, sf_dir):
    g = gold_tuples(spark, sf_dir).select("doc_id", "tidx", words(F.col("t.subj")).alias("w"))
    lem = with_lemmas(g, {"w": 1}, lemma_dictionary(spark, sf_dir), ["doc_id", "tidx"])
    return lem.select("doc_id", "tidx", F.array_join("w", " ").alias("lemmas"))


@query("classification_metrics")
def q_classification(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("quality").alias("y"), (1 - F.col("toxic")).alias("yhat"))
    m = classification_metrics(lab, "y", "yhat")
    return m.select(*[_r6(F.col(c)).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")],
                    F.col("n_classes").cast("bigint").alias("n_classes"), F.col("n").cast("bigint").alias("n"))


@query("sql_parse_tuples")
def q_sql_parse(spark, sf_dir):
    """UDF-5: the parser as a SQL table function."""
    register_sql_functions(spark)
    pairs = oie_pairs(spark, sf_dir)
    return spark.sql("""
        SELECT p.doc_id, CAST(t.tidx AS BIGINT) AS tidx, t.subj, t.pred, array_join(t.auxi, ' ### ') AS auxi,
               array_join(transform(t.objs, o -> concat(o.prep, ' ### ', o.obj)), ' ,, ') AS objs
        FROM {pairs} p, LATERAL parse_tuples_table(p.pred_str) t""", pairs=pairs)


# ---------------------------------------------------------------------------
# M7: streaming (stream = batch)
# ---------------------------------------------------------------------------
from tuplespark.streaming import incremental as STR  # noqa: E402


@query("stream_facts")
def q_stream_facts(spark, sf_dir):
    """STR-1: generated text lands as several files; the stream parses them
    in micro-batches of one file and appends facts; read back the sink."""
    base = scratch_path(spark, "stream-facts")
    outs = oie_pairs(spark, sf_dir).select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_0")).alias("ident"), F.col("pred_str").alias("output"))
    outs.repartition(4, "ident").write.mode("overwrite").json(base + "/in")
    STR.stream_facts(spark, base + "/in", base + "/out", base + "/ckpt", max_files=1)
    f = spark.read.parquet(base + "/out")
    return f.select("ident", F.col("factId").cast("bigint").alias("factId"), "text", "subj", "pred", "auxi",
                    "prep1", "obj1", "prep2", "obj2", "prep3", "obj3", F.col("n_objs").cast("bigint").alias("n_objs"))


@query("stream_micro_totals")
def q_stream_totals(spark, sf_dir):
    """STR-2: running micro totals over micro-batches; final = batch AGG-5."""
    base = scratch_path(spark, "stream-totals")
    pairs = oie_pairs(spark, sf_dir).withColumn("run_id", F.lit("run-0"))
    # Compressed files are read by one task each: two micro-batches, each with a file for every core.
    files = max(4, 2 * spark.sparkContext.defaultParallelism)
    with dropping_shuffles(spark):
        pairs.repartition(files, "doc_id").write.mode("overwrite").json(base + "/in", compression="gzip")
    STR.stream_totals(spark, base + "/in", base + "/out", base + "/ckpt", max_files=files // 2)
    t = STR.read_totals(spark, base + "/out")
    p = F.try_divide(F.col("prec_num"), F.col("prec_den").cast("double"))
    r = F.try_divide(F.col("rec_num"), F.col("rec_den").cast("double"))
    return t.select("run_id", F.col("n_sentences").cast("bigint").alias("n_sentences"),
                    _r6(p).alias("micro_prec"), _r6(r).alias("micro_rec"),
                    _r6(F.try_divide(1.25 * p * r, 0.25 * p + r)).alias("micro_f_beta"))


# ---------------------------------------------------------------------------
# M8: lemmas in scoring, chunked runs, failing generators, few-shot prompts, further sinks
# ---------------------------------------------------------------------------
from tuplespark.operators.corpus import subset  # noqa: E402
from tuplespark.operators.generate import pandas_lemmatizer, pandas_splitter, pandas_tokenizer  # noqa: E402
from tuplespark.operators.sentences import write_chunks  # noqa: E402


def without_s(word: str) -> str:
    """A lemma rule for tests: the last ``s`` of longer words goes."""
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


def _scores_only(spark, sf_dir, cfg):
    s = _sents(spark, sf_dir)
    ss = sentence_scores(s, materialize(pair_scores_of(s, cfg=cfg)), beta=BETA)
    return ss.select("doc_id", *[_r6(F.col(c)).alias(c) for c in ("prec", "rec", "f_score")])


from tuplespark.plans.evaluate import pair_scores as pair_scores_of  # noqa: E402


@query("evaluate_lemmas")
def q_evaluate_lemmas(spark, sf_dir):
    """JON-4 in scoring: words compared by their lemmas from a table."""
    return _scores_only(spark, sf_dir, EvalConfig(lemmas=lemma_dictionary(spark, sf_dir)))


@query("evaluate_lemmatizer")
def q_evaluate_lemmatizer(spark, sf_dir):
    """UDF-3 in scoring: a plug-in asked once per distinct word."""
    return _scores_only(spark, sf_dir, EvalConfig(lemmatizer=pandas_lemmatizer(without_s)))


@query("evaluate_tokenizer")
def q_evaluate_tokenizer(spark, sf_dir):
    """UDF-2 in the distances: a plug-in tokenizer over the parts of tuples."""
    d = sentence_distances(_sents(spark, sf_dir), tokenizer=pandas_tokenizer(str.split))
    return distance_histogram(d)


@query("split_plugin")
def q_split_plugin(spark, sf_dir):
    """UDF-4: sentences from a plug-in splitter (here: lines)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), "text")
    return split_sentences(docs, splitter=pandas_splitter(lambda t: t.split("\n"))).select(
        "doc_id", F.col("lineId").cast("bigint").alias("lineId"), "s")


@query("predict_chunk")
def q_predict_chunk(spark, sf_dir):
    """SRC-5 + SNK-5: the corpus in chunks of 128 documents, run in two ranges
    of chunks; the facts are read back from their chunk folders."""
    base = scratch_path(spark, "chunks")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    write_chunks(docs, base + "/corpus", ["id"], size=128)
    P.predict_chunks(spark, base + "/corpus", base + "/facts", first_words_generator, last=0)
    P.predict_chunks(spark, base + "/corpus", base + "/facts", first_words_generator, first=1)
    f = spark.read.parquet(base + "/facts")
    return f.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "ident", F.col("factId").cast("bigint").alias("factId"), "text")


def failing_generator():
    """The stand-in generator, but a batch with a long or short sentence fails."""
    fn = first_words_generator()

    def run(prompts):
        sizes = [len(p.split(K.USER_PREFIX)[-1].split("\n")[0].split()) for p in prompts]
        if max(sizes) > 20:
            raise ValueError("sentence too long")
        return fn(prompts)
    return run


@query("generate_errors")
def q_generate_errors(spark, sf_dir):
    """UDF-1 with a generator that fails on some sentences: each distinct
    prompt is asked once, and only the failing rows carry an error."""
    g = generate(P.prompts(_docs_in(spark, sf_dir)), "prompt", failing_generator, out="output", batch=64, tries=1,
                 pause=0.0, distinct=True)
    return g.select("ident", "output", "error")


def _shots(spark, sf_dir, shots):
    msgs = build_messages(sentences(spark, sf_dir), "s", shots=shots)
    return msgs.select("doc_id", F.col("lineId").cast("bigint").alias("lineId"), F.size("messages").cast("bigint").alias("n_messages"),
                       F.md5(render_messages(F.col("messages"))).alias("prompt_check"))


@query("build_messages_train")
def q_build_messages_train(spark, sf_dir):
    return _shots(spark, sf_dir, "train")


@query("build_messages_test")
def q_build_messages_test(spark, sf_dir):
    return _shots(spark, sf_dir, "test")


@query("sink_template")
def q_sink_template(spark, sf_dir):
    """SNK-3: annotation templates written and read back as JSON."""
    path = scratch_path(spark, "template")
    C.write_template(to_template(gold_records(spark, sf_dir)), path)
    pair = "ARRAY<STRING>"
    back = spark.read.schema(f"sent STRING, pred STRING, subj STRING, obj0 {pair}, obj1 {pair}, obj2 {pair}, auxilliary STRING").json(path)
    return back.select("sent", "pred", "subj", *[F.col(f"obj{i}")[k].alias(f"obj{i}_{n}") for i in range(3) for k, n in enumerate(("prep", "obj"))],
                       "auxilliary")


@query("sink_facts")
def q_sink_facts(spark, sf_dir):
    """SNK-5 / SPL-2: the fact table partitioned by subset, read subset by subset."""
    path = scratch_path(spark, "facts")
    named = seeded_split(facts(spark, sf_dir), F.col("articleId")).withColumn(
        "subset", F.when(F.col("bucket") == 0, F.lit("test1")).otherwise(F.lit("test2"))).drop("bucket")
    C.write_facts(named, path, partition_by=["subset"])
    back = spark.read.parquet(path)
    return subset(back, "test1").unionByName(subset(back, "test2")).select("subset", "articleId", "factId", "text", "subj", "obj1", "n_objs")


@query("sink_ordered")
def q_sink_ordered(spark, sf_dir):
    """ORD-1: predictions written in request order; their place in the files."""
    path = scratch_path(spark, "ordered")
    C.write_predictions(predictions(spark, sf_dir).withColumn("idx", F.expr("CAST(split(idents, '_')[0] AS BIGINT)")), path, order_by=["idx"])
    lines = C.read_lines(spark, path)
    return lines.select("line_no", F.get_json_object("value", "$.idents").alias("idents"))


# ---------------------------------------------------------------------------
# M7: whole runs over corpus files
# ---------------------------------------------------------------------------
from tuplespark.plans.chains import annotate_corpus, echo_annotator, evaluate_corpus, training_examples  # noqa: E402


def _written_gold(spark, sf_dir, *more):
    """The gold parse and the columns ``more`` of the fixture, written once."""
    return materialize(gold_parsed(spark, sf_dir).select("doc_id", "triples", *more))


def _annotated_runs(spark, sf_dir):
    """Gold records as a TSV file, a store that holds the ``labels`` documents
    twice (parsed output first, gold last: the last one wins), and a run over both."""
    base = scratch_path(spark, "annotate")
    # Ordered files read their input twice (range bounds, then rows): the parse is written before.
    parsed = _written_gold(spark, sf_dir, "pred_str")
    C.write_gold_tsv(gold_records(spark, sf_dir, parsed), base + "/gold", order_by=["line_no"], compression="gzip")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sidx")).distinct()
    older = _parse(parsed.select("doc_id", "pred_str"), "pred_str").select(F.col("doc_id").cast("int").alias("sidx"), F.concat(F.lit("sentence "), F.col("doc_id").cast("string")).alias("sent"),
                                              "triples", F.lit(0).alias("pos"))
    both = materialize(older.unionByName(annotated_corpus(spark, sf_dir, parsed).withColumn("pos", F.lit(1))).join(labelled, "sidx", "left_semi"))
    release(parsed)
    C.write_annotated(both, base + "/store", order_by=["pos", "sidx"], compression="gzip")
    release(both)
    run = annotate_corpus(spark, base + "/gold", base + "/out", echo_annotator, store=base + "/store", pause=0.0,
                          compression="gzip")
    return run, C.read_annotated(spark, base + "/out", line_no=True)


@query("annotate_chain")
def q_annotate_chain(spark, sf_dir):
    """TSV -> group -> resume -> request -> reply -> parse -> file, read back."""
    _, back = _annotated_runs(spark, sf_dir)
    return _flat_tuples(back.withColumn("sidx", F.col("sidx").cast("bigint")), ["line_no", "sidx", "sent"])


@query("annotate_audit")
def q_annotate_audit(spark, sf_dir):
    """Violations of the run by rule, and its requests and tokens as rows."""
    run, _ = _annotated_runs(spark, sf_dir)
    rules = run.violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    spent = run.usage.select(F.expr("stack(2, 'requests', n_requests, 'tokens', total_tokens) AS (rule, n)"))
    return rules.unionByName(spent).select("rule", F.col("n").cast("bigint").alias("n"))


@query("evaluate_corpus")
def q_evaluate_corpus(spark, sf_dir):
    """An annotated file evaluated against stored outputs; predictions written."""
    base = scratch_path(spark, "evaluate")
    parsed = _written_gold(spark, sf_dir, "pred_str")
    C.write_annotated(annotated_corpus(spark, sf_dir, parsed), base + "/gold", order_by=["sidx"], compression="gzip")
    outputs = parsed.select(F.concat(F.lit("sentence "), F.col("doc_id").cast("string")).alias("sent"),
                                              F.col("pred_str").alias("output"))
    ev = evaluate_corpus(spark, base + "/gold", base + "/preds", outputs=outputs, cfg=EvalConfig(beta=0.5), compression="gzip")
    kept = C.read_lines(spark, base + "/preds").select("line_no", F.expr("size(from_json(value, 'triples ARRAY<STRING>').triples)").alias("n"))
    return ev.join(kept, "line_no").select(
        "line_no", F.col("sidx").cast("bigint").alias("sidx"), *[_r6(F.col(c)).alias(c) for c in ("prec", "rec", "f_score")],
        F.array_join(F.transform("levenshtein_dists", lambda x: x.cast("string")), ",").alias("dists"), F.col("n").cast("bigint").alias("n_triples"))


@query("training_chain")
def q_training_chain(spark, sf_dir):
    """An annotated file turned into padded batches of similar length, as Parquet."""
    base = scratch_path(spark, "training")
    # The same exchange as in the fixture: the texts move once for both, and are written with the parse.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    parsed = materialize(gold_parsed(spark, sf_dir).select("doc_id", "triples").join(docs, "doc_id"))
    C.write_annotated(annotated_corpus(spark, sf_dir, parsed, sent=F.col("text")), base + "/gold", order_by=["sidx"], compression="gzip")
    release(parsed)
    ex = training_examples(spark, base + "/gold", base, size=8, mega=4)
    return ex.select("line_no", "batch_id", F.col("length").cast("bigint").alias("length"), F.col("n_pad").cast("bigint").alias("n_pad"),
                     checksum(F.col("input_ids")).alias("ids_check"), checksum(F.col("labels")).alias("labels_check"))
