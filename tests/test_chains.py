"""Whole runs over corpus files: annotation, evaluation, training data."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tuplespark.operators.generate import first_words_generator
from tuplespark.plans.chains import annotate_corpus, echo_annotator, evaluate_corpus, training_examples
from tuplespark.session import scratch_path
from tuplespark.sources import corpus as C

GOLD = ("Ann left town\tleft\tAnn\ttown\n\nBob met Eve\tmet\tBob\tEve\nBob met Eve\tmet in\tBob\tParis\n"
        "Cy ran\tran\tCy\nDi fails\tfails\tDi\n")


def replies():
    """Echo, but an over-short reply for one sentence and an error for another."""
    echo = echo_annotator()

    def fn(prompts):
        if any("Di fails" in p for p in prompts):
            raise ValueError("no reply")
        return ["1. x" if "Cy ran" in p else r for p, r in zip(prompts, echo(prompts))]
    return fn


def test_annotation_run(spark, tmp_path):
    (tmp_path / "gold.tsv").write_text(GOLD)
    stored = [{"sidx": 70, "sent": "Ann left town", "triples": []},
              {"sidx": 71, "sent": "Ann left town", "triples": [{"subj": "Ann", "pred": "left", "objs": [["", "town é"]], "auxi": []}]}]
    (tmp_path / "store.json").write_text("\n".join(json.dumps(s, ensure_ascii=False) for s in stored))
    out = scratch_path(spark, "test-annotated")
    run = annotate_corpus(spark, str(tmp_path / "gold.tsv"), out, replies, store=str(tmp_path / "store.json"), tries=2, pause=0.0)
    back = sorted(C.read_annotated(spark, out, line_no=True).collect(), key=lambda r: r.line_no)
    assert [(r.sidx, r.sent, len(r.triples)) for r in back] == [
        (71, "Ann left town", 1), (1, "Bob met Eve", 2), (2, "Cy ran", 0), (3, "Di fails", 0)]
    assert back[0].triples[0].objs[0].obj == "town é" and back[1].triples[1].pred == " met in"
    assert {(r.sent, r.rule, r.detail) for r in run.violations.collect()} == {
        ("Cy ran", "short_reply", "reply too short"), ("Di fails", "short_reply", "ValueError: no reply")}
    assert {r.sent: r.source for r in run.records.collect()}["Ann left town"] == "stored"
    assert run.usage.first().n_requests == 3


def test_annotation_run_without_store_or_lines(spark, tmp_path):
    (tmp_path / "gold.tsv").write_text("")
    out = scratch_path(spark, "test-annotated")
    annotate_corpus(spark, str(tmp_path / "gold.tsv"), out, echo_annotator, pause=0.0)
    assert C.read_annotated(spark, out).count() == 0


def corpus(spark):
    path = scratch_path(spark, "test-corpus")
    rows = [(0, "Ann left town", [("Ann", "left", [], [("", "town")])]), (1, "Bob met Eve", []), (2, "Ann left town", [])]
    kind = "sidx int, sent string, triples array<struct<subj:string,pred:string,auxi:array<string>,objs:array<struct<prep:string,obj:string>>>>"
    C.write_annotated(spark.createDataFrame(rows, kind), path, order_by=["sidx"])
    return path


def test_evaluation_of_a_corpus_file(spark):
    path, out = corpus(spark), scratch_path(spark, "test-preds")
    got = {r.line_no: r for r in evaluate_corpus(spark, path, out, make_fn=first_words_generator).collect()}
    assert (got[0].prec, got[0].rec, list(got[0].levenshtein_dists)) == (1.0, 1.0, [0])
    assert got[1].prec == 0.0 and got[2].rec == 0.0 and len(got) == 3
    lines = sorted(C.read_lines(spark, out).collect(), key=lambda r: r.line_no)
    assert [json.loads(r.value)["labels"] for r in lines] == ["Ann ,, left ,, town", "", ""]
    stored = spark.createDataFrame([("Bob met Eve", "bob ,, met ,, eve")], "sent string, output string")
    kept = {r.line_no: r.prec_den for r in evaluate_corpus(spark, path, out, outputs=stored).collect()}
    assert kept == {0: 0, 1: 1, 2: 0}


def test_training_examples_are_padded_batches(spark):
    out = scratch_path(spark, "test-training")
    ex = training_examples(spark, corpus(spark), out, shots="train", size=2, mega=1, method="bos")
    rows = {r.line_no: r for r in ex.collect()}
    assert {k: r.batch_id for k, r in rows.items()} == {0: 0, 1: 0, 2: 1}
    assert len(rows[0].input_ids) == len(rows[1].input_ids) == rows[0].length and rows[1].n_pad == rows[0].length - rows[1].length
    assert rows[1].input_ids[:rows[1].n_pad] == [0] * rows[1].n_pad and rows[0].input_ids[-1] == 1
    ids = {r.token: r.id for r in spark.read.parquet(out + "/vocab").collect()}
    assert rows[0].input_ids[-2] == ids["town"] and min(ids.values()) == 4
    assert ex.where(F.size("input_ids") != F.size("labels")).count() == 0


def test_usage_totals_parses_gold_once(spark, sf001):
    from tuplespark.plans import queries as Q
    plan = Q.QUERIES["usage_totals"](spark, sf001)._jdf.queryExecution().optimizedPlan().toString()
    # Before, the fixture was built and parsed for the replies and twice for the numbered sentences.
    assert "regexp_extract_all" not in plan


def test_annotation_reads_written_tuples(spark, sf001, monkeypatch):
    from tuplespark.plans import queries as Q
    plans, write = [], Q.C.write_gold_tsv
    monkeypatch.setattr(Q.C, "write_gold_tsv", lambda df, *a, **k: (
        plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, *a, **k))[1])
    Q._annotated_runs(spark, sf001)
    assert len(plans) == 1 and "regexp_extract_all" not in plans[0]
