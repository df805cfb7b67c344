"""Sinks (SNK-3, SNK-5, ORD-1) and plug-in hooks (UDF-1..4, JON-4/9)."""

import glob
import json
import os

from pyspark.sql import functions as F

from tests.conftest import texts_df
from tests.reference_loops import sentence as loop_sentence
from tuplespark.operators.corpus import to_template
from tuplespark.operators.generate import (first_words_generator, generate, pandas_lemmatizer, pandas_splitter,
                                           pandas_tokenizer, replay)
from tuplespark.operators.distance import sentence_distances
from tuplespark.operators.sentences import read_chunks, split_sentences, write_chunks
from tuplespark.operators.indexing import with_index
from tuplespark.plans.evaluate import EvalConfig, evaluate, parse_sentences
from tuplespark.plans.predict import predict_chunks
from tuplespark.plans.queries import QUERIES
from tuplespark.session import scratch_path
from tuplespark.sources import corpus as C


def test_snk3_template_file_shape(spark):
    df = spark.createDataFrame([("s", "p", ["a0", "a1"])], "sent string, pred string, args array<string>")
    path = scratch_path(spark, "test-template")
    C.write_template(to_template(df), path)
    line = json.loads(spark.read.text(path).first().value)
    assert line["subj"] == "a0" and line["obj0"] == ["", "a1"] and line["obj2"] == ["", ""] and line["auxilliary"] == ""


def test_snk5_facts_partitioned_and_pruned(spark):
    df = spark.createDataFrame([(c, f"a{c}", 0) for c in range(3) for _ in range(2)], "chunk_id int, articleId string, lineId int")
    path = scratch_path(spark, "test-facts")
    C.write_facts(df, path, partition_by=["chunk_id"])
    back = spark.read.parquet(path).where(F.col("chunk_id") == 1)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 2 and "PartitionFilters: [isnotnull(chunk_id" in plan


def test_ord1_request_order_restored(spark):
    rows = [(i, f"{i}_0", "t", []) for i in range(50)]
    df = spark.createDataFrame(rows, "idx int, idents string, text string, triples array<struct<subj:string,pred:string,"
                                     "auxi:array<string>,objs:array<struct<prep:string,obj:string>>>>").repartition(7)
    path = scratch_path(spark, "test-order")
    C.write_predictions(df, path, order_by=["idx"])
    local = path[len("file:"):] if path.startswith("file:") else path
    got = [json.loads(line)["idents"] for f in sorted(glob.glob(os.path.join(local, "part-*"))) for line in open(f)]
    assert got == [f"{i}_0" for i in range(50)]


def test_generator_hook_batches_retries_and_errors(spark):
    calls = {"n": 0}

    def make():
        def fn(prompts):
            calls["n"] += 1
            if len(prompts) > 2:
                raise MemoryError
            return ["" if p == "short" else p.upper() + " ok" for p in prompts]
        return fn
    df = spark.createDataFrame([("a",), ("short",), ("c",), ("d",)], "prompt string").coalesce(1)
    out = {r.prompt: (r.output, r.error) for r in generate(df, "prompt", make, batch=4, pause=0.0, min_chars=2).collect()}
    assert out["a"] == ("A ok", None) and out["short"][1] == "reply too short"


def test_replay_keeps_misses(spark):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    outs = spark.createDataFrame([(1, "x")], "k long, output string")
    assert {r.k: r.output for r in replay(df, outs, "k").collect()} == {1: "x", 2: None}


def test_plugin_tokenizer_matches_default(spark):
    rows = [(1, "a b ,, c ,, d e ,, f", "a b ,, c ,, f ,, d e\n2. x ,, c")]
    s = parse_sentences(texts_df(spark, rows))
    default = sentence_distances(s).first().levenshtein_dists
    plugged = sentence_distances(s, tokenizer=pandas_tokenizer(str.split)).first().levenshtein_dists
    assert list(default) == list(plugged) == loop_sentence(rows[0][1], rows[0][2], "pairwise")["dists"]


def test_plugin_splitter(spark):
    df = spark.createDataFrame([("d1", "One two. Three four")], "articleId string, text string")
    got = [r.s for r in split_sentences(df, splitter=pandas_splitter(lambda t: t.split(". "))).orderBy("lineId").collect()]
    assert got == ["One two", "Three four"]


def test_lemmas_change_matching(spark):
    rows = [(1, "dogs ,, runs ,, home", "dog ,, run ,, home")]
    plain = evaluate(texts_df(spark, rows)).first()
    table = spark.createDataFrame([("dogs", "dog"), ("runs", "run"), ("dog", None), (None, "x"), ("dogs", "dog")], "word string, lemma string")
    lem = evaluate(texts_df(spark, rows), cfg=EvalConfig(lemmas=table)).first()
    plug = evaluate(texts_df(spark, rows), cfg=EvalConfig(lemmatizer=pandas_lemmatizer(lambda w: w.rstrip("s")))).first()
    assert plain.prec == 0.0 and lem.prec == 1.0 and plug.prec == 1.0
    df = spark.createDataFrame([(["dogs", "cat"],)], "w array<string>")
    assert list(df.select(pandas_lemmatizer(lambda w: w.rstrip("s"))(F.col("w")).alias("x")).first().x) == ["dog", "cat"]


def test_stand_in_generator_reply(spark):
    fn = first_words_generator()
    assert fn(["...Extract a list of open relation triples from the following sentence: A b c d\n<|assistant|>"]) == ["A ,, b ,, c d"]


def test_line_numbers_follow_files_and_split_files(spark, tmp_path):
    sizes = [400, 3, 0, 77]
    for k, n in enumerate(sizes):
        (tmp_path / f"part-{k}.tsv").write_text("".join(f"s{k}-{i}\tp\ta\n" for i in range(n)))
    want = [f"s{k}-{i}" for k, n in enumerate(sizes) for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        df = C.read_gold_tsv(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > len(sizes)
        assert [r.sent for r in sorted(df.collect(), key=lambda r: r.line_no)] == want
        assert sorted(r.line_no for r in df.collect()) == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_chunks_are_pruned_and_rerun_alone(spark):
    base = scratch_path(spark, "test-chunks")
    docs = spark.range(25).selectExpr("id", "concat('One two three four ', id, '.') AS text")
    write_chunks(docs, base + "/c", ["id"], size=10)
    plan = read_chunks(spark, base + "/c", 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk_id" in plan and read_chunks(spark, base + "/c", 1, 1).count() == 10
    predict_chunks(spark, base + "/c", base + "/f", first_words_generator, last=1)
    predict_chunks(spark, base + "/c", base + "/f", first_words_generator, first=2)
    predict_chunks(spark, base + "/c", base + "/f", first_words_generator, first=2)
    facts = spark.read.parquet(base + "/f")
    assert {r.chunk_id: r["count"] for r in facts.groupBy("chunk_id").count().collect()} == {0: 10, 1: 10, 2: 5}


def test_index_moves_keys_only_and_numbers_repeats(spark):
    df = spark.createDataFrame([(i % 7 if i % 7 else None, "payload" * 3) for i in range(50)], "k long, payload string")
    got = [(r.idx, r.k) for r in with_index(df, ["k"]).collect()]
    order = sorted(((r.k is not None, r.k or 0) for r in df.collect()))
    assert [(k is not None, k or 0) for _, k in sorted(got, key=lambda x: x[0])] == order and sorted(i for i, _ in got) == list(range(50))
    keys = [(r.idx, r.k) for r in with_index(df.select("k"), ["k"]).collect()]
    assert sorted(i for i, _ in keys) == list(range(50))
    wide = spark.range(30).selectExpr("id", "repeat('x', 50) AS payload")
    assert {r.id: r.idx for r in with_index(wide, ["id"]).collect()} == {i: i for i in range(30)}


def test_blocking_join_moves_no_arrays(spark, sf001):
    plan = QUERIES["candidate_pairs"](spark, sf001)._jdf.queryExecution().optimizedPlan().toString()
    join = [line for line in plan.split("\n") if "Join Inner" in line]
    scan = [line for line in plan.split("\n") if line.strip(" :+-").startswith("Project") and "__pw" in line]
    assert join and scan and not any("tuple" in line.split("[", 1)[1] for line in scan)
