"""Stream = batch, including a restart in the middle (STR-1, STR-2)."""

from pyspark.sql import functions as F

from tuplespark.operators.scoring import sentence_scores
from tuplespark.plans import queries as Q
from tuplespark.plans.evaluate import EvalConfig, pair_scores, parse_sentences
from tuplespark.session import materialize, scratch_path
from tuplespark.sources.fixtures import oie_pairs
from tuplespark.streaming import incremental as STR


def test_stream_facts_restart_equals_batch(spark, sf001):
    base = scratch_path(spark, "test-stream")
    outs = oie_pairs(spark, sf001).select(F.concat(F.col("doc_id").cast("string"), F.lit("_0")).alias("ident"),
                                          F.col("pred_str").alias("output"))
    first, second = outs.where(F.col("ident") < "5"), outs.where(F.col("ident") >= "5")
    first.repartition(2).write.mode("overwrite").json(base + "/in/a")
    STR.stream_facts(spark, base + "/in/*", base + "/out", base + "/ckpt", max_files=1)
    n1 = spark.read.parquet(base + "/out").count()
    second.repartition(2).write.mode("overwrite").json(base + "/in/b")
    STR.stream_facts(spark, base + "/in/*", base + "/out", base + "/ckpt", max_files=1)    # restart: only new files
    got = spark.read.parquet(base + "/out").select("ident", "factId", "text")
    want = Q.facts(spark, sf001).select(F.concat("articleId", F.lit("_0")).alias("ident"), "factId", "text")
    assert 0 < n1 < got.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _pairs(spark, sf001):
    return oie_pairs(spark, sf001).withColumn("run_id", F.concat(F.lit("r"), (F.col("doc_id") % 2).cast("string")))


def _want(spark, sf001, cfg=None):
    s = materialize(parse_sentences(_pairs(spark, sf001)))
    scored = sentence_scores(s, materialize(pair_scores(s, cfg=cfg)))
    return {r.run_id: r for r in scored.withColumn("run_id", F.concat(F.lit("r"), (F.col("doc_id") % 2).cast("string"))).groupBy("run_id").agg(
        F.count("*").alias("n_sentences"), *[F.sum(c).alias(c) for c in STR.TOTALS[1:]]).collect()}


def _same(got, want):
    assert {r.run_id for r in got} == set(want)
    for r in got:
        assert all(abs(r[c] - want[r.run_id][c]) < 1e-9 for c in STR.TOTALS)


def test_stream_totals_with_lemmas_and_weights_equal_the_batch(spark, sf001):
    base = scratch_path(spark, "test-totals")
    lemmas = materialize(Q.lemma_dictionary(spark, sf001))
    cfg = EvalConfig(lemmas=lemmas, weights={"obj": 0.5})
    _pairs(spark, sf001).repartition(2).write.json(base + "/in")
    STR.stream_totals(spark, base + "/in", base + "/out", base + "/ckpt", max_files=1, cfg=cfg)
    _same(STR.read_totals(spark, base + "/out").collect(), _want(spark, sf001, cfg))


def test_totals_survive_a_crash_between_table_and_commit(spark, sf001):
    out = scratch_path(spark, "test-crash")
    halves = [_pairs(spark, sf001).where(F.col("doc_id") % 3 == 0), _pairs(spark, sf001).where(F.col("doc_id") % 3 != 0)]
    STR.commit_totals(halves[0], 0, out)
    first = sorted(map(str, STR.read_totals(spark, out).collect()))
    # The table of epoch 1 was written, its commit was not.
    spark.createDataFrame([("r0", 1, 1.0, 1, 1.0, 1)], STR._TOTALS_DDL).write.parquet(out + "/totals/epoch=1")
    assert sorted(map(str, STR.read_totals(spark, out).collect())) == first
    STR.commit_totals(halves[1], 1, out)      # Spark repeats the batch under its epoch
    STR.commit_totals(halves[1], 1, out)      # and once more after the commit
    _same(STR.read_totals(spark, out).collect(), _want(spark, sf001))
