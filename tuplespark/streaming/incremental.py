"""Incremental work with Structured Streaming.

STR-1 ``stream_facts``: a file stream of generated text (JSON lines
``{ident, output}``) is parsed into tuples and appended to a fact table. The
job is stateless; its checkpoint records which files were done, so a restart
continues where it stopped, and ``Trigger.AvailableNow`` processes what is
there in bounded micro-batches (``maxFilesPerTrigger``) and stops.

STR-2 ``stream_totals``: sentences that already carry both texts arrive as
files; each micro-batch is scored like a batch run (``plans.evaluate``, with
lemmas and weights) and its sums are added to the totals of the epoch before.
Every epoch writes a table of its own and then a commit record: a crash between
the two leaves the earlier totals in force, and the batch, which Spark repeats
under the same epoch, writes its table again. A batch repeated after its commit
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuplespark.functions.parse import parse_tuples
from tuplespark.operators.facts import explode_facts, widen_objects
from tuplespark.operators.scoring import sentence_scores
from tuplespark.plans.evaluate import EvalConfig, pair_scores, parse_sentences
from tuplespark.session import materialize, release

OUTPUT_SCHEMA = T.StructType([T.StructField("ident", T.StringType()), T.StructField("output", T.StringType())])
PAIR_SCHEMA = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("doc_id", T.LongType()),
                            T.StructField("gold_str", T.StringType()), T.StructField("pred_str", T.StringType())])


FILES_A_BATCH = 1000


def facts_stream(spark: SparkSession, in_path: str, max_files: int = FILES_A_BATCH) -> DataFrame:
    """Streaming DataFrame of published facts from generated-text files."""
    src = (spark.readStream.schema(OUTPUT_SCHEMA).option("maxFilesPerTrigger", max_files).json(in_path))
    parsed = parse_tuples(src, "output")
    return widen_objects(explode_facts(parsed.drop("output")))


def stream_facts(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, max_files: int = FILES_A_BATCH) -> None:
    """STR-1: run the fact stream over every available file, then stop."""
    q = (facts_stream(spark, in_path, max_files).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint).option("path", out_path)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


TOTALS = ["n_sentences", "prec_num", "prec_den", "rec_num", "rec_den"]
_TOTALS_DDL = "run_id string, n_sentences long, prec_num double, prec_den long, rec_num double, rec_den long"


def batch_totals(batch: DataFrame, cfg: EvalConfig | None = None) -> DataFrame:
    """``run_id`` and sums over the sentences ``run_id, gold_str, pred_str`` of
    a micro-batch; every row is a sentence of its own."""
    cfg = cfg or EvalConfig()
    # The key is drawn where the parsed sentences are written; the texts are not written again.
    rows = batch.select("gold_str", "pred_str", F.struct(F.expr("uuid()").alias("k"), "run_id").alias("__row"))
    sents = materialize(parse_sentences(rows, "__row").select(F.col("__row.k").alias("__key"), F.col("__row.run_id").alias("run_id"), "gold", "pred"))
    scores = materialize(pair_scores(sents, "__key", cfg))
    scored = sentence_scores(sents, scores, "__key", beta=cfg.beta, fold_cells=cfg.fold_cells)
    totals = materialize(sents.select("__key", "run_id").join(scored, "__key").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), *[F.sum(c).alias(c) for c in TOTALS[1:]]))
    # The sums, one row a run, are all that a batch leaves.
    release(sents)
    release(scores)
    return totals


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs with a complete folder under ``path`` (one small entry a batch)."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[6:]) for n in names if n.startswith("epoch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def read_totals(spark: SparkSession, out_path: str) -> DataFrame:
    """The totals of the last committed epoch."""
    done = _epochs(spark, f"{out_path}/commits")
    if not done:
        return spark.createDataFrame([], _TOTALS_DDL)
    return spark.read.schema(_TOTALS_DDL).parquet(f"{out_path}/totals/epoch={done[-1]}")


def commit_totals(batch: DataFrame, epoch: int, out_path: str, cfg: EvalConfig | None = None) -> None:
    """Adds a micro-batch to the totals, once per epoch."""
    spark = batch.sparkSession
    if epoch in _epochs(spark, f"{out_path}/commits"):
        return
    both = read_totals(spark, out_path).unionByName(batch_totals(batch, cfg))
    both.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in TOTALS]).write.mode("overwrite").parquet(f"{out_path}/totals/epoch={epoch}")
    spark.range(1).write.mode("overwrite").parquet(f"{out_path}/commits/epoch={epoch}")


def stream_totals(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, max_files: int = FILES_A_BATCH,
                  cfg: EvalConfig | None = None) -> None:
    """STR-2: keep the totals at ``out_path`` current, batch by batch;
    ``cfg`` carries lemmas, weights and the truncation mode."""
    src = spark.readStream.schema(PAIR_SCHEMA).option("maxFilesPerTrigger", max_files).json(in_path)
    q = (src.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, epoch: commit_totals(batch, epoch, out_path, cfg))
         .trigger(availableNow=True).start())
    q.awaitTermination()
