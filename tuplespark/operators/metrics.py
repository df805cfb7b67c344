"""Corpus-level metrics (AGG-4..10). All are global or low-cardinality
aggregations with partial (map-side) aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespark.operators.scoring import f_beta
from tuplespark.session import materialize


def macro_metrics(scores: DataFrame, beta: float = 1.0) -> DataFrame:
    """AGG-4 / E3: F of the mean precision and mean recall (not the mean F)."""
    agg = scores.agg(F.avg("prec").alias("macro_prec"), F.avg("rec").alias("macro_rec"),
                     F.count(F.lit(1)).alias("n_sentences"))
    p, r = F.col("macro_prec"), F.col("macro_rec")
    b2 = beta * beta
    return agg.select("n_sentences", "macro_prec", "macro_rec",
                      F.try_divide((1 + b2) * p * r, b2 * p + r).alias("macro_f_beta"),
                      F.try_divide(2 * p * r, p + r).alias("macro_f1"), F.lit(float(beta)).alias("beta"))


def micro_metrics(scores: DataFrame, beta: float = 1.0) -> DataFrame:
    """AGG-5: ratios of sums; NULL instead of a division error (E4)."""
    agg = scores.agg(F.sum("prec_num").alias("__pn"), F.sum("prec_den").alias("__pd"),
                     F.sum("rec_num").alias("__rn"), F.sum("rec_den").alias("__rd"))
    p = F.try_divide(F.col("__pn"), F.col("__pd").cast("double"))
    r = F.try_divide(F.col("__rn"), F.col("__rd").cast("double"))
    b2 = beta * beta
    out = agg.select(p.alias("micro_prec"), r.alias("micro_rec"))
    mp, mr = F.col("micro_prec"), F.col("micro_rec")
    return out.select("micro_prec", "micro_rec",
                      F.try_divide((1 + b2) * mp * mr, b2 * mp + mr).alias("micro_f_beta"),
                      F.try_divide(2 * mp * mr, mp + mr).alias("micro_f1"), F.lit(float(beta)).alias("beta"))


def distance_histogram(dists: DataFrame, col: str = "levenshtein_dists") -> DataFrame:
    """AGG-6: count per distance and its share ``"%.2f%%"`` of all matches,
    by distance. The counts, one row per distance, are written once: the total and
    the order read them, not the distances."""
    # explode_outer + filter: a plain explode makes Catalyst add size(..) > 0
    # below the generator, which would evaluate the distance expression again.
    d = dists.select(F.explode_outer(col).alias("distance")).where(F.col("distance").isNotNull())
    counts = materialize(d.groupBy("distance").agg(F.count(F.lit(1)).alias("n"))).withColumn("__k", F.lit(1))
    total = counts.agg(F.sum("n").alias("__total")).withColumn("__k", F.lit(1))
    return (counts.join(F.broadcast(total), "__k")
                  .select(F.col("distance").cast("bigint").alias("distance"), F.col("n").cast("bigint").alias("n"),
                          F.format_string("%.2f%%", F.round(100.0 * F.col("n") / F.col("__total"), 10)).alias("share"))
                  .orderBy("distance"))


def mean_distance(dists: DataFrame, col: str = "levenshtein_dists") -> DataFrame:
    """AGG-7: mean over all matches (sum / count)."""
    d = dists.select(F.explode_outer(col).alias("d")).where(F.col("d").isNotNull())
    return d.agg(F.try_divide(F.sum("d").cast("double"), F.count("d").cast("double")).alias("mean_distance"),
                 F.count("d").alias("n_matches"))


def classification_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """AGG-10: accuracy and macro precision / recall / F1 over the classes
    (classes = labels seen in truth or prediction; a class never predicted
    has precision 0, as in the common 'zero division = 0' convention)."""
    conf = df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))
    total = conf.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n"))).alias("hits"))
    tp = conf.where(F.col("y") == F.col("yhat")).select(F.col("y").alias("c"), F.col("n").alias("tp"))
    pred_n = conf.groupBy(F.col("yhat").alias("c")).agg(F.sum("n").alias("pn"))
    true_n = conf.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("tn"))
    classes = pred_n.select("c").union(true_n.select("c")).distinct()
    per = (classes.join(tp, "c", "left").join(pred_n, "c", "left").join(true_n, "c", "left")
                  .fillna(0, ["tp", "pn", "tn"])
                  .withColumn("p", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pn").cast("double")), F.lit(0.0)))
                  .withColumn("r", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tn").cast("double")), F.lit(0.0)))
                  .withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)))
    macro = per.agg(F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"),
                    F.count(F.lit(1)).alias("n_classes"))
    one = F.lit(1).alias("__k")
    return total.select("*", one).join(macro.select("*", one), "__k").select(
        (F.col("hits") / F.col("total")).alias("accuracy"), "macro_precision", "macro_recall", "macro_f1",
        "n_classes", F.col("total").alias("n"))


def corpus_stats(df: DataFrame, subset: str, triples: str = "triples") -> DataFrame:
    """AGG-8: sentences and tuples per subset."""
    return df.groupBy(subset).agg(F.count(F.lit(1)).alias("n_sentences"),
                                  F.sum(F.size(triples)).alias("n_tuples"))


def usage_totals(df: DataFrame, tokens: str) -> DataFrame:
    """AGG-9: total token use of a run."""
    return df.agg(F.sum(F.size(tokens)).alias("total_tokens"), F.count(F.lit(1)).alias("n_requests"))


__all__ = ["macro_metrics", "micro_metrics", "distance_histogram", "mean_distance", "classification_metrics",
           "corpus_stats", "usage_totals", "f_beta"]
