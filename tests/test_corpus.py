"""Corpus conversion, resume, split, round trips (U14, JON-3, SPL-1, SRC/SNK)."""

from pyspark.sql import functions as F

from tuplespark.operators.corpus import record_violations, reply_violations, resume_split, seeded_split, to_template
from tuplespark.session import scratch_path
from tuplespark.sources import corpus as C


def test_u14_template_and_violation(spark):
    df = spark.createDataFrame([("s", "p", ["a0", "a1", "a2", "a3", "a4"])], "sent string, pred string, args array<string>")
    t = to_template(df).first()
    assert t.subj == "a0" and (t.obj0.obj, t.obj1.obj, t.obj2.obj) == ("a1", "a2", "a3") and t.auxilliary == ""
    assert record_violations(df, ["sent"]).count() == 1


def test_u12_u13_reply_violations(spark):
    df = spark.createDataFrame([(1, "1. not ### is ;; Ann ;; by ### x ### y\n1a. b ;; c")], "k long, reply string")
    rules = sorted(r.rule for r in reply_violations(df, "reply", ["k"]).collect())
    assert rules == ["item_not_numeric", "obj_pieces"]


def test_resume_last_stored_wins(spark):
    todo = spark.createDataFrame([("s1", 0), ("s2", 1), ("s3", 2)], "sent string, sidx int")
    done = spark.createDataFrame([("s1", 0, "old"), ("s1", 5, "new"), ("s2", 1, "x")], "sent string, line_no int, reply string")
    reused, pending = resume_split(todo, done)
    assert {r.sent: r.reply for r in reused.collect()} == {"s1": "new", "s2": "x"}
    assert [r.sent for r in pending.collect()] == ["s3"]


def test_seeded_split_stable_under_repartition(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id")
    a = {r.doc_id: r.bucket for r in seeded_split(docs.repartition(1), F.col("doc_id")).collect()}
    b = {r.doc_id: r.bucket for r in seeded_split(docs.repartition(17), F.col("doc_id")).collect()}
    assert a == b and 0.2 < sum(1 for v in a.values() if v == 0) / len(a) < 0.5


def test_annotated_roundtrip_keeps_shape_and_unicode(spark):
    t = [{"subj": "Zoë", "pred": "is", "auxi": ["not"], "objs": [{"prep": "in", "obj": "Köln"}]}]
    df = spark.createDataFrame([(0, "Zoë is not in Köln", t)],
                               "sidx int, sent string, triples array<struct<subj:string,pred:string,auxi:array<string>,objs:array<struct<prep:string,obj:string>>>>")
    path = scratch_path(spark, "test-annotated")
    C.write_annotated(df, path)
    raw = spark.read.text(path).first().value
    assert '"objs":[["in","Köln"]]' in raw
    back = C.read_annotated(spark, path).first()
    assert back.triples[0].objs[0].obj == "Köln" and back.sent == "Zoë is not in Köln"


def test_gold_tsv_ragged(spark):
    path = scratch_path(spark, "test-tsv")
    spark.createDataFrame([("s\tp\ta0\ta1",), ('q "x"\tp',), ("",)], "value string").coalesce(1).write.text(path)
    rows = C.read_gold_tsv(spark, path, drop_empty=True).orderBy("line_no").collect()
    assert [(r.sent, r.pred, list(r.args)) for r in rows] == [("s", "p", ["a0", "a1"]), ('q "x"', "p", [])]
