"""What moves, what is written and what stays: sizes that must not grow with more than the input."""

from __future__ import annotations

import glob
import os
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tuplespark.operators import generate as G
from tuplespark.operators.corpus import group_by_sentence
from tuplespark.operators.examples import batch_longest, encode, pad_batch
from tuplespark.plans import evaluate as E
from tuplespark.plans.chains import echo_annotator, annotate_corpus
from tuplespark.plans.queries import example_texts
from tuplespark.session import materialize, release
from tuplespark.sources import corpus as C


def local(path: str) -> str:
    return path.removeprefix("file:")


def executed(df) -> str:
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_written_tables_are_packed_and_leave_no_shuffle(spark):
    def shuffles():
        return len(list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().toList().mkString("\n").split("shuffle_"))) - 1
    before = shuffles()
    df = materialize(spark.range(1000).repartition(7, "id"))
    end = time.time() + 20      # files go in the background
    while shuffles() > before and time.time() < end:
        time.sleep(0.1)
    assert shuffles() <= before
    files = glob.glob(os.path.join(local(df._written), "*.parquet"))
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
    assert df.count() == 1000
    release(df)
    assert not os.path.exists(local(df._written))


def test_encoded_tokens_move_once_and_packed(spark):
    words = ["a", "b\nc", "\\", "\\n", "\\\\N", "", None, "ü b", "\\N", "gone"]
    rng = random.Random(4)
    rows = [(i, rng.choices(words, k=rng.randrange(9)), rng.choices(words[:1] + ["z"], k=3) if i % 5 else None) for i in range(40)]
    rows += [(40, [], []), (41, [""], ["a"]), (None, ["a"], ["a"])]
    df = materialize(spark.createDataFrame(rows, "k long, p array<string>, t array<string>"))
    ids = {w: 10 + i for i, w in enumerate(words) if w not in (None, "gone")}
    vocab = spark.createDataFrame(list(ids.items()), "token string, id long")
    coded = encode(df, ["k"], ["p", "t"], vocab, ["pi", "ti"], unk_id=3)
    plan = executed(coded)
    got = {r.k: (r.pi, r.ti) for r in coded.collect()}
    for k, p, t in rows:
        none = k is None or p is None or t is None
        assert got[k] == (([], []) if none else ([ids.get(w, 3) for w in p], [ids.get(w, 3) for w in t])), (k, p, t)
    assert plan.count("ReusedExchange") == 1


def test_texts_move_once_for_the_fixture_and_the_prompt(spark, sf001):
    assert "ReusedExchange" in executed(example_texts(spark, sf001))


def test_padding_by_known_longest_moves_no_arrays(spark):
    rows = [(i, i // 3, list(range(i % 5)), list(range(i % 5))) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, batch_id long, input_ids array<bigint>, labels array<bigint>")
    known = materialize(batch_longest(df.withColumn("length", F.size("input_ids"))))
    for method in ("bos", "ign", "pad"):
        padded = pad_batch(known, method, longest="longest")
        assert "Exchange" not in executed(padded)
        want = pad_batch(df, method).orderBy("k").collect()
        assert padded.select(*want[0].__fields__).orderBy("k").collect() == want


def test_numbered_lines_stay_where_they_are_read(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"line {k} {i}\n" for i in range(50)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = C.read_lines(spark, str(tmp_path))
        exchanges = [x for x in executed(lines).split("\n") if "Exchange hashpartitioning" in x]
        assert len(exchanges) == 1      # the counts per split, not the lines
        got = [r.value for r in lines.orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [f"line {k} {i}" for k in range(3) for i in range(50)]


def test_annotation_in_compressed_files(spark, tmp_path):
    gold = spark.createDataFrame([(f"s{i}", "p", ["a", "b"], 2 * i + j) for i in range(9) for j in range(2)],
                                 "sent string, pred string, args array<string>, line_no long")
    C.write_gold_tsv(gold, str(tmp_path / "gold"), order_by=["line_no"], compression="gzip")
    got = {}
    for kind in (None, "gzip"):
        out = str(tmp_path / f"out-{kind}")
        annotate_corpus(spark, str(tmp_path / "gold"), out, echo_annotator, pause=0.0, compression=kind)
        assert all(f.endswith(".gz") == (kind == "gzip") for f in glob.glob(out + "/part-*"))
        got[kind] = [str(r) for r in C.read_annotated(spark, out, line_no=True).orderBy("line_no").collect()]
    assert got[None] == got["gzip"] and len(got[None]) == 9


def test_sentence_numbers_are_written(spark):
    rows = spark.createDataFrame([("b", "p", ["x"], 1), ("a", "p", ["x"], 1), (None, "p", ["x"], 1), ("b", "q", ["x"], 5)],
                                 "sent string, pred string, args array<string>, line_no long")
    grouped = group_by_sentence(rows)
    first = {r.sent: r.sidx for r in grouped.collect()}
    assert sorted(first.values()) == [0, 1, 2] and set(first) == {"a", "b", None}
    assert {r.sent: r.sidx for r in grouped.select("sent", "sidx").repartition(3, "sent").collect()} == first
    assert {r.sent: len(r.records) for r in grouped.collect()} == {"a": 1, "b": 2, None: 1}


def test_tokens_of_few_rows_are_python_objects_at_once():
    alive, most = [0], [0]

    class Token(str):
        def __new__(cls, x):
            alive[0] += 1
            most[0] = max(most[0], alive[0])
            return super().__new__(cls, x)

        def __del__(self):
            alive[0] -= 1
    rows = pa.array([["a b", "c"], None, []] * 400, pa.list_(pa.string()))
    got = G._tokenized(rows, lambda x: [Token(w) for w in x.split()])
    assert got.to_pylist() == [[["a", "b"], ["c"]], None, []] * 400
    assert most[0] <= 3 * G.TOKENIZED


def test_words_are_split_once_for_a_lemmatizer(spark, monkeypatch):
    calls = []
    split = E.sentence_words
    from tuplespark.operators import scoring
    for module in (E, scoring):
        monkeypatch.setattr(module, "sentence_words", lambda *a, **k: (calls.append(1), split(*a, **k))[1])
    texts = spark.createDataFrame([(1, "cats sit ,, eats ,, fish", "cat sit ,, eat ,, fish")], "doc_id long, gold_str string, pred_str string")
    sents = materialize(E.parse_sentences(texts))
    lemmatizer = G.pandas_lemmatizer(lambda w: w.rstrip("s"))
    got = E.pair_scores(sents, cfg=E.EvalConfig(lemmatizer=lemmatizer)).collect()
    assert len(calls) == 1 and [(r.prec, r.rec) for r in got] == [(1.0, 1.0)]
