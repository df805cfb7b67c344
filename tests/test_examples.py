"""Examples, ids, padding, numbering (U15-U18, WIN-1..3, ORD-2)."""

from pyspark.sql import functions as F

from tuplespark.operators.examples import build_examples, build_vocab, encode, pad_batch
from tuplespark.operators.facts import split_ident, with_ident
from tuplespark.operators.indexing import length_buckets, with_batch, with_index


def test_u15_padding_methods(spark):
    df = spark.createDataFrame([(0, [5, 6], [-100, 6]), (0, [1, 2, 3, 4], [1, 2, 3, 4])],
                               "batch_id long, input_ids array<bigint>, labels array<bigint>")
    got = {m: pad_batch(df, m, bos_id=0, pad_id=2).where(F.size("labels") == 4).orderBy(F.col("n_pad").desc()).first()
           for m in ("bos", "ign", "pad")}
    assert list(got["bos"].input_ids) == [0, 0, 5, 6] and list(got["bos"].labels) == [-100, -100, -100, 6]
    assert list(got["ign"].input_ids) == [5, 6, -100, -100] and list(got["ign"].labels) == [-100, 6, -100, -100]
    assert list(got["pad"].input_ids) == [5, 6, 2, 2] and list(got["pad"].labels) == [-100, 6, -100, -100]


def test_u16_examples_cut_and_end_id(spark):
    df = spark.createDataFrame([([7, 8], [9, 10])], "p array<bigint>, t array<bigint>")
    r = build_examples(df, "p", "t", max_length=4, eos_id=1).first()
    assert list(r.input_ids) == [7, 8, 9, 1] and list(r.labels) == [-100, -100, 9, 1] and r.length == 4


def test_u17_u18_idents(spark):
    df = spark.createDataFrame([(None, 3), ("a_b", 12)], "articleId string, lineId int")
    got = [r.ident for r in with_ident(df).orderBy("lineId").collect()]
    assert got == ["", "a_b_12"]
    r = split_ident(spark.createDataFrame([("a_b_12",)], "ident string")).first()
    assert r.articleId == "a_b" and r.lineId == 12


def test_global_index_is_consecutive_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(13)
    got = with_index(df, ["k"]).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(5000))
    assert [r.k for r in got] == sorted(r.k for r in got)


def test_vocab_and_encode(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c", "b", "z"])], "k long, tok array<string>")
    v = build_vocab(df, "tok", min_count=1)
    ids = {r.token: r.id for r in v.collect()}
    assert ids["b"] == 4 and ids["a"] == 5 and ids["c"] == 6 and ids["z"] == 7
    enc = encode(df, ["k"], "tok", build_vocab(df, "tok", min_count=2), "ids")
    assert {r.k: list(r.ids) for r in enc.collect()} == {1: [4, 3, 4], 2: [3, 4, 3]}


def test_batches_and_length_buckets(spark):
    df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(40)], "idx long, length int")
    b = with_batch(df, 8).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in b) == [8] * 5
    lb = length_buckets(df, size=4, mega=2).collect()
    by = {}
    for r in lb:
        by.setdefault(r.batch_id, []).append(r)
    assert all(len(v) == 4 for v in by.values())
    for bid, rows in by.items():   # batches of a mega-batch are ordered by length
        other = [r for r in lb if r.batch_id // 2 == bid // 2 and r.batch_id > bid]
        assert all(min(x.length for x in rows) >= y.length for y in other)


def test_encode_repeated_and_null_keys_chunks_and_length(spark, monkeypatch):
    from tuplespark.operators import examples
    v = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6), (None, 9)], "token string, id long")
    df = spark.createDataFrame([(1, "x", ["a", "b"], ["c"]), (2, "y", ["b", "zz"], []), (2, "z", ["c"], ["a", "a", "a"]),
                                (None, "n", ["a"], ["b"]), (3, "o", [], None), (4, "p", ["a", None], ["b"])],
                               "k long, more string, p array<string>, t array<string>")
    want = {"x": ([4, 5], [6]), "y": ([5, 6, 3], [4, 4, 4]), "z": ([5, 6, 3], [4, 4, 4]), "n": ([], []), "o": ([], []), "p": ([4, 3], [5])}
    for mb in (64, -1):
        monkeypatch.setattr(examples, "BROADCAST_MB", mb)
        enc = encode(df, ["k"], ["p", "t"], v, ["pi", "ti"], chunk_bytes=2)
        assert {r.more: (list(r.pi), list(r.ti)) for r in enc.collect()} == want
    cut = encode(df.where("k = 1 OR more = 'z'"), ["k"], ["p", "t"], v, ["pi", "ti"], max_length=2)
    assert {r.more: (list(r.pi), list(r.ti)) for r in cut.collect()} == {"x": ([4, 5], []), "z": ([6], [4])}


def test_encode_looks_up_distinct_tokens_only(spark, monkeypatch):
    from tuplespark.operators import examples
    monkeypatch.setattr(examples, "BROADCAST_MB", -1)
    df = spark.createDataFrame([(k, ["a", "b", "a"] * 50) for k in range(200)], "k long, tok array<string>")
    enc = encode(df, ["k"], "tok", spark.createDataFrame([("a", 4)], "token string, id long"))
    assert {tuple(r.ids) for r in enc.collect()} == {(4, 3, 4) * 50}
    plan = enc._jdf.queryExecution().optimizedPlan().toString()
    # Before, every token was a row of a join on the token, and the rows were collected by key.
    assert "collect_list" not in plan and "array_distinct" in plan
