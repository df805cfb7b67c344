"""Filter interaction audit (operator 13, native expressions only).

What a chain of filters removes depends on their order. The audit answers for
every order at once without running any chain:

1. ``failures``: each document is judged once by every filter on its whole
   text; the result is one mask with a bit per failed filter. Texts do not
   travel: copies are found by their SHA-256.
2. ``cells``: documents are counted per part and mask, with the counts of good
   and toxic ones among them. A part has at most 2^5 cells, however many
   documents it holds.
3. ``audit``: each cell folds its mask across the broadcast array of all 120
   orders (``aggregate``), which gives 600 structs weighted by the cell's
   counts; the cells of a part are merged by elementwise sums.

Copies: filter E fails a document whose text occurs under a smaller doc_id
anywhere in the table. Counts per (text, id, part) come first, then the least
id per text, so a group of copies that holds a third of all rows is reduced
map-side and joined as a few rows; rows of one id share its verdict.

Nulls and edge cases: a null text counts as empty, an empty text has no words
and fails A only (0 words are fewer than 100; B, C and D do not hold for it),
and E where an earlier empty text exists. A null lang is the part ''. A row
without id never fails E and makes no other row fail it. Repeated rows count
each; several label rows of one id make it good (toxic) if any of them does.
An empty table gives no rows. Only doc_id, text, lang and the labels' doc_id,
quality, toxic are read, so other columns may have any name.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespark.llm.common import let, stored

#: (letter, SQL condition over text t, words w that fails the row); the place is the bit. E is judged over the table.
FILTERS = [
    ("A", "size(w) < 100"),
    ("B", "100 * CAST(size(array_distinct(w)) AS long) < 80 * CAST(size(w) AS long)"),
    ("C", "100 * CAST(regexp_count(t, '[A-Z]') AS long) > 10 * CAST(char_length(t) AS long)"),
    ("D", "t RLIKE '[#$%&*|]'"),
    ("E", None),
]
LETTERS = "".join(letter for letter, _ in FILTERS)
ORDERS = ["".join(p) for p in permutations(LETTERS)]
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
_BREAK = r"[\\x20\\x09-\\x0D]+"


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, text_key, bits``: the filters that look at one document only."""
    judged = " + ".join(f"IF({rule}, {1 << k}, 0)" for k, (_, rule) in enumerate(FILTERS) if rule)
    words = f"filter(split(t, '{_BREAK}'), x -> x <> '')"
    bits = let("coalesce(text, '')", "t", let(words, "w", judged))
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"),
                       F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_key"), F.expr(f"{bits} AS bits"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents per part and set of failed filters."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.expr("CAST(quality <=> 1 AS int)")).alias("good"), F.max(F.expr("CAST(toxic <=> 1 AS int)")).alias("toxic"))
    # One row per text, part and id: repeated rows, and rows without id, are counted before any join.
    rows = failures(docs).groupBy("text_key", "bits", "part", "doc_id").agg(F.count("*").alias("n"))
    rows = rows.join(marks, rows.doc_id == marks.label_id, "left").select(
        "text_key", "bits", "part", "doc_id", "n", F.expr("n * coalesce(good, 0) AS good"), F.expr("n * coalesce(toxic, 0) AS toxic"))
    # Per text and part: all its rows, and those of its least id. Rows without id are outside E.
    counted = "struct(n, good, toxic)"
    known = rows.where("doc_id IS NOT NULL").groupBy("text_key", "bits", "part").agg(
        F.min("doc_id").alias("least"), F.min_by(F.expr(counted), "doc_id").alias("first"),
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    known = stored(known, "audit-texts")     # read twice; the texts are read once
    earliest = known.groupBy(F.col("text_key").alias("key")).agg(F.min("least").alias("earliest"))
    known = known.join(earliest, F.col("text_key") == F.col("key"))
    copy = 1 << LETTERS.index("E")
    split = known.select("part", "bits", F.expr(
        f"""explode(IF(least = earliest,
          array(struct(0 AS e, first.n AS n, first.good AS good, first.toxic AS toxic),
                struct({copy} AS e, n - first.n AS n, good - first.good AS good, toxic - first.toxic AS toxic)),
          array(struct({copy} AS e, n, good, toxic)))) AS c"""))
    nameless = rows.where("doc_id IS NULL").select("part", F.col("bits").alias("mask"), "n", "good", "toxic")
    counts = split.select("part", F.expr("bits + c.e AS mask"), "c.n", "c.good", "c.toxic").unionByName(nameless)
    return counts.where("n > 0").groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def _steps(cell: str) -> str:
    """SQL text: the five steps of every order for one cell, as one array of 600 structs of counts."""
    orders = "array(" + ", ".join("array(" + ", ".join(f"{1 << LETTERS.index(c)}" for c in o) + ")" for o in ORDERS) + ")"
    zero = "CAST(0 AS long)"
    # The fold carries whether the cell was removed and the steps so far.
    step = f"""struct(
        IF(acc.gone OR {cell}.mask & bit <> 0, {zero}, {cell}.n) AS kept,
        IF(NOT acc.gone AND {cell}.mask & bit <> 0, {cell}.n, {zero}) AS removed,
        IF(acc.gone AND {cell}.mask & bit <> 0, {cell}.n, {zero}) AS redundant,
        IF({cell}.mask = bit, {cell}.n, {zero}) AS unique_fails,
        IF(NOT acc.gone AND {cell}.mask & bit <> 0, {cell}.good, {zero}) AS good_lost,
        IF(NOT acc.gone AND {cell}.mask & bit <> 0, {cell}.toxic, {zero}) AS toxic_lost)"""
    none = "array_repeat(struct(" + ", ".join(f"{zero} AS {m}" for m in MEASURES) + "), 0)"
    fold = f"""aggregate(o, struct(false AS gone, {none} AS steps),
        (acc, bit) -> struct(acc.gone OR {cell}.mask & bit <> 0 AS gone, concat(acc.steps, array({step})) AS steps),
        acc -> acc.steps)"""
    return f"flatten(transform({orders}, o -> {fold}))"


def audit(counts: DataFrame) -> DataFrame:
    """Every part, order and step from the cells of ``cells``."""
    merged = ", ".join(f"x.{m} + y.{m} AS {m}" for m in MEASURES)
    # A part has at most 2^5 cells, so that its group is small whatever the number of documents.
    total = f"aggregate(slice(per_cell, 2, 32), per_cell[0], (a, b) -> zip_with(a, b, (x, y) -> struct({merged})))"
    names = "array(" + ", ".join(f"'{o}'" for o in ORDERS) + ")"
    parts = (counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
             .select("part", F.expr(f"transform(cells, c -> {_steps('c')}) AS per_cell"))
             .select("part", F.expr(f"posexplode({total}) AS (place, s)"))
             .select("part", F.expr(f"{names}[place DIV 5] AS filter_order"), F.expr("CAST(place % 5 + 1 AS int) AS step"), "s.*"))
    by_filter = parts.withColumn("letter", F.expr("substr(filter_order, step, 1)"))
    shapley = by_filter.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return by_filter.join(shapley, ["part", "letter"]).select("part", "filter_order", "step", *MEASURES, "shapley")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(cells(docs, labels))
