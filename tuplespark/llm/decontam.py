"""Benchmark decontamination (operator 3, native expressions only).

A distributed positional inverted index of the training texts, restricted to
the terms the tests need, answers phrase and proximity queries:

1. Occurrences of benchmark terms are counted over the whole corpus (partial
   aggregation; a frequent word costs one row per task).
2. Each distinct window names its ``n_anchors`` rarest terms. Postings ``(term,
   text_key, pos)`` are stored for these terms only.
3. The rarest term's postings, moved by the term's offset, give candidate
   starts; the next rarest terms' offset-adjusted postings intersect them.
4. Candidates meet their texts once (one of each set of copies) and the whole
   window is confirmed there by its 64-bit hash.

Texts are addressed by a 64-bit hash of the text, so exact copies share their
postings (a hot group of copies is indexed once) and a chance collision can
only add a candidate, which step 4 refutes. Test-side tables are broadcast
only when their measured size is under ``broadcast_mb``; beyond it the same
joins run as shuffles, which AQE splits when skewed.

Words: A-Z lower-cased runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. A
window is ``window`` consecutive item words; a shorter item, unless empty, is
one window. Null texts and texts without words have no words and no hits;
items without words or with a null text have no window. Rows are judged one by
one: repeated rows and null doc_ids stay, items sharing an item_id count once,
a null item_id is left out. Empty tables give no hits. Extra columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplespark.functions.arrays import explode_rows
from tuplespark.llm.common import ascii_lower, let, small, stored

#: What separates words. A-Z are no separators here, so a text may be cut before it is lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_terms(col: Column | str) -> Column:
    """The words of a text, in order, not lower-cased. Cutting at the breaks
    costs an eighth of extracting the words by their pattern."""
    col = F.col(col) if isinstance(col, str) else col
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), BREAK), "")


def fold(col: Column) -> Column:
    """Lower-cases A-Z; ``lower`` does just that, and faster, where all is ASCII."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(ascii_lower(col))


def terms(col: Column | str) -> Column:
    """The words of a text, in order."""
    return raw_terms(fold(F.col(col) if isinstance(col, str) else col))


def windows(items: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, phrase, words`` per distinct window of an item."""
    src = items.select(F.col(id_col).alias("item_id"), terms(text_col).alias("w")).where("item_id IS NOT NULL AND size(w) > 0")
    starts = F.expr(f"sequence(0, greatest(size(w) - {window}, 0))")
    cut = src.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.expr(f"slice(w, i + 1, {window})").alias("words"))
    return cut.select("item_id", F.concat_ws(" ", "words").alias("phrase"), "words").distinct()


def occurrences(docs: DataFrame, wanted: DataFrame, text_col: str = "text", broadcast_mb: float = 8) -> DataFrame:
    """``term, text_key, pos`` of every occurrence of a wanted term."""
    # explode_rows: a plain posexplode would run the word pattern a second time to filter empty arrays.
    toks = explode_rows(docs.select(F.xxhash64(text_col).alias("text_key"), raw_terms(text_col).alias("w")), ["text_key"], "w", "term", "pos")
    return toks.withColumn("term", fold(F.col("term"))).join(small(wanted, F.octet_length("term"), broadcast_mb), "term").select("term", "text_key", "pos")


def term_counts(docs: DataFrame, wanted: DataFrame, text_col: str = "text", broadcast_mb: float = 8) -> DataFrame:
    """Corpus count of each wanted term (0 when it never occurs)."""
    seen = occurrences(docs, wanted, text_col, broadcast_mb).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def build_index(docs: DataFrame, wanted: DataFrame, text_col: str = "text", broadcast_mb: float = 8) -> DataFrame:
    """Stored postings of the wanted terms; a text's copies are one entry."""
    return stored(occurrences(docs, wanted, text_col, broadcast_mb).distinct(), "postings")


def phrase_starts(docs: DataFrame, phrases: DataFrame, text_col: str = "text", n_anchors: int = 3,
                  broadcast_mb: float = 8) -> DataFrame:
    """Candidate ``phrase, text_key, start`` where the anchors agree.

    ``phrases``: distinct ``phrase`` (any key of it), ``words``."""
    parts = phrases.select("phrase", F.posexplode("words").alias("off", "term"))
    wanted = stored(parts.select("term").distinct(), "terms")
    counts = stored(term_counts(docs, wanted, text_col, broadcast_mb), "counts")
    # Rarest first; a phrase with a term that never occurs has none of its own.
    ranked = parts.join(counts, "term").groupBy("phrase").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("n", "off", "term"))), 1, n_anchors).alias("a"))
    anchors = stored(ranked.where("a[0].n > 0"), "anchors")
    index = build_index(docs, anchors.select(F.explode("a.term").alias("term")).distinct(), text_col, broadcast_mb)
    found = anchors.select("phrase", "a", F.expr("a[0].term").alias("term")).join(index, "term").select(
        "phrase", "a", "text_key", F.expr("pos - a[0].off").alias("start")).where("start >= 0")
    for k in range(1, n_anchors):
        at = found.where(f"size(a) > {k}").select("phrase", "a", "text_key", "start", F.expr(f"a[{k}].term").alias("term"),
                                                  F.expr(f"start + a[{k}].off").alias("pos"))
        met = at.join(index, ["term", "text_key", "pos"]).select("phrase", "a", "text_key", "start")
        found = met.unionByName(found.where(f"size(a) <= {k}"))
    return found.select("phrase", "text_key", "start")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5, id_col: str = "doc_id",
                  text_col: str = "text", broadcast_mb: float = 8, keep: list[str] | None = None) -> DataFrame:
    """Per row: ``n_words, n_hit, n_items, items_sha256, contaminated`` and
    ``spans``, the merged hit intervals in words (start, end); columns named in
    ``keep`` come back in the struct ``carried``."""
    more = [F.struct(*[F.col(c) for c in keep]).alias("carried")] if keep else []
    win = stored(windows(items, window).withColumn("phrase", F.xxhash64("phrase")), "windows")
    phrases = win.select("phrase", "words").distinct()
    starts = phrase_starts(docs, phrases, text_col, broadcast_mb=broadcast_mb)
    owners = win.groupBy("phrase").agg(F.collect_set("item_id").alias("items"), F.first(F.size("words")).alias("len"))
    cand = stored(starts.join(owners, "phrase").groupBy("text_key").agg(
        F.collect_set(F.struct("start", "len", "phrase", "items")).alias("cand")), "candidates")
    # Only texts with candidates are needed again, one of each set of copies.
    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    texts = texts.join(small(cand.select("text_key"), F.lit(8), broadcast_mb), "text_key", "left_semi").dropDuplicates(["text_key"])
    met = texts.join(cand, "text_key").withColumn("w", terms("text"))
    true_ones = F.expr(let("w", "t", "filter(cand, c -> c.start + c.len <= size(t) AND xxhash64(array_join(slice(t, c.start + 1, c.len), ' ')) = c.phrase)"))
    met = met.select("text_key", true_ones.alias("true_ones"))
    hits = met.select(
        "text_key",
        F.expr("""aggregate(array_sort(transform(true_ones, c -> struct(c.start AS b, c.start + c.len AS e))),
                  CAST(array() AS ARRAY<STRUCT<b: INT, e: INT>>),
                  (a, x) -> CASE WHEN size(a) > 0 AND x.b <= a[greatest(size(a) - 1, 0)].e
                                 THEN array_append(slice(a, 1, greatest(size(a) - 1, 0)),
                                                   struct(a[greatest(size(a) - 1, 0)].b AS b, greatest(x.e, a[greatest(size(a) - 1, 0)].e) AS e))
                                 ELSE array_append(a, x) END)""").alias("spans"),
        F.expr("array_distinct(flatten(transform(true_ones, c -> c.items)))").alias("ids"))
    hits = stored(hits.where("size(spans) > 0"), "hits")
    through = ["carried"] if keep else []
    rows = docs.select(*more, F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                       F.size(raw_terms(text_col)).cast("long").alias("n_words"))
    out = rows.join(small(hits, F.expr("8 * size(spans) + 8 * size(ids)"), broadcast_mb), "text_key", "left").select(
        *through, "doc_id", "n_words",
        F.expr("coalesce(spans, CAST(array() AS ARRAY<STRUCT<b: INT, e: INT>>))").alias("spans"),
        F.coalesce("ids", F.array().cast(f"array<{win.schema['item_id'].dataType.simpleString()}>")).alias("ids"))
    return out.select(
        *through, "doc_id", "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + (s.e - s.b))").alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.expr("array_join(array_sort(transform(ids, x -> CAST(x AS STRING))), ',')"), 256).alias("items_sha256"), "spans"
    ).withColumn("contaminated", F.expr(f"n_hit > 0 AND 100 * n_hit >= {percent} * n_words"))


def keep_clean(docs: DataFrame, items: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of the rows that are not contaminated."""
    return contamination(docs, items, keep=keep).where("NOT contaminated").select("carried.*")


def proximity(docs: DataFrame, queries: DataFrame, within: int, id_col: str = "doc_id", text_col: str = "text",
              broadcast_mb: float = 8) -> DataFrame:
    """``query_id, doc_id, pos``: places of a query's rarest term that have
    every other query term at most ``within`` words away.

    ``queries``: ``query_id, terms`` (array of lower-cased words). Postings of
    one text meet in stretches of ``within`` words and their two neighbours, so
    a long text is no single group."""
    parts = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).distinct()
    wanted = stored(parts.select("term").distinct(), "terms")
    index = build_index(docs, wanted, text_col, broadcast_mb)
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rare = parts.join(counts, "term").groupBy("query_id").agg(F.min(F.struct("n", "term"))["term"].alias("rarest"))
    need = parts.groupBy("query_id").agg((F.count(F.lit(1)) - 1).alias("others"))
    first = rare.join(index, rare["rarest"] == index["term"]).select("query_id", "rarest", "text_key", "pos", F.explode(
        F.expr(f"transform(array(-1, 0, 1), d -> pos div {max(within, 1)} + d)")).alias("cell"))
    rest = parts.join(index, "term").select("query_id", "term", "text_key", F.col("pos").alias("at"),
                                            F.expr(f"pos div {max(within, 1)}").alias("cell"))
    near = first.join(rest, ["query_id", "text_key", "cell"]).where((F.col("term") != F.col("rarest")) & (F.abs(F.col("at") - F.col("pos")) <= within))
    met = near.groupBy("query_id", "text_key", "pos").agg(F.count_distinct("term").alias("n"))
    alone = first.select("query_id", "text_key", "pos").distinct().join(need.where("others = 0"), "query_id").select("query_id", "text_key", "pos")
    hits = met.join(need, "query_id").where("n = others").select("query_id", "text_key", "pos").unionByName(alone)
    ids = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"))
    return hits.join(ids, "text_key").select("query_id", "doc_id", "pos")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns."""
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
