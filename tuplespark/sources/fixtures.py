"""The derived ``oie_pairs`` view: gold and generated tuple text per document.

The driver ships no annotated corpus, so gold text and "generated" text are
derived from ``documents`` by a fixed rule (see FIXTURES.md §2). The rule is
part of the test contract; it is run by Spark on the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuplespark.sources.tables import table

# Lines of at least three words give tuples; a line of more than 100 words gives several, cut into even parts.
# Rule, per part (k: its number in the document, n: its words, v = (doc_id + k) % 6):
# subject and predicate take one word each, or one to three where the part has eight words; the rest are objects,
# one to three, or four to eight in every seventh part of documents whose parts all have at most 64 words. An object
# has one word, the second one of three has two; the last takes the rest of the part. Two words or more begin with a preposition.
OIE_PAIRS_SQL = r"""
WITH l AS (SELECT doc_id, pos, trim(regexp_replace(line, '[#,.]', '')) AS line
           FROM {documents} LATERAL VIEW posexplode(split(text, '\n')) t AS pos, line),
f AS (SELECT doc_id, pos, split(line, ' +') AS f FROM l WHERE size(split(line, ' +')) >= 3),
w AS (SELECT doc_id, pos, j, slice(f, CAST(j * size(f) DIV s AS INT) + 1, CAST((j + 1) * size(f) DIV s - j * size(f) DIV s AS INT)) AS w
      FROM (SELECT *, CAST((size(f) + 99) DIV 100 AS INT) AS s FROM f) LATERAL VIEW explode(sequence(0, s - 1)) t AS j),
k AS (SELECT doc_id, w, size(w) AS n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, j) AS INT) AS k,
        max(size(w)) OVER (PARTITION BY doc_id) AS widest FROM w),
c AS (SELECT *, (doc_id + k) % 6 AS v, CASE WHEN n >= 8 THEN CAST(1 + (doc_id + k) % 3 AS INT) ELSE 1 END AS ns,
        CASE WHEN n >= 8 THEN 1 + k % 3 ELSE 1 END AS np FROM k),
b AS (SELECT *, slice(w, ns + np + 1, n) AS b, n - ns - np AS r FROM c),
m AS (SELECT *, CASE WHEN k % 7 = 0 AND r >= 8 AND widest <= 64 THEN 4 + k % 5 WHEN r >= 5 THEN 1 + k % 3
                     WHEN r >= 3 THEN 2 ELSE 1 END AS m FROM b),
o AS (SELECT doc_id, k, v, array_join(slice(w, 1, ns), ' ') AS subj,
        concat(CASE WHEN k % 2 = 0 AND n >= 8 THEN 'not ### ' ELSE '' END, array_join(slice(w, ns + 1, np), ' ')) AS pred,
        concat(CASE WHEN m = 3 THEN array(b[0], concat(b[1], ' ### ', b[2])) ELSE slice(b, 1, m - 1) END,
               array(CASE WHEN r - m - IF(m = 3, 1, 0) >= 1
                     THEN concat(get(b, m - 1 + IF(m = 3, 1, 0)), ' ### ', array_join(slice(b, m + 1 + IF(m = 3, 1, 0), n), ' '))
                     ELSE get(b, m - 1 + IF(m = 3, 1, 0)) END)) AS o FROM m),
r AS (SELECT doc_id, k, v, array_join(concat(array(subj, pred), o), ' ,, ') AS g,
        CASE v WHEN 1 THEN array_join(concat(array(subj, pred), reverse(o)), ' ,, ')
               WHEN 2 THEN array_join(concat(array(subj, pred), slice(o, 1, size(o) - 1)), ' ,, ')
               WHEN 3 THEN array_join(concat(array(subj, concat('not ### ', pred)), o), ' ,, ')
               WHEN 4 THEN NULL
               ELSE array_join(concat(array(subj, pred), o), ' ,, ') END AS h FROM o),
s AS (SELECT *, min(CASE WHEN h IS NOT NULL THEN k END) OVER (PARTITION BY doc_id) AS k0 FROM r)
SELECT d.doc_id,
  coalesce(array_join(transform(array_sort(collect_list(CASE WHEN k IS NOT NULL THEN struct(k, CASE WHEN k = 1 THEN g ELSE concat(CAST(k AS STRING), '. ', g) END AS t) END)), x -> x.t), '\n'), '') AS gold_str,
  concat(CASE WHEN d.doc_id % 7 = 0 THEN '   \n' ELSE '' END,
    array_join(transform(filter(array_sort(collect_list(CASE WHEN k IS NOT NULL THEN struct(k, CASE WHEN h IS NULL THEN NULL WHEN k = k0 THEN h WHEN v = 5 THEN concat(CAST(k AS STRING), '. ', h, '\n', CAST(k AS STRING), '. ', h) ELSE concat(CAST(k AS STRING), '. ', h) END AS t) END)), x -> x.t IS NOT NULL), x -> x.t), '\n'),
    CASE WHEN d.doc_id % 3 = 0 THEN '\nnote without number' ELSE '' END,
    CASE WHEN d.doc_id % 5 = 0 THEN '\n9x. bad ,, number' ELSE '' END) AS pred_str
FROM {documents} d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


def oie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, gold_str, pred_str``: one row per document; both texts are
    empty of tuples where no line has three words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return oie_pairs_rows(docs)


# Deleting '#', ',' and '.' never merges or splits space-separated runs; it
# only makes runs made of those characters vanish. So a line has >= 3 words
# after cleaning and trimming exactly when it has three runs holding some
# other character: WORD below, separated by spaces and junk-only runs.
# (?m): ^ and $ at line ends; (?d): only '\n' ends a line, as in split(.., '\n').
_WORD = r"[#,.]*[^ \n#,.][^ \n]*"
_JUNK = r"(?: +[#,.]+)*"
QUALIFYING = r"(?md)^ *(?:[#,.]+ +)*" + _WORD + _JUNK + " +" + _WORD + _JUNK + " +" + _WORD + ".*$"


def oie_pairs_rows(docs: DataFrame) -> DataFrame:
    """The rule of ``OIE_PAIRS_SQL`` without exploding every line.

    A raw line qualifies exactly when it matches ``QUALIFYING``, so one regex
    scan of the text picks the qualifying lines; only those are
    cleaned, split and exploded (code-generated expressions).
    """
    from pyspark.sql import functions as F

    from tuplespark.functions.arrays import explode_rows

    every = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(QUALIFYING), F.lit(0))
    # The one shuffle (by doc_id) happens here, so finding and formatting lines
    # run in parallel and the regrouping by doc_id below needs no second exchange.
    # It moves the texts: a query that joins them by doc_id as well reads the same exchange.
    picked = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", every.alias("every"))
    split = ("flatten(transform(every, x -> transform(array(split(trim(translate(x, '#,.', '')), ' +', -1)), f -> transform("
             "sequence(0, CAST((size(f) + 99) DIV 100 AS INT) - 1), j -> slice(f, CAST(j * size(f) DIV ((size(f) + 99) DIV 100) AS INT) + 1, "
             "CAST((j + 1) * size(f) DIV ((size(f) + 99) DIV 100) - j * size(f) DIV ((size(f) + 99) DIV 100) AS INT))))[0]))")
    # A document without a qualifying line keeps one row, without words (k = 0).
    lines = (picked.selectExpr("doc_id", f"{split} AS ws")
             .selectExpr("doc_id", "array_max(transform(ws, x -> size(x))) AS widest", "posexplode_outer(ws) AS (i, w)"))
    parts = (lines.selectExpr("doc_id", "widest", "coalesce(i + 1, 0) AS k", "coalesce(w, array()) AS w")
             .selectExpr("*", "size(w) AS n", "(doc_id + k) % 6 AS v")
             .selectExpr("*", "IF(n >= 8, CAST(1 + (doc_id + k) % 3 AS INT), 1) AS ns", "IF(n >= 8, 1 + k % 3, 1) AS np")
             .selectExpr("*", "slice(w, ns + np + 1, n) AS b", "n - ns - np AS r")
             .selectExpr("*", """CASE WHEN k % 7 = 0 AND r >= 8 AND widest <= 64 THEN 4 + k % 5
                                      WHEN r >= 5 THEN 1 + k % 3 WHEN r >= 3 THEN 2 ELSE 1 END AS m""")
             .selectExpr("*", "m + IF(m = 3, 1, 0) AS last"))
    objects = """concat(IF(m = 3, array(get(b, 0), concat(get(b, 1), ' ### ', get(b, 2))), slice(b, 1, m - 1)),
                        array(IF(r > last, concat(get(b, last - 1), ' ### ', array_join(slice(b, last + 1, n), ' ')), get(b, last - 1))))"""
    tuples = parts.selectExpr(
        "doc_id", "k", "v", "array_join(slice(w, 1, ns), ' ') AS subj",
        "concat(IF(k % 2 = 0 AND n >= 8, 'not ### ', ''), array_join(slice(w, ns + 1, np), ' ')) AS pred", f"{objects} AS o")
    per_line = tuples.selectExpr(
        "doc_id", "k", "v", "array_join(concat(array(subj, pred), o), ' ,, ') AS g",
        """CASE v WHEN 1 THEN array_join(concat(array(subj, pred), reverse(o)), ' ,, ')
                  WHEN 2 THEN array_join(concat(array(subj, pred), slice(o, 1, size(o) - 1)), ' ,, ')
                  WHEN 3 THEN array_join(concat(array(subj, concat('not ### ', pred)), o), ' ,, ')
                  WHEN 4 THEN CAST(NULL AS STRING)
                  ELSE array_join(concat(array(subj, pred), o), ' ,, ') END AS h""")
    per_doc = per_line.groupBy("doc_id").agg(
        F.expr("array_sort(collect_list(CASE WHEN k > 0 THEN struct(k, v, g, h) END))").alias("r"),
        F.expr("min(CASE WHEN k > 0 AND h IS NOT NULL THEN k END)").alias("k0"))
    return per_doc.selectExpr(
        "doc_id",
        r"""array_join(transform(r, x -> CASE WHEN x.k = 1 THEN x.g ELSE concat(CAST(x.k AS STRING), '. ', x.g) END),
                       '\n') AS gold_str""",
        r"""concat(CASE WHEN doc_id % 7 = 0 THEN '   \n' ELSE '' END,
                   array_join(filter(transform(r, x -> CASE WHEN x.h IS NULL THEN CAST(NULL AS STRING)
                                                           WHEN x.k = k0 THEN x.h
                                                           WHEN x.v = 5 THEN concat(CAST(x.k AS STRING), '. ', x.h, '\n',
                                                                                    CAST(x.k AS STRING), '. ', x.h)
                                                           ELSE concat(CAST(x.k AS STRING), '. ', x.h) END),
                                     z -> z IS NOT NULL), '\n'),
                   CASE WHEN doc_id % 3 = 0 THEN '\nnote without number' ELSE '' END,
                   CASE WHEN doc_id % 5 = 0 THEN '\n9x. bad ,, number' ELSE '' END) AS pred_str""")


def oie_pairs_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture exactly as written in FIXTURES.md (used to test the
    row-wise form)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spark.sql(OIE_PAIRS_SQL, documents=docs)
