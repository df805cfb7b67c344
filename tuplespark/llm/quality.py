"""Quality rules as a bitmask ledger (operator 1, native expressions only).

``ledger`` evaluates every rule once and stores, per row, the measurements and
one ``fail_bits`` integer (bit i set: rule i fails). Policies are versioned
rows ``(policy, version, reject_mask)``; applying one is ``fail_bits &
reject_mask = 0``, so a new policy never reads the text again. ``ablation``
answers "what would be kept without rule i" from counts per distinct bit
pattern (a partial aggregate of at most 2^rules rows), not from the rows.

Repeated 3-word windows are found inside the row: window hashes (64 bits) are
sorted with their positions and equal neighbours marked, so nothing is
shuffled and a very long text costs n log n.

Nulls and edge cases: a null text has no words, no lines and no symbols; an
empty text has one line without a word. A text of fewer than three words has
no window. Rows are judged one by one: repeated rows and null ids stay as
they are. Only ``doc_id`` and ``text`` are read, so other columns may have any
name. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespark.llm.common import let, scratch_path

#: (name, SQL condition that fails the row); the position is the bit. Append only: stored bits keep their meaning.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("too_many_words", "n_words > 100000"),
    ("short_or_long_words", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    ("many_symbols", "n_words > 0 AND 2 * n_symbols > n_words"),
    ("many_duplicate_lines", "n_lines > 0 AND 100 * n_dup_lines > 30 * n_lines"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(1 << BIT[n] for n in names)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    reject_mask: int


#: ``base`` is the contract's rule; ``web`` version 2 adds the method's own rules.
BASE = Policy("base", 1, mask("too_few_words", "repeated_windows"))
WEB = Policy("web", 2, mask(*(n for n, _ in RULES)))

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

# Words covered by windows found twice or more. w: words; s: (hash, start)
# sorted; p: sorted starts of repeated windows. Each start adds the words that
# the previous window did not cover already.
_REPEATED = "CASE WHEN size(w) < 4 THEN 0L ELSE " + let(
    "sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i)))", "s",
    let("sort_array(transform(filter(sequence(0, size(s) - 1), "
        "k -> (k > 0 AND s[k].h = s[greatest(k - 1, 0)].h) OR (k < size(s) - 1 AND s[k].h = s[least(k + 1, size(s) - 1)].h)), "
        "k -> s[k].i))", "p",
        "aggregate(p, struct(-3 AS last, 0L AS n), (a, x) -> struct(x AS last, a.n + least(3, x - a.last) AS n), a -> a.n)"),
) + " END"


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measurements of each row's whole text."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    per_row = let(
        r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)", "w",
        "struct(CAST(size(w) AS BIGINT) AS n_words, CAST(length(array_join(w, '')) AS BIGINT) AS word_chars, "
        f"CAST({_REPEATED} AS BIGINT) AS n_repeat_words)")
    lines = let(
        r"filter(split(text, '\\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')", "l",
        "struct(CAST(size(l) AS BIGINT) AS n_lines, CAST(size(l) - size(array_distinct(l)) AS BIGINT) AS n_dup_lines)")
    return rows.select("doc_id", F.expr(per_row).alias("m"), F.expr(lines).alias("l"),
                       F.expr("CAST(regexp_count(text, '[#*$%&|<>]') AS BIGINT)").alias("n_symbols")).selectExpr(
        "doc_id", "m.n_words AS n_words", "m.word_chars AS word_chars", "n_symbols", "l.n_lines AS n_lines",
        "l.n_dup_lines AS n_dup_lines", "m.n_repeat_words AS n_repeat_words")


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Measurements and ``fail_bits``: every rule evaluated once per row."""
    bits = " + ".join(f"(CASE WHEN {cond} THEN {1 << i}L ELSE 0L END)" for i, (_, cond) in enumerate(rules or RULES))
    return measure(df, id_col, text_col).withColumn("fail_bits", F.expr(bits or "0L"))


def write_ledger(df: DataFrame, path: str | None = None) -> DataFrame:
    """Stores the ledger (by default in the shared folder) and rereads it."""
    path = path or scratch_path(df.sparkSession, "llm-ledger")
    led = ledger(df)
    led.write.parquet(path)
    return df.sparkSession.read.schema(led.schema).parquet(path)


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``failed`` (under this policy) and ``kept``."""
    hit = F.col("fail_bits").bitwiseAND(F.lit(policy.reject_mask)) != 0
    return led.withColumn("failed", hit).withColumn("kept", ~hit)


def patterns(led: DataFrame) -> DataFrame:
    """Rows and words per distinct failure pattern: at most 2^rules rows."""
    return led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_words").alias("n_words"))


def ablation(led: DataFrame, policy: Policy, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per rule of the policy: rows failing it, rows failing only it (won back
    by dropping the rule), and rows kept with and without it."""
    names = [(i, n) for i, (n, _) in enumerate(rules or RULES) if policy.reject_mask >> i & 1]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, n in names]))
    per = patterns(led).withColumn("hit", F.col("fail_bits").bitwiseAND(F.lit(policy.reject_mask))).select("*", rows.alias("r"))
    n, on = F.col("n_rows"), F.col("hit").bitwiseAND(F.col("r.bit")) != 0
    return per.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(on, n).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("hit") == F.col("r.bit"), n).otherwise(0)).alias("n_fail_only"),
        F.sum(F.when(F.col("hit") == 0, n).otherwise(0)).alias("n_kept"),
        F.sum(F.when(F.col("hit").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, n).otherwise(0)).alias("n_kept_without"))


def digest(df: DataFrame, policy: Policy = WEB) -> DataFrame:
    """The contract's columns: base measurements, base rule and verdict."""
    led = apply_policy(ledger(df), policy)
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      (F.col("fail_bits").bitwiseAND(F.lit(BASE.reject_mask)) != 0).alias("base_failed"), "kept", "fail_bits")
