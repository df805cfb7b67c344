"""Fixture equivalence, plan shape, entry point, registry."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from tuplespark.sources.fixtures import QUALIFYING, oie_pairs, oie_pairs_sql


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" ab#,.\t", max_size=16))
def test_qualifying_regex_equals_cleaned_word_count(line):
    cleaned = re.sub("[#,.]", "", line).strip(" ")
    n = len(re.split(" +", cleaned))
    matched = re.fullmatch(QUALIFYING.replace("(?md)", ""), line) is not None
    assert matched == (n >= 3)


def test_fixture_forms_agree(spark, sf001):
    a, b = oie_pairs(spark, sf001), oie_pairs_sql(spark, sf001)
    assert a.count() == 200 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_plan_has_no_python_and_no_single_partition(spark, sf001):
    from tuplespark.plans import queries as Q
    s, sc = Q._scored(spark, sf001)
    plan = _physical(Q.sentence_scores(s, sc))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "SinglePartition" not in plan


def test_word_overlap_splits_each_text_once(spark, sf001):
    from tuplespark.plans import queries as Q
    plan = Q.QUERIES["word_overlap"](spark, sf001)._jdf.queryExecution().optimizedPlan().toString()
    ov = next(l for l in plan.split("\n") if "AS ov_text" in l)
    # Not again in the lambda over the common words.
    assert ov.count("split(") == 2


def test_parquet_scan_is_pruned(spark, sf001):
    from tuplespark.plans import queries as Q
    plan = _physical(Q.QUERIES["facts_wide"](spark, sf001))
    scan = [l for l in plan.split("\n") if "Scan parquet" in l or "FileScan" in l]
    assert scan and all("lang" not in l and "n_chars" not in l for l in scan)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and {"articleId", "lineId", "factId", "subj", "obj5"} <= set(df.columns)


def test_every_query_has_an_oracle_or_is_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
    # The library's own queries all have SQL; only the optional training-data queries may lack it.
    assert all(k.startswith("op") or k == "pipeline" for k in set(q) - set(o))
