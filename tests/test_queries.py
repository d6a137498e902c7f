"""Every registered query against its SQL, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as contract
from chatterlake.plans import queries as registered
from chatterlake.plans.oracles import ORACLES
from chatterlake.plans.queries import QUERIES
from check_queries import compare, connect

ROWS_ONLY = {"topic_sweep", "topic_words", "topic_coherence", "topic_relevance"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_all_other_queries_have_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, sf_dir, name, monkeypatch):
    if name in ROWS_ONLY:  # the full sweep is 900 jobs; two of its models with two passes run the same code
        monkeypatch.setattr(registered, "SWEEP_COUNTS", (3, 5))
        monkeypatch.setattr(registered, "SWEEP_PASSES", 2)
    verdict, _ = compare(spark, duck, name, sf_dir)
    assert verdict.startswith("rows only" if name in ROWS_ONLY else "equal"), verdict
    assert not verdict.endswith(" 0")


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["day", "negative", "neutral", "positive", "unknown"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROWS_ONLY))
def test_no_cross_join(spark, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _plan(spark, sf_dir, name):
    return contract.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()


def test_scan_reads_only_what_is_needed(spark, sf_dir):
    plan = _plan(spark, sf_dir, "posts_per_day")
    assert set(re.findall(r"ReadSchema: (\S+)", plan)) == {"struct<doc_id:bigint>"}
    plan = _plan(spark, sf_dir, "events_per_day")
    assert "struct<ts:timestamp_ntz,event_type:string,value:double>" in plan
    assert "PushedFilters: [IsNotNull(ts)" in plan


@pytest.mark.parametrize(
    "name, shuffles",
    [
        ("clean_text", 1),  # the spread of the one-file table
        ("daily_trends", 1),
        ("events_per_day", 1),
        ("word_freq", 2),
        ("bag_of_words", 2),  # spread and dedupe: the bags need none
        ("split_positive", 1),
    ],
)
def test_number_of_shuffles(spark, sf_dir, name, shuffles):
    plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange ", plan)) == shuffles, plan


@pytest.mark.parametrize("sf, counts", [("0.001", (260, 240, 194, 108)), ("0.01", (1300, 1200, 961, 513))])
def test_posts_hold_the_cases(spark, sf, counts):
    from pyspark.sql import functions as F

    from chatterlake.plans.fixtures import posts

    got = posts(spark, f"/root/testdata/sf{sf}").agg(
        F.count("*"), F.count("content"), F.countDistinct("content"), F.count("sentiment")
    )
    assert tuple(got.first()) == counts


def test_labels_are_joined_only_when_wanted(spark, sf_dir):
    from chatterlake.plans.fixtures import posts

    plan = posts(spark, sf_dir, ("post_id", "content"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
