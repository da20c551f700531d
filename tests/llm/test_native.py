"""What the plans of the native operators are made of."""

import re

import pytest
from pyspark.sql import functions as F

from ripplemark.llm import decontaminate, exact_dedup, licenses, mixing, scratch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "documents.parquet")
    docs.withColumn("unused", F.lit("x")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def plans(spark, stored):
    """By operator, the plans of all tables that it writes on the way, and that of its result."""
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "a b")], "item_id long, text string")
    calls = {
        "contamination": lambda: decontaminate.contamination(stored, bench),
        "decontaminate": lambda: decontaminate.decontaminate(stored, bench),
        "licences": lambda: licenses.scan(stored, path=F.col("source")),
        "groups": lambda: exact_dedup.exact_groups(stored),
        "dedup": lambda: exact_dedup.exact_dedup(stored),
        "mix": lambda: mixing.mix(stored),
    }
    found, at = {name: [] for name in calls}, []
    made = scratch.Saved.__init__
    scratch.Saved.__init__ = lambda self, df, label: (at[-1].append(plan_of(df)), made(self, df, label))[1]
    try:
        for name, call in calls.items():
            at.append(found[name])
            found[name].append(plan_of(call()))
    finally:
        scratch.Saved.__init__ = made
    return found


def test_no_python_and_no_cross_joins(plans):
    for name, all_of in plans.items():
        for plan in all_of:
            assert not re.search(r"Python|Pandas|Arrow|MapIn|CartesianProduct|BroadcastNestedLoopJoin", plan), name


def test_runs_are_sorted_before_they_are_merged(plans):
    merges = [p for p in plans["groups"] if "Window [" in p]
    assert len(merges) == 3  # 64 runs, 4 at a time
    for plan in merges:
        assert re.search(r"Sort \[_run#\d+ ASC NULLS FIRST, _sha#\d+", plan[plan.index("Window [") :]) and plan.count("Exchange") == 1


def test_scans_read_what_they_need(plans):
    for name in ("contamination", "groups"):
        scans = [s for plan in plans[name] for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]
        given = [set(re.findall(r"(\w+):", s)) for s in scans if not s.startswith("_")]
        assert given and all(s <= {"doc_id", "text", "item_id"} for s in given), name
        assert sum("text" in s for s in given) == 1, name


def test_texts_are_not_shuffled_by_the_scans(plans):
    for name in ("contamination", "groups", "mix", "licences"):
        for line in (line for plan in plans[name] for line in re.findall(r"Exchange [^\n]*", plan)):
            assert "text#" not in line, name
