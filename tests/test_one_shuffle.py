"""Payroll documents are shuffled once on their way to events, and once by order before that."""

import pytest

import __spark_entry__
from factloom.operators import finance
from factloom.plans.facts import payroll_documents

SF = "/root/testdata/sf0.001"


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_documents_and_events_are_shuffled_once(spark):
    docs = payroll_documents(spark, SF).localCheckpoint()
    events, rejected = finance.fuse_events(docs)
    assert exchanges(events) == exchanges(rejected) == 1


@pytest.mark.parametrize("name", ["fuse_payroll_events", "validation_rules", "validation_memories", "event_memories", "pnl_event"])
def test_a_query_reads_and_shuffles_its_tables_once(spark, name):
    frame = __spark_entry__.queries()[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    # Orders and customers, orders and lines by order, documents by group.
    assert plan.count("Scan parquet") <= 3 and exchanges(frame) <= 5
