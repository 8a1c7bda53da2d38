"""The physical plans are the ones wanted."""

import re

import __spark_entry__ as entry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    from factloom.operators import facts
    from factloom.plans.catalog import func

    text = plan(facts.in_scope(func(spark, data), "r", "v", "p").select("func_id"))
    assert "EqualTo(repo_id,r)" in text and "EqualTo(path,p)" in text
    assert re.search(r"ReadSchema: struct<func_id:bigint,repo_id:string,rev_hash:string,path:string>", text)


def test_wide_payloads_are_not_shuffled(spark, data):
    text = plan(entry.queries()["p7_found"](spark, data))
    assert "payload" not in text


def test_first_of_a_key_is_cut_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan(entry.queries()["function_by_signature"](spark, data))
