"""Standardizers ask for their text once."""

from pyspark.sql import functions as F

from millrace.plans import catalogue
from millrace.sources import standardize


def test_conversations_are_folded_once(spark, sf):
    plan = catalogue.queries()["standardized_instructions"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 0  # six sources read the saved conversations


def test_the_text_of_a_document_is_made_once(spark):
    df = spark.createDataFrame([(1, "a  b", " c ")], "source_index long, instruction string, output string")
    made = standardize.standardize(df, standardize.Source("alpaca", "x"))
    assert made.select("text").first()[0] == "Instruction:\na  b\n\nResponse:\nc"
    plan = made.select("id", F.sha2("text", 256))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Response:") == 1
