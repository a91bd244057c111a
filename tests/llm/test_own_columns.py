"""Columns of the input that have an operator's own names come through unchanged."""

import numpy as np

from meterflow.llm import quality_classifier, quality_rules
from meterflow.llm.storage import set_aside


def test_set_aside(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_T int, x int, _t_ int")
    out, back = set_aside(df, "_t")
    assert out.columns[1:] == ["x", "_t_"] and out.columns[0].lower() not in ("_t", "_t_") and out.withColumnsRenamed(back).columns == df.columns
    assert set_aside(df, "other")[1] == {}


def test_rules_keep_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some words in a line " * 20, "mine", 7)], "doc_id long, text string, _words string, _lines int")
    r = quality_rules.quality_rules(df).first()
    assert (r._words, r._lines, r.n_words) == ("mine", 7, 100)
    assert quality_rules.quality_rules(df.withColumnRenamed("text", "t").withColumnRenamed("_words", "text").withColumnRenamed("t", "_words"), text="_words").first().n_words == 100


def test_classifier_keeps_clashing_columns(spark):
    model = quality_classifier.fit(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64), quality_classifier.GRADES)
    df = spark.createDataFrame([(1, "a text", "mine", 0.5)], "doc_id long, text string, _t string, kept double")
    r = quality_classifier.classify(df, model).first()
    assert r._t == "mine" and r.text == "a text" and r.kept is True
