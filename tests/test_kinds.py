"""What kind of information words have, and when it is told."""

import re

from pyspark.sql import functions as F

from cuetide.functions import text as tx
from cuetide.operators import guards
from cuetide.plans import catalog

SF = "/root/testdata/sf0.001"


def test_kinds_are_told_once_a_word(spark):
    """The filter went before the grouping, and told the kind of each word of each text."""
    plan = catalog.queries()["tx07_information_kind"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate") :]
    assert "Generate" in below and not re.search("rlike|regexp_replace", below, re.IGNORECASE)


def test_kinds_of_texts(spark):
    kinds = {
        "punctuation": ["...", " … ! ", "<b>?</b>", "！？"],
        "low_information": ["hahaha", "<i>ha</i>haha", "mm", "哈", "哈哈哈", "aaaabbbb", "-好-", "!!\x85", "abababab", "&lt;"],
        None: ["", None, "  ", "<i></i>", "hello", "好的", "3", "haha", "a&amp;b3"],
    }
    rows = [(k, t) for k, texts in kinds.items() for t in texts]
    got = spark.createDataFrame(rows, "want string, t string").select("want", "t", tx.information_kind(F.col("t")).alias("kind")).collect()
    assert [(r.t, r.kind) for r in got] == [(r.t, r.want) for r in got]


def test_recovery_binds_what_its_tests_share(spark):
    """A filter over columns spelled each column out at each of its uses, and looked at texts of any length; a text of marks
    alone was divided by its count of words."""
    word = lambda k, p=0.9: (k * 0.5, k * 0.5 + 0.4, "river", p)
    row = lambda ord, end, text, words, no_speech=0.1: (1, ord, 0.0, end, text, words, no_speech, -0.3, 2.0)
    rows = [
        row(0, 4.0, "river river river river river river walks", [word(k) for k in range(7)]), row(1, 9.0, "river river river", [word(k) for k in range(3)]), row(2, 4.0, "...", [(0.0, 1.0, "...", 0.9)]),
        row(3, 4.0, "river walks", [word(0, 0.1), word(1, 0.1)]), row(4, 4.0, "好", None, 0.5), row(5, 4.0, "river walks along", None), row(6, 4.0, None, None), row(7, 4.0, "!!! ???", None, None),
    ]
    schema = "media_id long, ord long, s double, e double, text string, words array<struct<start:double,end:double,text:string,probability:double>>, no_speech double, logprob double, compression double"
    found = guards.strict_recovery(spark.createDataFrame(rows, schema))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 50
    assert sorted(r.ord for r in found.collect()) == [0, 5]
