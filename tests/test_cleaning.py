"""Literal cases for cleaning, rationales and repairs."""

import pytest
from pyspark.sql import functions as F

from caseloom.functions import clean
from caseloom.operators import quality, rationale

OPTIONS = "array<struct<id:string,text:string,is_correct:boolean>>"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, given, expected",
    [
        (clean.clean_explanation, "Ans: A. Because it is. (pg no. 12) [Image 3]\nRef: book 5th ed", "Because it is."),
        (clean.clean_narrative, "Page 3 of 9\nA man with-\npain\n----\nEnd", "A man with pain\n\nEnd"),
        (clean.canonical_units, "5 MG / dl, 80 mm hg, 2 iu/L", "5 mg/dL, 80 mmHg, 2 IU/L"),
        (clean.image_type, "See the radiograph in this picture", "xray"),
        (clean.image_type, "nothing", None),
        (clean.decode_entities, "a &#233; &#x41; &amp;", "a é A &"),
    ],
)
def test_cleaning(spark, f, given, expected):
    assert one(spark, given, f) == expected


def test_option_normal_forms(spark):
    rows = [([("A", "A. ASPIRIN", True), ("B", " b) HEPARIN", False)],), ([("A", "(A) one", True), ("B", "", False)],), ([("A", "x", True), ("B", "All of the above", False)],)]
    frame = spark.createDataFrame(rows, f"options {OPTIONS}").select(clean.normalize_options(F.col("options")).alias("o"))
    got = frame.select("o", clean.option_review_reason(F.col("o")).alias("r")).collect()
    assert [o["text"] for o in got[1].o] == ["one", ""] and [r.r for r in got] == [None, "empty_option", "above_option"]
    assert got[0].o[0]["text"] == "ASPIRIN"  # the other option keeps its mark, so the set is not all capitals


def test_distractor_repair(spark):
    frame = spark.createDataFrame([({"A": "1", "B": "2", "D": "4"},), ({"A": "1", "D": "4"},)], "m map<string,string>")
    got = [r.x for r in frame.select(clean.repair_distractors(F.col("m"), F.lit("D"), F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("x")).collect()]
    assert got == [{"A": "1", "B": "2", "C": "4"}, {"A": "1", "D": "4"}]


def test_wall_of_text(spark):
    wall = "Intro (A) first explanation here (B) short (C) third explanation here (A) again explained"
    assert one(spark, wall, rationale.split_wall) == {"A": "first explanation here", "C": "third explanation here"}
    assert one(spark, "no marks", rationale.split_wall) == {}
    assert one(spark, "Option B: wrong because of this. Option D: right because of that.", rationale.split_wall) == {"B": "wrong because of this.", "D": "right because of that."}


def test_named_answers_and_keys(spark):
    options = [("A", "x", True), ("B", "y", False)]
    rows = [(1, "Answer: B. Later the correct answer is (B)", options), (2, "The answer is A", options), (3, "answer: A, or rather answer: B", options), (4, None, options)]
    frame = spark.createDataFrame(rows, f"case_id long, rationale string, options {OPTIONS}")
    named = rationale.rationale_answers(frame)
    assert {r.case_id: (r.named, r.several) for r in named.collect()} == {1: ("B", False), 2: ("A", False), 3: ("B", True)}
    assert {r.case_id: r.action for r in quality.fix_keys(frame, named).collect()} == {1: "flip", 3: "hold"}


def test_except_trap_and_wrong_explained(spark):
    options = [("A", "heparin infusion", True), ("B", "aspirin tablets", False)]
    rows = [(1, "All are true EXCEPT", "Here heparin infusion is true in most.", options), (2, "Which?", "aspirin aspirin tablets work", options)]
    frame = spark.createDataFrame(rows, f"case_id long, question string, rationale string, options {OPTIONS}")
    assert [r.case_id for r in rationale.except_trap(frame).collect()] == [1]
    assert [r.case_id for r in rationale.wrong_explained(frame).collect()] == [2]
    answers = spark.createDataFrame([(1, "cardiac arrest"), (2, "heparin")], "case_id long, answer string")
    variants = spark.createDataFrame([("heparin", "aspirin")], "token string, variant string")
    assert [r.case_id for r in rationale.dissonance(frame, answers, variants).collect()] == [1]
