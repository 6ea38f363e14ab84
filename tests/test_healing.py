"""The automaton against plain search; denials against a regular expression; remediation that ends."""

import random
import re

import pytest
from pyspark.sql import functions as F

from caseloom.functions import matcher
from caseloom.operators import audit, healing

OPTIONS = "array<struct<id:string,text:string,is_correct:boolean>>"
CASE = f"case_id long, prompt string, rationale string, options {OPTIONS}"


def opts(texts, key):
    return [("ABCDE"[k], t, k == key) for k, t in enumerate(texts)]


def test_automaton_against_plain_search(spark):
    rng = random.Random(1)
    letters = ["a", "b", "ab", "ba", "aab", "b7", "ä"]
    words = {f"L{k}": [" ".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(12)] for k in range(4)}
    beginnings = {w for ws in words.values() for w in ws[:3]}
    texts = [None, "", "  ", "A, b-AB!"] + [" ".join(rng.choice([*letters, "abba", "x"]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "case_id long, t string").repartition(3)
    got = sorted(map(tuple, matcher.matches(frame, {"s": "t"}, matcher.Dictionary.of(words, beginnings)).collect()))
    want = set()
    for k, text in enumerate(texts):
        normal = " ".join(re.findall(r"[^\W_]+", (text or "").lower()))
        for label, ws in words.items():
            want |= {(k, "s", label, w) for w in ws if re.search(f"(?:^| ){re.escape(w)}{'' if w in beginnings else '(?: |$)'}", normal)}
    assert got == sorted(want) and len(got) > 300


def test_no_dictionary_and_too_much_of_it(spark):
    frame = spark.createDataFrame([(1, "a b")], "case_id long, t string")
    assert matcher.matches(frame, {"s": "t"}, matcher.Dictionary.of({})).count() == 0
    with pytest.raises(ValueError):
        matcher.Dictionary.of({"a": ["x" * (matcher.MOST_CHARS + 1)]})


@pytest.mark.parametrize("word", ["fever", "wrong"])
def test_denials_against_a_pattern(spark, word):
    after, before = audit.DENIED_AFTER, audit.DENIED_BEFORE
    pattern = re.compile(rf"\b{word}\b.{{0,15}}{after}|{before}.{{0,15}}\b{word}\b", re.A)
    rng = random.Random(2)
    pieces = ["fever", "fevers", "xfever", "is wrong", "is ruled out", "not the correct", "wrong answer is", " ", " ", "\n", "_", ", ", "abcdefgh", "fever is", "is false"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts += [f"fever{' ' * k}is wrong" for k in range(20)] + [f"not the correct{' ' * k}fever" for k in range(20)] + [f"not the correct{'-' * k}feverish fever" for k in range(20)]
    got = [r.d for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", audit.denied(F.col("t"), F.lit(word)).alias("d")).orderBy("k").collect()]
    want = [bool(pattern.search(t)) for t in texts]
    assert got == want and 100 < sum(want) < len(want) - 150


def test_keys_are_flipped_until_nothing_is_left(spark):
    rows = [
        (1, "p", "The correct answer is B: heparin, since", opts(["aspirin", "heparin"], 0)),
        (2, "p", "The correct answer is B: heparin, since", opts(["aspirin", "heparin"], 1)),
        (3, "p", "nothing", opts(["iron", "zinc"], 0)),
        (4, "p", "Answer: A, B and C are listed; answer is (B) zinc", opts(["iron", "zinc"], 0)),
        (5, None, None, opts(["iron"], 0)),
        (6, "p", "The correct answer is B: heparin", opts(["aspirin", "heparin"], None)),
        (7, "p", "off", opts(["a1", "b2"], 0)),
    ]
    cases = spark.createDataFrame(rows, CASE)
    raw = spark.createDataFrame([("iron|zinc", "zinc"), ("iron|zinc", "Zinc!"), ("aspirin|heparin", "aspirin"), ("aspirin|heparin", "heparin"), ("a1|b2", "gone")], "fp string, answer string")
    drift = spark.createDataFrame([(7,)], "case_id long")
    anchors = healing.raw_anchors(raw)
    found = {r.case_id: (r.method, r.target) for r in healing.key_evidence(cases, anchors, drift).collect()}
    assert found == {1: ("stated", "B"), 3: ("anchor", "B"), 4: ("stated", "B"), 7: ("anchor", None)}
    after, log, hold = healing.remediate_keys(cases, anchors, drift)
    assert sorted((r.case_id, r.key, r.target) for r in log.collect()) == [(1, "A", "B"), (4, "A", "B")]
    assert {r.case_id: [o.id for o in r.options if o.is_correct] for r in after.collect()} == {1: ["B"], 2: ["B"], 3: ["A"], 4: ["B"], 5: ["A"], 6: [], 7: ["A"]}
    assert {r.case_id: r.code for r in hold.collect()} == {3: "A5_CONFLICT", 7: "A5_CONFLICT"}
    again, log, _ = healing.remediate_keys(after, anchors, drift)
    assert log.count() == 0 and sorted(map(str, again.collect())) == sorted(map(str, after.collect()))
    assert {r.case_id: (r.target, r.action) for r in healing.heal_from_raw(cases, anchors).collect()} == {3: ("B", "raw_anchor"), 4: ("B", "raw_anchor")}
