"""Literal fixtures, group rules, gates, round trips and streams."""

import math

import pytest
from pyspark.sql import functions as F

from caseloom.functions import scoring, text
from caseloom.operators import category, contradictions, dedup, gates, ids, keys, memory, merge, report, review
from caseloom.sources import io, parse
from caseloom.streaming import telemetry

OPTIONS = "array<struct<id:string,text:string,is_correct:boolean>>"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Lombard&;s test", "Lombard's test"),
        ("doesn&;t", "doesn't"),
        ("Temperature 38&deg;C", "Temperature 38°C"),
        ("[RESTORED SOURCE] <p>Line one</p><p>Line two</p>", "Line one\n\nLine two"),
        ("3&;-UTR", "3'-UTR"),
        ("Harrison&;&;s principle", "Harrison's principle"),
        ("quoted &;family size&;(", 'quoted "family size"('),
        ("tail</p.", "tail"),
    ],
)
def test_display_text(spark, given, expected):
    assert one(spark, given, text.display_text) == expected


def test_text_functions(spark):
    assert one(spark, "  a \t b\r\n\r\n\r\n c ﻿", text.norm_ws) == "a b\n\n c"
    assert one(spark, "Ünï-code, ÄB!", text.comparable) == "ünï code äb"
    assert one(spark, "A 45-year-old man", text.age) == 45
    assert one(spark, "Text here. What is it? Then more.", text.extract_prompt) == "What is it?"
    assert one(spark, "donâ€™t", text.fix_mojibake) == "don't"
    assert one(spark, "needs-review|x|17", text.parse_custom_id) == "17"
    assert one(spark, "run-008", text.parse_custom_id) == "008"
    assert one(spark, "a <b>c</b>&nbsp;d", text.strip_html) == "a c d"
    assert one(spark, None, text.comparable) == ""


def case(i, question, options, key=0, source="s", exam="BOTH", confidence=3.0, rationale="", pos=None):
    made = [("ABCDE"[k], t, k == key) for k, t in enumerate(options)]
    return (i, i if pos is None else pos, source, exam, question, question, confidence, rationale, 50.0, False, False, False, "OK", made, "en")


CASE = f"case_id long, pos long, source string, exam_type string, question string, narrative string, confidence double, rationale string, score double, quarantined boolean, needs_review boolean, truncated boolean, status string, options {OPTIONS}, category string"
STEM = "Elderly woman presents breathless following myocardial infarction yesterday"


def test_golden_merge(spark):
    opts = ["aspirin tablets", "heparin infusion"]
    rows = [
        case(1, STEM, opts, source="s1", exam="A", confidence=3.0),
        case(2, STEM, opts, source="s2", exam="B", confidence=4.0),
        case(3, STEM, opts, source="s3", exam="BOTH", confidence=3.0, rationale="a long enough explanation"),
        case(4, STEM, opts, source="s4", exam="A", confidence=None),
        case(5, "short", opts),
    ]
    golden, redirects = merge.golden_merge(spark.createDataFrame(rows, CASE))
    got = {r.case_id: r for r in golden.collect()}
    assert sorted(got) == [1, 2, 5]  # B stays apart where A and B both occur; ties go by input order
    assert got[1].merged_sources == ["s1", "s3", "s4"] and math.isclose(got[1].confidence, 3.3) and got[1].is_high_yield
    assert got[1].rationale == "a long enough explanation" and got[2].confidence == 4.0
    assert {(r.absorbed_id, r.host_id) for r in redirects.collect()} == {(3, 1), (4, 1)}


def test_cross_source_states(spark):
    rows = [case(k, q, ["x", "y"], source=s) for k, q, s in [(1, "Same stem", "a"), (2, "same  STEM.", "b"), (3, "Other", "a"), (4, "Other", "b"), (5, "Lone", "a"), (6, "Gap", "a"), (7, "Gap", "b")]]
    answers = spark.createDataFrame([(1, "Yes"), (2, "yes!"), (3, "p"), (4, "q"), (5, "z"), (6, "z")], "case_id long, answer string")
    got = {r.case_id: r.state for r in dedup.cross_source_dedup(spark.createDataFrame(rows, CASE), answers).collect()}
    assert got == {1: "duplicate", 2: "canonical", 3: "conflict", 4: "conflict", 6: "conflict", 7: "conflict"}
    ranked = dedup.cross_source_dedup(spark.createDataFrame(rows, CASE), answers, {"a": 5}).where("state = 'canonical'").collect()
    assert [r.case_id for r in ranked] == [1]


def test_contradiction_chain(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 8), (8, 7), (7, 10)], "a long, b long")
    got = {r.case_id: r.component for r in contradictions.connected(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7, 10: 7}
    members = spark.createDataFrame(
        [(1, 1, 1, "acute appendicitis"), (1, 2, 2, "acute apendicitis"), (1, 3, 3, "Acute Appendicitis"), (2, 4, 4, "left side"), (2, 5, 5, "right side")],
        "component long, pos long, case_id long, answer string",
    )
    got = {r.component: (r.n_cases, r.n_clusters, r.contradiction) for r in contradictions.answer_clusters(members).collect()}
    assert got == {1: (3, 1, False), 2: (2, 2, True)}


def test_option_dedup(spark):
    rows = [case(1, "q", ["a", "A", "b"], key=1), case(2, "q", ["a", "A"], key=0), case(3, "q", ["x", "y", "X!"], key=2)]
    got = {r.case_id: [(o["id"], o["is_correct"]) for o in r.options] for r in dedup.dedupe_options(spark.createDataFrame(rows, CASE)).collect()}
    assert got == {1: [("B", True), ("C", False)], 2: [("A", True), ("B", False)], 3: [("B", False), ("C", True)]}


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, (k * 7) % 5) for k in range(200)], "i long, g long")
    for parts in (1, 16):
        got = {(r.g, r.i): r.n for r in ids.dense_numbers(df.repartition(parts), ["i"], "n", ["g"]).collect()}
        for g in range(5):
            assert [got[g, i] for i in range(200) if (i * 7) % 5 == g] == list(range(1, 41))


def test_key_base(spark):
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "cop int")
    assert parse.detect_key_base(frame(0, 1, 3)) == 0 and parse.detect_key_base(frame(1, 2, 4)) == 1
    for bad in ((0, 4), (1, 2, 3)):
        with pytest.raises(ValueError):
            parse.detect_key_base(frame(*bad))


def test_parsers(spark):
    rows = spark.createDataFrame(
        [("m1", "Which?", {"A": "one", "B": "two", "C": ""}, "b", None), ("m2", "Which?", {"A": "one", "B": "two"}, None, "TWO.")], "case_key string, question string, options map<string,string>, answer_idx string, answer string"
    )
    got = parse.union_sources(parse.parse_map_mcq(rows)).collect()
    assert [[(o["id"], o["is_correct"]) for o in r.options] for r in got] == [[("A", False), ("B", True)]] * 2
    listed = spark.createDataFrame([("l", "q", ["x", "y"], None)], "case_key string, question string, answers array<string>, ra int")
    assert parse.parse_list_mcq(listed).first().options[0]["is_correct"]
    ynm = spark.createDataFrame([("y", "q", ["c1", "c2"], "maybe")], "case_key string, question string, contexts array<string>, final_decision string")
    r = parse.parse_ynm(ynm).first()
    assert r.narrative == "c1 c2" and [o["is_correct"] for o in r.options] == [False, False, True]
    block = "1. First question?\nA. alpha\nB. beta\nJawaban: B\n2) Second\nmore text\nA. x\nB. y\nC. z\n2. C\n"
    got = {r.number: r for r in parse.parse_text_blocks(spark.createDataFrame([("f", block)], "file string, text string")).collect()}
    assert got[1].question == "First question?" and [o["id"] for o in got[1].options if o["is_correct"]] == ["B"]
    assert got[2].question == "Second\nmore text" and got[2].key == "C"
    anchored = spark.createDataFrame([("Heparin!", [("A", "aspirin", True), ("B", "heparin", False)])], f"anchor string, options {OPTIONS}")
    assert [o["is_correct"] for o in parse.align_anchor(anchored).first().options] == [False, True]
    lead = spark.createDataFrame([("The correct answer is A. Because", "C"), ("no lead", "C")], "t string, k string").select(parse.rewrite_answer_lead(F.col("t"), F.col("k")).alias("x")).collect()
    assert [r.x for r in lead] == ["The correct answer is C. Because", "no lead"]


def test_schema_gate(spark):
    frame = spark.createDataFrame([(k,) for k in range(10)], "i int")
    valid, rejects = io.schema_gate(frame, {"big": F.col("i") >= 2})
    assert valid.count() == 8 and [r.reasons for r in rejects.collect()] == [["big"], ["big"]]
    with pytest.raises(io.TooManyRejects):
        io.schema_gate(frame, {"big": F.col("i") >= 3})


def test_relational_round_trip_and_snapshot(spark, tmp_path):
    frame = spark.createDataFrame([case(1, "q", ["b", "a", "c"], key=2), case(2, "none", [])], CASE)
    back = io.from_relational(*io.to_relational(frame, 7)).select(*frame.columns)
    assert io.parity(frame, back).first().asDict() == {"equal": 2, "different": 0, "only_a": 0, "only_b": 0}
    io.write_request_pack(frame.select("case_id", "question"), f"{tmp_path}/packs", 1, ["case_id"])
    assert spark.read.text(f"{tmp_path}/packs").count() == 2
    chunks = io.write_chunks(spark.range(25).select(F.col("id").alias("case_id")), f"{tmp_path}/chunks", ["case_id"], 10)
    assert sorted((r.chunk, r.n_rows) for r in chunks.collect()) == [(1, 10), (2, 10), (3, 5)]
    assert [r.case_id for r in spark.read.json(f"{tmp_path}/chunks/chunk=2").collect()] == list(range(10, 20))


def test_verdicts(spark):
    rows = [(1, "a", "HIGH", "f2"), (1, "A", "HIGH", "f1"), (2, "A", "HIGH", "f1"), (2, "B", "HIGH", "f1"), (3, "A", "MEDIUM", "f1")]
    got = {r.case_id: (r.action, r.option, r.file) for r in review.merge_verdicts(spark.createDataFrame(rows, "case_id long, option string, confidence string, file string")).collect()}
    assert got == {1: ("apply", "A", "f1"), 2: ("conflict", None, None), 3: ("keep_review", None, None)}


def test_option_resolution(spark):
    options = [("a1", "first", False), ("b2", "second", True), ("c3", "third", False), ("d4", "fourth", False)]
    said = ["b2", "opd", "D", "3", "Second!", "zz"]
    frame = spark.createDataFrame([(s, options) for s in said], f"s string, options {OPTIONS}")
    got = [r.x for r in frame.select("s", scoring.resolve_option(F.col("options"), F.col("s")).alias("x")).collect()]
    assert got == ["b2", "d4", "d4", "c3", "b2", None]


def test_heal_keys(spark):
    options = spark.createDataFrame([(1, "A", "x", True, 1), (1, "B", "y", False, 2), (2, "A", "p", True, 1), (2, "B", "q", False, 2)], "case_id long, option_id string, option_text string, is_correct boolean, slot long")
    bank = keys.fingerprints(options)
    fps = {r.case_id: r.fp for r in bank.collect()}
    raw = spark.createDataFrame([(None, fps[1], "Y", 1), (None, fps[2], "p", 2), (None, fps[2], "q", 3)], "case_id long, fp string, answer string, pos long")
    got = {r.case_id: (r.action, r.new_key) for r in keys.heal_keys(bank, options, raw).collect()}
    assert got == {1: ("heal", "B"), 2: ("ambiguous", None)}


def test_memory_fold_matches_a_loop(spark):
    w = scoring.MEMORY_W
    log = [("u", 1, float(t), k, g) for k, (t, g) in enumerate([(1_000_000, 3), (1_200_000, 1), (1_500_000, 3)])] + [("u", 2, 5.0, 9, 7)]
    frame = spark.createDataFrame(log, "user_hash string, case_id long, at double, seq long, grade int").withColumn("ts", F.col("at").cast("timestamp"))
    d = s = last = lapses = 0
    for _, _, t, _, g in log[:3]:
        if not last:
            s, d = w[g - 1], min(10, max(1, w[4] - (g - 3) * w[5]))
        else:
            r = (1 + scoring.FACTOR * (t - last) / 86400 / s) ** scoring.DECAY
            d = min(10, max(1, d - w[6] * w[7] * (g - 3)))
            if g >= 3:
                s *= 1 + math.exp(w[8]) * (11 - d) * s ** -w[9] * (math.exp(w[10] * (1 - r)) - 1)
            else:
                s, lapses = max(0.1, w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * math.exp(w[14] * (1 - r))), lapses + 1
        last = t
    (got,) = memory.fold_reviews(frame).collect()
    assert math.isclose(got.difficulty, d) and math.isclose(got.stability, s) and (got.lapses, got.last_review, got.reviews) == (lapses, last, 3)


def test_category_resolution(spark):
    rows = [case(1, STEM, []), case(2, "plain", [])]
    frame = spark.createDataFrame(rows, CASE).withColumn("category", F.lit(None).cast("string"))
    hits = category.match_keywords(frame, {"narrative": "narrative", "keyword": "question"}, {"Heart": ["myocardial infarction"], "Lung": ["breathless"]})
    assert {(r.case_id, r.signal, r.word) for r in hits.collect()} == {(1, s, w) for s in ("narrative", "keyword") for w in ("myocardial infarction", "breathless")}
    got = {r.case_id: (r.resolved, r.score, r.confidence) for r in category.resolve_category(frame, hits.where("category = 'Heart'")).collect()}
    assert got == {1: ("Heart", 5, "high"), 2: ("Unclassified", 0, "low")}


def test_gates(spark):
    rows = [(k, 1, "u", t) for k, t in enumerate((1499, 1500, 3_600_000, 3_600_001))]
    frame = spark.createDataFrame(rows, "event_id long, case_id long, user_hash string, time_ms long")
    assert sorted(r.event_id for r in report.telemetry_gate(frame).collect()) == [1, 2]
    sent = spark.createDataFrame([(1, ["unclear", "x"], '<a href="q">', "u"), (2, ["x"], "", "u")], "case_id long, tags array<string>, comment string, user_hash string")
    (kept,) = gates.feedback_gate(sent).collect()
    assert kept.tags == ["unclear"] and kept.comment == "&lt;a href=&quot;q&quot;&gt;"


def test_result_lines(spark):
    lines = [
        ('{"custom_id":"a|b|1","response":{"body":{"choices":[{"message":{"content":"```json\\n{\\"_id\\":\\"1\\",\\"correct_option_id\\":\\"A\\",\\"confidence\\":\\"high\\"}\\n```"}}]}}}', ""),
        ('{"custom_id":"a|b|2","response":{"body":{"output_text":"text {\\"_id\\":\\"2\\",\\"correct_option_id\\":\\"B\\",\\"confidence\\":\\"odd\\"} more"}}}', "bad_confidence"),
        ('{"custom_id":"a|b|3","response":{"body":{"output_text":""}}}', "empty_content"),
        ('{"custom_id":"a|b|4","response":{"body":{"output_text":"nothing"}}}', "bad_json"),
        ("not json", "bad_line"),
    ]
    got = io.parse_results(spark.createDataFrame([(v, "f") for v, _ in lines], "value string, file string")).collect()
    assert [r.error for r in got] == [e for _, e in lines] and got[0].option == "A"


def test_first_answers_stream(spark, tmp_path):
    schema = "event_id long, case_id long, user_hash string, is_correct boolean, time_ms long, ts timestamp"
    rows = [(k, k % 4, f"u{k % 3}", k % 2 == 0, 1000 + 600 * k) for k in range(40)]
    frame = spark.createDataFrame(rows, "event_id long, case_id long, user_hash string, is_correct boolean, time_ms long").withColumn("ts", (F.col("event_id") + 1000).cast("timestamp"))
    for part in range(2):
        frame.where(f"event_id div 20 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = telemetry.keep_first_answers(telemetry.read_events(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/out", f"{tmp_path}/cp")
        query.awaitTermination()
    again = telemetry.keep_first_answers(telemetry.read_events(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/cp")
    again.awaitTermination()  # nothing new: nothing changes
    got = sorted((r.case_id, r.user_hash, r.event_id) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").collect())
    assert got == sorted((r.case_id, r.user_hash, r.event_id) for r in report.first_answers(frame).collect())


def test_result_stream_reads_a_file_once(spark, tmp_path):
    line = '{"custom_id":"a|b|1","response":{"body":{"output_text":"{\\"_id\\":\\"1\\",\\"correct_option_id\\":\\"A\\",\\"confidence\\":\\"HIGH\\"}"}}}'
    for k in range(2):
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
        for _ in range(2):
            telemetry.results_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == k + 1
