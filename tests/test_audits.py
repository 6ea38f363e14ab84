"""The wide audits on single cases that are to have, and not to have, what they look for; empty banks."""

from caseloom.operators import checks
from caseloom.operators import full_audit as fa

OPTIONS = "array<struct<id:string,text:string,is_correct:boolean,votes:int>>"
RICH = (
    f"case_id long, source string, q_type string, hash_id string, question string, prompt string, narrative string, title string, category string, exam_type string, hypothesis string, rationale string, images array<string>, "
    f"options {OPTIONS}, distractors map<string,string>, do_not_shuffle boolean"
)
SOUND = dict(
    source="s", q_type="MCQ", hash_id=None, question="Which drug helps best here?", prompt="Which drug helps best here?", narrative="A long story of a patient who came to see us one day.", title="Drug", category="surgery", exam_type="USMLE", hypothesis=None,
    rationale="Because the heart needs it, as many studies of it have shown.", images=None, options=[("A", "aspirin", True, 0), ("B", "heparin", False, 0)], distractors={"B": "no"}, do_not_shuffle=False,
)


def bank(spark, *changes):
    return spark.createDataFrame([tuple({"case_id": k, **SOUND, **c}[n] for n in ("case_id", *SOUND)) for k, c in enumerate(changes)], RICH)


def codes(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.case_id, set()).add(r.code)
    return out


def test_full_audit(spark):
    names = spark.createDataFrame([("there.png",)], "name string")
    cases = bank(
        spark, {}, {"rationale": "The correct answer is (B), as all know well."}, {"rationale": 'answer: "heparin" and nothing else'}, {"rationale": "we know that heparin is the best answer of all"},
        {"images": ["./images/cases/there.png", "data:x", "https://a/b.png"]}, {"images": ["x\\gone.png"]}, {"question": None, "prompt": " ", "narrative": ""}, {"question": "Which is FALSE except?", "rationale": "for us aspirin is recommended in such cases"},
        {"question": "Which is FALSE except?", "rationale": "for us aspirin is never recommended in such cases"}, {"q_type": "SCT", "options": [(x, x, False, 3) for x in fa.PANEL_LABELS]}, {"source": "pubmedqa", "question": "Is it so in this other study of ours?", "options": [("A", "yes", True, 0), ("B", "No", False, 0), ("C", "maybe", False, 0)]},
    )
    got = codes(fa.full_audit(cases, names))
    contradicts = {k for k, v in got.items() if "rationale_contradicts_answer" in v}
    assert contradicts == {1, 2, 3}
    assert {k for k, v in got.items() if "broken_image" in v} == {5}
    assert {k for k, v in got.items() if "except_logic_suspect" in v} == {7}
    assert "no_question_text" in got[6] and 0 not in got
    assert not {"sct_missing_votes", "sct_wrong_option_count", "pubmedqa_incomplete"} & (got.get(9, set()) | got.get(10, set()))


def test_watchman_and_layer_a(spark):
    cases = bank(
        spark, {}, {"narrative": "Her blood sugar was 12 then"}, {"narrative": "Her blood sugar was 12 mmol/l then"}, {"narrative": "Her blood sugar was 120 then"}, {"options": [("A", "all of the above", True, 0), ("B", "x", False, 0)]},
        {"options": [("A", "all of the above", True, 0), ("B", "x", False, 0)], "do_not_shuffle": True}, {"rationale": "on rofecoxib by JNC  7"}, {"hash_id": "h"}, {"hash_id": "h", "images": ["a"], "prompt": "see the radiograph?"}, {"prompt": "see the radiograph?"}, {"narrative": "", "prompt": "an answer of"},
    )
    watch = codes(fa.screening(cases))
    assert {k for k, v in watch.items() if "unitless_glucose" in v} == {1}
    assert watch[4] >= {"shuffle_poison"} and watch[5] >= {"kept_in_order"} and "shuffle_poison" not in watch[5]
    assert watch[6] >= {"withdrawn_drug", "outdated_guideline"} and 0 not in watch
    layer = codes(fa.audit_structure(cases))
    assert {k for k, v in layer.items() if "duplicate_hash" in v} == {7, 8} and {k for k, v in layer.items() if "phantom_image" in v} == {9}
    assert layer[10] == {"trailing_stop_word", "no_terminal"} and 0 not in layer


def test_empty_banks(spark):
    none = bank(spark, {}).where("false")
    assert fa.full_audit(none, spark.createDataFrame([], "name string")).count() == fa.deep_audit(none).count() == fa.screening(none).count() == fa.audit_structure(none).count() == 0
    assert checks.psychometrics(none).first().cases == 0 and checks.quarantine_reason(none).count() == 0
    rules = checks.publish_checks(none.selectExpr("*", "'c' as case_code"), spark.createDataFrame([], "id string")).collect()
    assert len(rules) == 14 and all(r.passed for r in rules)
    raw = spark.createDataFrame([], "fp string, key string, pos long")
    assert all(r.n == 0 for r in checks.smoke_layers(none.selectExpr("*", "true as antidote", "true as needs_regen", "true as regenerated"), raw, "s").collect())


def test_localization(spark):
    cases = bank(
        spark, {"narrative": "She has malaria now", "rationale": "give quinine"}, {"narrative": "She has malaria now", "rationale": "give quinine with DHP"}, {"narrative": "She has malaria now", "rationale": "give quinine", "exam_type": "UKMPPD"},
        {"narrative": "An ectopic  pregnancy", "prompt": "Which is the next step?", "options": [("A", "surgery at once", True, 0), ("B", "x", False, 0)]}, {"narrative": "An ectopic pregnancy", "prompt": "Why is it so?", "options": [("A", "surgery at once", True, 0), ("B", "x", False, 0)]},
    )
    assert codes(fa.localization(cases)) == {0: {"MALARIA_TX"}, 3: {"refer_not_operate"}}
