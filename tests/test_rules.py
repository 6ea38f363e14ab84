"""Category rules against plain sets; answer clusters against the greedy loop."""

import random

from caseloom.operators import contradictions, rules
from caseloom.operators.rules import Rule, Suppression

RESOLVED = "case_id long, source string, raw string, resolved string, confidence string, runner_score int"
SIGNALS = "case_id long, signal string, category string, word string"


def test_published_rules(spark):
    rows = [
        (1, "medmcqa", "Bedah", "Bedah", "low", 9), (2, "medmcqa", "Bedah", "Bedah", "low", 10), (3, "medmcqa", "Ilmu Penyakit Dalam", "Bedah", "low", 9),
        (4, "medmcqa", "Bedah", "Mata", "low", 7), (5, "other", "Bedah", "Mata", "low", 7), (6, "medmcqa", "Mata", "Mata", "low", 7), (7, "medmcqa", "Bedah", "Mata", "high", 7),
    ]
    said = {1: "surgery", 2: "surgery", 3: "forensic medicine", 4: "ophthalmology", 5: "ophthalmology", 6: "ophthalmology", 7: "ophthalmology"}
    tags = said | {3: "forensic"}
    signals = [(k, "subject", "x", w) for k, w in said.items()] + [(k, "tags", "x", w) for k, w in tags.items()]
    resolved, found = spark.createDataFrame(rows, RESOLVED), spark.createDataFrame(signals, SIGNALS)
    got = {r.case_id: (r.resolved, r.confidence, r.rule) for r in rules.promote(resolved, rules.case_atoms(found, resolved), rules.published()).collect()}
    assert got[1] == ("Bedah", "high", "medmcqa_surgery_subject_tag_confirm_consensus9")
    assert got[3] == ("Forensik", "high", "medmcqa_forensic_subject_tag_consensus9")
    assert got[4] == ("Mata", "high", "medmcqa_ophthalmology_subject_tag_consensus7")
    assert all(got[k][2] is None for k in (2, 5, 6, 7)) and got[7][1] == "high"


def test_rules_against_sets(spark):
    """More atoms than one mask holds; the first of several rules."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(90)]
    pick = lambda most: tuple(f"keyword={w}" for w in rng.sample(words, rng.randint(0, most)))
    table = [Rule(f"r{k}", rng.choice(["A", "B", None]), rng.randint(0, 9), rng.choice([None, "s1"]), None, ("low", "medium"), pick(1), pick(6), pick(4), rng.choice([None, "C"])) for k in range(60)]
    cases = [(k, rng.choice(["s1", "s2"]), None, rng.choice("AB"), rng.choice(["low", "medium", "high"]), rng.randint(0, 9)) for k in range(200)]
    signals = [(k, "keyword", "A", w) for k in range(199) for w in rng.sample(words, rng.randint(0, 25))]
    resolved, found = spark.createDataFrame(cases, RESOLVED), spark.createDataFrame(signals, SIGNALS)
    got = {r.case_id: (r.resolved, r.rule) for r in rules.promote(resolved, rules.case_atoms(found, resolved), table).collect()}
    named = 0
    for k, source, _, to, confidence, score in cases:
        atoms = {f"keyword={s[3]}" for s in signals if s[0] == k}
        fits = [r for r in table if (r.resolved in (None, to)) and r.source in (None, source) and score <= r.most and confidence in r.confidence and set(r.need) <= atoms and not set(r.never) & atoms and (not r.some or set(r.some) & atoms)]
        assert got[k] == ((fits[0].to or to, fits[0].name) if fits else (to, None))
        named += bool(fits)
    assert 50 < named < 200


def test_suppression_by_context(spark):
    texts = ["Drug-resistant strains", "the drug", "epidemiology of it", None]
    cases = spark.createDataFrame(list(enumerate(texts)), "case_id long, t string")
    rows = [(k, "keyword", "Farmakologi", "drug") for k in range(4)] + [(k, "tags", "Ilmu Kesehatan Masyarakat", "community medicine") for k in range(4)] + [(0, "tags", "Other", "drug")]
    got = {tuple(r)[:3] for r in rules.suppress(spark.createDataFrame(rows, SIGNALS), cases, "t", rules.SUPPRESSIONS, rules.CONTEXTS).collect()}
    assert got == {(1, "keyword", "Farmakologi"), (2, "keyword", "Farmakologi"), (3, "keyword", "Farmakologi"), (2, "tags", "Ilmu Kesehatan Masyarakat"), (0, "tags", "Other")}
    assert rules.suppress(spark.createDataFrame([], SIGNALS), cases, "t", [Suppression("a", "b", "age")], rules.CONTEXTS).count() == 0


def one_edit(a, b):
    cut = lambda x: {x[:k] + x[k + 1 :] for k in range(len(x))}
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return abs(len(a) - len(b)) == 1 and (a in cut(b) or b in cut(a))


def similar(a, b):
    odd = [(x, y) for x, y in zip(a, b) if x != y]
    return len(a) == len(b) >= 2 and len(odd) == 1 and min(map(len, odd[0])) >= 4 and one_edit(*odd[0])


def test_clusters_against_the_greedy_loop(spark):
    rng = random.Random(4)
    stems = ["hepar", "hepat", "zinc", "cord"]

    def slip(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w[:k] + rng.choice("abé") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k + 1 :]])

    rows = [(rng.randint(0, 4), rng.randint(0, 300), k, " ".join(slip(slip(rng.choice(stems))) for _ in range(rng.randint(1, 3)))) for k in range(700)] + [(9, 1, 999, " !")]
    got = {r.component: (r.n_cases, r.n_clusters, r.contradiction) for r in contradictions.answer_clusters(spark.createDataFrame(rows, "component long, pos long, case_id long, answer string")).collect()}
    for c in range(5):
        first, n = {}, 0
        for _, pos, _, answer in [r for r in rows if r[0] == c]:
            first[answer] = min(pos, first.get(answer, pos))
            n += 1
        heads = []
        for answer in sorted(first, key=lambda x: (first[x], x)):
            if not any(similar(h.split(), answer.split()) for h in heads):
                heads.append(answer)
        assert got[c] == (n, len(heads), len(heads) > 1)
    assert 9 not in got
