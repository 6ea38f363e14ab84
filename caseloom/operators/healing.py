"""Evidence on answer keys, remediation in rounds, and the release of false findings (QA06, QA11, QA12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matcher import Dictionary, annotate
from ..functions.text import comparable

# How an explanation states the letter of its answer; what may follow where it only lists letters.
STATES = (
    r"(?:the\s+)?correct\s+answer\s+is\s+[A-E](?:\s*[:.)-]|\b)",
    r"\banswer\s*[:.]?\s*\(?[A-E]\)?(?:\s*[:.)-]|\b)",
    r"\bans(?:wer)?\.?\s*(?:is|:)?\s*['\"`(]*[A-E]['\"`)]?(?:\s*[:.)-]|\b)",
)
LISTS = r"(?i)^\s*(?:>|<|/|&|,|and\b|or\b)"
STATEMENT = "(?i)(?:" + "|".join(STATES) + ")"
#: Characters behind a statement in which the option's text must begin.
WINDOW = 120
# Weight of the evidence of each confidence.
WEIGHT = {"high": 3, "medium": 2, "low": 1}
# Option texts that say nothing of their own.
GENERIC = ["all", "all of the above", "all are correct", "none", "none of the above", "all correct", "semua benar", "semua salah"]


def _key() -> Column:
    return F.get(F.filter("options", lambda o: o["is_correct"]), F.lit(0))


def stated_option(rationale: Column, options: Column) -> Column:
    """Id of the option whose text follows the first statement of an answer; null without one.

    Of the options (three characters at least) in the window behind a statement
    the one that comes first counts, of two at one place the longer.
    """
    behind = F.regexp_extract_all(F.coalesce(rationale, F.lit("")), F.lit(STATEMENT + rf"(?=([\s\S]{{0,{WINDOW}}}))"), F.lit(1))

    def in_window(window: Column) -> Column:
        said = comparable(F.get(F.split(window, r"[\n;]"), F.lit(0)))
        places = F.transform(options, lambda o, i: F.struct(F.instr(said, comparable(o["text"])).alias("at"), (-F.length(comparable(o["text"]))).alias("n"), i.alias("i"), o["id"].alias("id")))
        return F.array_min(F.filter(places, lambda p: (p["at"] > 0) & (p["n"] <= -3)))["id"]

    found = F.transform(F.filter(behind, lambda w: ~F.substring(w, 1, 12).rlike(LISTS)), in_window)
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def option_fingerprint(options: Column) -> Column:
    """Normal texts of the options, sorted and joined."""
    return F.array_join(F.array_sort(F.filter(F.transform(options, lambda o: comparable(o["text"])), lambda t: t != "")), "|")


def raw_anchors(raw: DataFrame) -> DataFrame:
    """fp, anchor: the one normal answer that all raw rows (fp, answer) of a fingerprint give; ambiguous ones are left out."""
    said = raw.select("fp", comparable("answer").alias("anchor")).where("anchor <> '' and fp <> ''")
    return said.groupBy("fp").agg(F.min("anchor").alias("anchor"), F.max("anchor").alias("_other")).where("anchor = _other").drop("_other")


def key_evidence(cases: DataFrame, anchors: DataFrame, drift: DataFrame) -> DataFrame:
    """case_id, key, method, confidence, target: for each case the evidence of most weight against its key.

    high: the explanation states another option (QA08). medium: the raw source's
    answer is another text (JN03), the target null where no option has it. low:
    the explanation is about something else (QA10; ``drift`` has case_id). Cases
    with fewer than two options or without a key give none.
    """
    rows = cases.where(F.size("options") >= 2).select("case_id", _key().alias("k"), stated_option(F.col("rationale"), F.col("options")).alias("stated"), "options", option_fingerprint(F.col("options")).alias("fp")).where("k is not null")
    text_of = lambda i: comparable(F.get(F.filter("options", lambda o: o["id"] == i), F.lit(0))["text"])
    marks = drift.select("case_id", F.lit(True).alias("drifts")).distinct()
    seen = rows.join(anchors, "fp", "left").join(marks, "case_id", "left")
    fitting = F.get(F.filter("options", lambda o: comparable(o["text"]) == F.col("anchor")), F.lit(0))["id"]
    kind = lambda method, confidence, target: F.struct(F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), target.cast("string").alias("target"))
    key_text = comparable(F.col("k.text"))
    found = (
        F.when(F.col("stated").isNotNull() & (text_of(F.col("stated")) != key_text), kind("stated", "high", F.col("stated")))
        .when(F.col("anchor").isNotNull() & (F.col("anchor") != key_text), kind("anchor", "medium", fitting))
        .when(F.col("drifts"), kind("drift", "low", F.lit(None)))
    )
    return seen.select("case_id", F.col("k.id").alias("key"), found.alias("e")).where("e is not null").select("case_id", "key", "e.*")


def apply_evidence(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """``cases`` with the key at the target where the evidence is high."""
    flips = evidence.where("confidence = 'high' and target is not null").select("case_id", F.col("target").alias("_to"))
    flipped = F.transform("options", lambda o: F.struct(o["id"].alias("id"), o["text"].alias("text"), (o["id"] == F.col("_to")).alias("is_correct")))
    return cases.join(flips, "case_id", "left").withColumn("options", F.when(F.col("_to").isNotNull(), flipped).otherwise(F.col("options"))).select(*cases.columns)


def remediate_keys(cases: DataFrame, anchors: DataFrame, drift: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """QA11: (cases, log, hold): keys flipped by high evidence in rounds until none is left; what medium and low evidence holds.

    log: round, case_id, key, target. hold: case_id, code, method. A second run
    changes nothing, as the last round has found nothing to flip.
    """
    from ..sources.io import ensure_checkpoint_dir

    ensure_checkpoint_dir(cases.sparkSession)
    log, found = None, key_evidence(cases, anchors, drift).checkpoint()
    for turn in range(1, most + 1):
        flips = found.where("confidence = 'high' and target is not null")
        done = flips.select(F.lit(turn).alias("round"), "case_id", "key", "target")
        log = done if log is None else log.unionByName(done)
        if flips.isEmpty():
            break
        cases = apply_evidence(cases, found).checkpoint()
        found = key_evidence(cases, anchors, drift).checkpoint()
    code = F.when(F.col("confidence") == "medium", "A5_CONFLICT").otherwise("A6_DRIFT")
    return cases, log, found.where("confidence <> 'high'").select("case_id", code.alias("code"), "method")


def heal_from_raw(cases: DataFrame, anchors: DataFrame) -> DataFrame:
    """QA12, medium findings: case_id, key, target, action: the raw answer's option, unless the explanation states another."""
    rows = cases.select("case_id", _key()["id"].alias("key"), "options", stated_option(F.col("rationale"), F.col("options")).alias("stated"), option_fingerprint(F.col("options")).alias("fp")).where("key is not null")
    met = rows.join(anchors, "fp").withColumn("by_raw", F.get(F.filter("options", lambda o: comparable(o["text"]) == F.col("anchor")), F.lit(0))["id"]).where("by_raw is not null")
    overrides = F.col("stated").isNotNull() & (F.col("stated") != F.col("by_raw"))
    return met.select("case_id", "key", F.when(overrides, F.col("stated")).otherwise(F.col("by_raw")).alias("target"), F.when(overrides, "explicit_override").otherwise("raw_anchor").alias("action"))


def _stems(text: Column, labels: Column, stop: list[str]) -> Column:
    """Beginnings (three letters) of the words of a text, plurals cut, and of the names found in it; stop words left out."""
    words = F.split(comparable(text), " ")
    single = F.transform(words, lambda w: F.when(w.endswith("ies") & (F.length(w) > 6), F.concat(F.substr(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(w.endswith("s") & (F.length(w) > 6), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    named = F.flatten(F.transform(labels, lambda x: F.split(x, " ")))
    skip = F.array(*[F.lit(w) for w in stop]).cast("array<string>")
    kept = F.filter(F.concat(single, named), lambda w: (F.length(w) >= 4) & ~F.array_contains(skip, w))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, 3)))


def clear_drift(findings: DataFrame, cases: DataFrame, synonyms: dict[str, list[str]], stop: list[str]) -> DataFrame:
    """QA12, low findings: case_id, verdict, reason, prefixes, shared: whether prompt and explanation are about one thing after all.

    ``cases`` has case_id, prompt, rationale, options; ``synonyms`` the ways to
    say a name. Cleared: the right option's text is in the explanation, and an
    answer is stated, a name is shared or a beginning is; or a name and a
    beginning are shared; or four beginnings, and 60 percent, are.
    """
    asked = cases.join(findings.select("case_id").distinct(), "case_id", "left_semi")
    noted = annotate(asked.select("case_id", "prompt", "rationale"), ["case_id"], {"in_prompt": "prompt", "in_rationale": "rationale"}, Dictionary.of(synonyms))
    names = lambda c: F.array_distinct(F.transform(c, lambda x: x["label"]))
    rows = asked.select("case_id", "prompt", "rationale", _key()["text"].alias("answer")).join(noted, "case_id")
    rows = rows.select("case_id", "rationale", "answer", names("in_prompt").alias("p"), names("in_rationale").alias("r"), "prompt")
    rows = rows.select("case_id", "rationale", "answer", "p", "r", _stems(F.col("prompt"), F.col("p"), stop).alias("x"), _stems(F.col("rationale"), F.col("r"), stop).alias("y"))
    loose = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    plain = comparable("answer")
    meaningful = (plain != "") & ~plain.isin(*GENERIC) & ((F.length(plain) >= 4) | plain.contains(" ") | (plain.rlike("[0-9]") & (F.length(plain) >= 3)))
    mentions = F.coalesce(meaningful & (loose(F.col("answer")) != "") & loose(F.col("rationale")).contains(loose(F.col("answer"))), F.lit(False))
    n, shared = F.size("x"), F.size(F.array_intersect("x", "y"))
    same_name = F.size(F.array_intersect("p", "r")) > 0
    cue = F.col("rationale").rlike(STATEMENT)
    reason = (
        F.when(mentions & (cue | same_name | (shared >= 1)), "correct_option_mentioned")
        .when(same_name & (shared >= 1), "synonym_match")
        .when((n >= 4) & (shared >= 4) & (10 * shared >= 6 * n), "stem_overlap")
        .otherwise("true_drift")
    )
    out = rows.select("case_id", reason.alias("reason"), n.alias("prefixes"), shared.alias("shared"))
    return out.select("case_id", F.when(F.col("reason") == "true_drift", "kept").otherwise("cleared").alias("verdict"), "reason", "prefixes", "shared")
