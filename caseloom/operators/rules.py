"""Promotion and suppression of categories by rule tables (SC02, SC03).

What a case's signals say is a set of atoms: ``signal=word`` for each word that
a signal found, ``signal=*`` for any, ``consensus=*`` where two signals of
content agree on the resolved category. The atoms that rules ask for get bits;
a case's atoms are one mask, a rule has masks of the bits it needs, may choose
from and must not meet. All rules are then one broadcast join, and the first in
order names the outcome.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matcher import Dictionary, annotate
from .category import CONTENT

BITS = 62


@dataclass(frozen=True)
class Rule:
    """A case of ``source``, with raw category ``raw``, resolved as ``resolved``; None stands for any.

    It holds where the runner-up has ``most`` points at most, the confidence is
    one of ``confidence``, and the atoms fit. ``to`` replaces the category.
    """

    name: str
    resolved: str | None
    most: int
    source: str | None = None
    raw: str | None = None
    confidence: tuple[str, ...] = ("low",)
    need: tuple[str, ...] = ()
    some: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    to: str | None = None


@dataclass(frozen=True)
class Suppression:
    """A signal's word says nothing of ``category`` where the case's context has (or, with ``without``, lacks) an entry of list ``context``."""

    category: str
    word: str
    context: str
    signal: str | None = None
    without: bool = False


# Published rules on subject and tag that agree: category, subject, tag, highest runner-up score, name.
SUBJECT_AND_TAG = [
    ("Forensik", "forensic medicine", "forensic", 9, "medmcqa_forensic_subject_tag_consensus9"),
    ("Farmakologi", "pharmacology", "pharmacology", 9, "medmcqa_pharmacology_subject_tag_consensus9"),
    ("Biokimia", "biochemistry", "biochemistry", 11, "medmcqa_biochemistry_subject_tag_consensus11"),
    ("Radiologi", "radiology", "radiology", 9, "medmcqa_radiology_subject_tag_consensus9"),
    ("Anestesi & Emergency Medicine", "anaesthesia", "anaesthesia", 7, "medmcqa_anaesthesia_subject_tag_consensus7"),
    ("Mata", "ophthalmology", "ophthalmology", 7, "medmcqa_ophthalmology_subject_tag_consensus7"),
    ("Ilmu Kesehatan Masyarakat", "social preventive medicine", "social preventive medicine", 7, "medmcqa_public_health_subject_tag_consensus7"),
    ("Kedokteran Gigi", "dental", "dental", 12, "medmcqa_dental_subject_tag_consensus12"),
]
# Raw categories that are too broad to stand against them.
BROAD = ("Ilmu Penyakit Dalam", "Bedah")
# The same where raw and resolved category are one already.
CONFIRMED = [
    ("Bedah", "surgery", "surgery", 9, "medmcqa_surgery_subject_tag_confirm_consensus9"),
    ("Ilmu Kesehatan Anak", "pediatrics", "pediatrics", 10, "medmcqa_pediatrics_subject_tag_confirm_consensus10"),
    ("Psikiatri", "psychiatry", "psychiatry", 9, "medmcqa_psychiatry_subject_tag_confirm_consensus9"),
]
# Contexts in which words mislead, and those that a tag needs.
CONTEXTS = {
    "drug resistance": ["drug resistant", "drug resistance", "multi drug resistant", "multi drug resistance"],
    "other sinus": ["cavernous sinus", "carotid sinus", "coronary sinus", "endodermal sinus"],
    "age": ["year old", "y ear old"],
    "other plaque": ["atherosclerotic plaque", "fibroblast plaque"],
    "public health": ["epidemiology", "prevalence", "public health", "biostatistics", "surveillance", "health promotion", "outbreak", "prevention"],
}
SUPPRESSIONS = [
    Suppression("Farmakologi", "drug", "drug resistance"),
    Suppression("Kedokteran Gigi", "plaque", "other plaque"),
    Suppression("THT", "sinus", "other sinus"),
    Suppression("THT", "ear", "age"),
    Suppression("Ilmu Kesehatan Masyarakat", "community medicine", "public health", signal="tags", without=True),
]


def published(source: str = "medmcqa") -> list[Rule]:
    """The table-shaped published rules in their order: those that confirm a category, then those that put another for a broad one."""
    need = lambda subject, tag: (f"subject={subject}", f"tags={tag}")
    confirm = [Rule(name, c, most, source, c, need=need(s, t)) for c, s, t, most, name in CONFIRMED]
    return confirm + [Rule(name, None, most, source, raw, need=need(s, t), to=c) for raw in BROAD for c, s, t, most, name in SUBJECT_AND_TAG]


def suppress(signals: DataFrame, cases: DataFrame, context: str, suppressions: list[Suppression], contexts: dict[str, list[str]]) -> DataFrame:
    """SC02: ``signals`` (case_id, signal, category, word) without those that their case's text (column ``context``) makes misleading.

    All lists are found in one pass over the text; a case without signals is not read further.
    """
    noted = annotate(cases.join(signals.select("case_id").distinct(), "case_id", "left_semi"), ["case_id"], {"_found": context}, Dictionary.of(contexts))
    labels = noted.select("case_id", F.array_distinct(F.transform("_found", lambda x: x["label"])).alias("_in"))
    drop = F.lit(False)
    for s in suppressions:
        there = F.array_contains("_in", s.context)
        hit = (F.col("category") == s.category) & (F.col("word") == s.word) & (~there if s.without else there)
        drop = drop | (hit if s.signal is None else hit & (F.col("signal") == s.signal))
    joined = signals.join(labels, "case_id", "left").withColumn("_in", F.coalesce("_in", F.array().cast("array<string>")))
    return joined.where(~F.coalesce(drop, F.lit(False))).select(*signals.columns)


def case_atoms(signals: DataFrame, resolved: DataFrame) -> DataFrame:
    """case_id, atom: distinct atoms of the signals (case_id, signal, category, word) and of consensus on the resolved category."""
    said = signals.select("case_id", F.explode(F.array(F.concat_ws("=", "signal", "word"), F.concat_ws("=", "signal", F.lit("*")))).alias("atom"))
    agree = signals.where(F.col("signal").isin(*CONTENT)).join(resolved.select("case_id", F.col("resolved").alias("category")), ["case_id", "category"])
    agree = agree.groupBy("case_id").agg(F.count_distinct("signal").alias("n")).where("n >= 2").select("case_id", F.lit("consensus=*").alias("atom"))
    return said.unionByName(agree).distinct()


def promote(resolved: DataFrame, atoms: DataFrame, rules: list[Rule]) -> DataFrame:
    """SC03: ``resolved`` (case_id, source, raw, resolved, confidence, runner_score, ...) with the first rule that holds; it lifts confidence to high.

    Rules are few and go with every task; of a case's atoms only those that
    rules ask for are kept, as bits.
    """
    spark = resolved.sparkSession
    asked = sorted({a for r in rules for a in (*r.need, *r.some, *r.never)})
    bit = {a: k for k, a in enumerate(asked)}
    width = max(1, -(-len(asked) // BITS))

    def mask(names: tuple[str, ...]) -> list[int]:
        out = [0] * width
        for a in names:
            out[bit[a] // BITS] |= 1 << bit[a] % BITS
        return out

    table = [(k, r.name, r.resolved, r.source, r.raw, r.most, list(r.confidence), mask(r.need), mask(r.some), mask(r.never), bool(r.some), r.to) for k, r in enumerate(rules)]
    kinds = "_order int, _name string, _resolved string, _source string, _raw string, _most int, _confidence array<string>, _need array<long>, _some array<long>, _never array<long>, _picks boolean, _to string"
    ruled = spark.createDataFrame(table, kinds)
    bits = spark.createDataFrame([(a, k // BITS, 1 << k % BITS) for a, k in bit.items()], "atom string, _word int, _bit long")
    masks = atoms.join(F.broadcast(bits), "atom").groupBy("case_id").agg(*[F.bit_or(F.when(F.col("_word") == w, F.col("_bit")).otherwise(0)).alias(f"_m{w}") for w in range(width)])
    marked = resolved.join(masks, "case_id", "left").withColumns({f"_m{w}": F.coalesce(f"_m{w}", F.lit(0)) for w in range(width)})
    fits = (F.col("_resolved").isNull() | (F.col("resolved") == F.col("_resolved"))) & (F.col("_source").isNull() | (F.col("source") == F.col("_source"))) & (F.col("_raw").isNull() | (F.col("raw") == F.col("_raw")))
    fits = fits & (F.col("runner_score") <= F.col("_most")) & F.array_contains("_confidence", F.col("confidence"))
    some = ~F.col("_picks")
    for w in range(width):
        m = F.col(f"_m{w}")
        fits = fits & (m.bitwiseAND(F.col("_need")[w]) == F.col("_need")[w]) & (m.bitwiseAND(F.col("_never")[w]) == 0)
        some = some | (m.bitwiseAND(F.col("_some")[w]) != 0)
    first = marked.join(F.broadcast(ruled), fits & some).groupBy("case_id").agg(F.min(F.struct("_order", "_name", "_to")).alias("_first"))
    out = resolved.join(first, "case_id", "left").withColumn("rule", F.col("_first._name"))
    out = out.withColumn("resolved", F.coalesce("_first._to", "resolved")).withColumn("confidence", F.when(F.col("rule").isNotNull(), "high").otherwise(F.col("confidence")))
    return out.drop("_first")
