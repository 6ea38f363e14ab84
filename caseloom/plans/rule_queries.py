"""Queries of the category rules: signals are words found in titles and texts, contexts are phrases of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import category, rules
from ..operators.rules import Rule, Suppression
from . import views
from .queries import FREQ, HITS_SQL, NORM, RESOLVED_SQL, hits, labelled, query
from .views import CASES_SQL

CONTEXTS = {"pair": ["of the", "and the", "for the", "in the"], "long": ["that the", "with the", "dans le"]}
SUPPRESSIONS = [Suppression("Alpha", "of", "pair"), Suppression("Beta", "und", "long", signal="keyword", without=True), Suppression("Gamma", "que", "long")]
RULES = [
    Rule("alpha_title_two", "Alpha", 6, None, "Alpha", need=("keyword=the", "keyword=of"), never=("narrative=las",)),
    Rule("alpha_any_source", "Alpha", 5, "src0", None, ("low", "medium"), some=("keyword=the", "keyword=and", "narrative=of"), never=("keyword=of",)),
    Rule("beta_consensus", "Beta", 8, None, None, ("low", "medium"), need=("consensus=*", "keyword=*")),
    Rule("gamma_to_delta", "Gamma", 9, None, None, ("low", "medium"), some=("keyword=les", "keyword=que"), to="Delta"),
    Rule("any_delta", None, 3, "src1", None, ("low",), need=("narrative=para",)),
]
_HITS = " OR ".join(f"(category = '{s.category}' AND word = '{s.word}'" + (f" AND signal = '{s.signal}'" if s.signal else "") + f" AND {'NOT ' if s.without else ''}regexp_matches(ctx, ' ({'|'.join(CONTEXTS[s.context])}) '))" for s in SUPPRESSIONS)


def parts(s, d) -> tuple[DataFrame, DataFrame]:
    """Resolved cases with their source and raw category, and their signals."""
    c, found = labelled(s, d), hits(s, d)
    made = category.resolve_category(c, found)
    return made.join(c.select("case_id", "source", F.col("category").alias("raw")), "case_id"), found


@query("SC02_suppress", f"SELECT case_id, signal, category, word FROM hits_v JOIN (SELECT case_id, ' ' || {NORM.format('question')} || ' ' AS ctx FROM cases_v) USING (case_id) WHERE NOT ({_HITS})", (CASES_SQL, HITS_SQL))
def _(s, d):
    return rules.suppress(hits(s, d), views.cases(s, d), "question", SUPPRESSIONS, CONTEXTS)


def _listed(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _when(r: Rule) -> str:
    out = [f"runner_score <= {r.most}", f"list_contains({_listed(r.confidence)}, confidence)", f"len(list_intersect(atoms, {_listed(r.need)}::VARCHAR[])) = {len(r.need)}", f"len(list_intersect(atoms, {_listed(r.never)}::VARCHAR[])) = 0"]
    out += [f"len(list_intersect(atoms, {_listed(r.some)})) > 0"] if r.some else []
    return " AND ".join(out + [f"{c} = '{v}'" for c, v in (("resolved", r.resolved), ("source", r.source), ("raw", r.raw)) if v is not None])


_FIRST = "CASE " + " ".join(f"WHEN {_when(r)} THEN '{r.name}'" for r in RULES) + " END"
_TO = " ".join(f"WHEN '{r.name}' THEN '{r.to}'" for r in RULES if r.to)
_CONTENT = ", ".join(f"'{c}'" for c in category.CONTENT)
ATOMS = f"""met_v AS (SELECT r.case_id, r.resolved, r.confidence, coalesce(t.rs, 0) AS runner_score, r.raw, c.source FROM resolved_v r JOIN cases_v c ON c.case_id = r.case_id LEFT JOIN two_v t ON t.case_id = r.case_id),
  atoms_v AS (SELECT case_id, list(DISTINCT a) AS atoms FROM (SELECT case_id, signal || '=' || word AS a FROM hits_v UNION ALL SELECT case_id, signal || '=*' FROM hits_v
    UNION ALL SELECT h.case_id, 'consensus=*' FROM hits_v h JOIN met_v s ON s.case_id = h.case_id AND s.resolved = h.category WHERE signal IN ({_CONTENT}) GROUP BY h.case_id HAVING count(DISTINCT signal) >= 2) GROUP BY case_id)"""


@query("SC03_promote", f"""SELECT case_id, CASE rule {_TO} ELSE resolved END AS resolved, CASE WHEN rule IS NOT NULL THEN 'high' ELSE confidence END AS confidence, rule
  FROM (SELECT *, {_FIRST} AS rule FROM (SELECT s.*, coalesce(atoms, []) AS atoms FROM met_v s LEFT JOIN atoms_v a ON a.case_id = s.case_id))""", (CASES_SQL, HITS_SQL, RESOLVED_SQL, ATOMS))
def _(s, d):
    resolved, found = parts(s, d)
    return rules.promote(resolved, rules.case_atoms(found, resolved), RULES).select("case_id", "resolved", "confidence", "rule")


APPLIED = """applied_v AS (SELECT r.case_id, r.raw, r.resolved, r.confidence, coalesce(a.category, CASE WHEN confidence = 'high' THEN resolved ELSE coalesce(raw, 'Unclassified') END) AS final, a.category IS NULL AND confidence <> 'high' AND conflict AS review FROM resolved_v r
    LEFT JOIN (SELECT case_id, 'Delta' AS category FROM cases_v WHERE needs_review) a USING (case_id))"""


@query("AG07_category_counts", " UNION ALL ".join(f"SELECT '{n}' AS dimension, coalesce({n}, 'Unclassified') AS value, count(*) AS n FROM applied_v GROUP BY 2" for n in ("raw", "resolved", "final", "confidence")) + """
  UNION ALL SELECT 'outcome', 'auto_fixed', count(*) FROM applied_v WHERE coalesce(final <> raw, final <> 'Unclassified') AND NOT review HAVING count(*) > 0 UNION ALL SELECT 'outcome', 'queued', count(*) FROM applied_v WHERE review HAVING count(*) > 0
  UNION ALL SELECT 'outcome', 'unclassified', count(*) FROM applied_v WHERE final = 'Unclassified' HAVING count(*) > 0""", (CASES_SQL, HITS_SQL, RESOLVED_SQL, APPLIED))
def _(s, d):
    c = labelled(s, d)
    resolved, _ = parts(s, d)
    return category.category_counts(category.apply_category(resolved, c.where("needs_review").select("case_id", F.lit("Delta").alias("category"))))
