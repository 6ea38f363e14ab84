"""Document quality by weak supervision: rules vote, and their votes are weighed by what they are worth.

Every rule reads counts of a document and votes good, bad, or abstains. Which
documents are good is not known; expectation-maximisation estimates for each
rule how often it says good of good documents and bad of bad ones, and a
document's quality is its posterior probability given all votes. So one lenient
rule cannot save junk, and one harsh rule alone cannot reject a sound text.

Only DataFrame functions are used. A text is read once; documents with the same
votes are one row of a table of at most 3 ** rules vote patterns, and each round
of the estimation is one aggregate over that table (of which a row of sums comes
to the driver).

Null text has no words, as empty text. Documents without words abstain in all
rules that divide by words. Repeated rows count and are returned once each.
Ties (probability exactly one half) are kept. An empty table gives no rows.
Other columns are ignored. A text is one row's work: its windows are sorted in
that row, which takes some 200 bytes a word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
ROUNDS = 25
#: Votes (right, all) that every rule is taken to have cast besides its own: sound texts pass nearly all rules, but junk of one kind fails few of them.
ON_GOOD, ON_BAD = (9.5, 10.0), (3.0, 10.0)

#: Name, and the SQL conditions on the counts under which a rule votes bad, or else good. Repeated words and repeated lines
#: are one rule: they go together, and the estimation takes rules for independent given the quality.
RULES: list[tuple[str, str, str]] = [
    ("length", "n_words < 50", "n_words >= 80"),
    ("word_length", "word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words", "word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("letters", "100 * n_letters < 70 * word_chars", "100 * n_letters >= 85 * word_chars"),
    ("lettered", "100 * n_lettered < 80 * n_words", "100 * n_lettered >= 90 * n_words"),
    ("capitals", "100 * n_capitals > 50 * word_chars", "100 * n_capitals < 20 * word_chars"),
    ("shouting", "10 * n_marks > n_words", "50 * n_marks <= n_words"),
    ("repetition", "100 * n_repeat_words > 30 * n_words OR 100 * n_dup_lines > 30 * n_lines", "100 * n_repeat_words <= 15 * n_words AND 100 * n_dup_lines <= 10 * n_lines"),
]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three found twice or more: windows are sorted, equal ones are neighbours."""
    n = F.size(words)
    cut_from = lambda first: F.slice(words, F.lit(first), n - 2)
    windows = F.sort_array(F.arrays_zip(cut_from(1).alias("a"), cut_from(2).alias("b"), cut_from(3).alias("c"), F.sequence(F.lit(0), n - 3).alias("at")))
    pairs = F.arrays_zip(F.slice(windows, F.lit(1), n - 3).alias("x"), F.slice(windows, F.lit(2), n - 3).alias("y"))
    same = F.filter(pairs, lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))
    three = lambda w: [w["at"], w["at"] + 1, w["at"] + 2]
    places = F.flatten(F.transform(same, lambda p: F.array(*three(p["x"]), *three(p["y"]))))
    return F.when(n > 3, F.size(F.array_distinct(places))).otherwise(0).cast("long")


def statistics(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and the counts that rules read, one row for each row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    bare = F.col("t")
    for blank in BLANKS:
        bare = F.replace(bare, F.lit(blank), F.lit(""))
    rows = rows.select("doc_id", "t", bare.alias("bare"), F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD))
    left = lambda drop: F.char_length(F.regexp_replace("bare", drop, "")).cast("long")
    rows = rows.withColumn("lines", lines)
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_lettered"),
        F.char_length("bare").cast("long").alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        left(r"[^!?]+").alias("n_marks"),
        left(r"[^\p{L}]+").alias("n_letters"),
        left(r"[^\p{Lu}]+").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def votes() -> list[Column]:
    """Per rule 1 for good, -1 for bad, 0 where it abstains (always without words)."""
    return [F.when(F.col("n_words") == 0, F.lit(-1 if name == "length" else 0)).when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).cast("int").alias(f"vote_{name}") for name, bad, good in RULES]


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


@dataclass
class Worth:
    """Share of good documents, and per rule the share of right votes among those cast on good and on bad documents."""

    share: float
    on_good: list[float]
    on_bad: list[float]

    def posterior(self) -> Column:
        """Probability that a row with ``vote_`` columns is good."""
        return posterior(F.array(*vote_names()), F.lit(self.share), F.array(*map(F.lit, self.on_good)), F.array(*map(F.lit, self.on_bad)))


def vote_names() -> list[str]:
    return [f"vote_{name}" for name, _, _ in RULES]


def posterior(cast: Column, share: Column, on_good: Column, on_bad: Column) -> Column:
    """Probability of good, from an array of votes and the worth of the rules."""
    rates = F.zip_with(on_good, on_bad, lambda good, bad: F.struct(good.alias("good"), bad.alias("bad")))
    factors = F.zip_with(cast, rates, lambda v, r: F.when(v == 1, r["good"] / (1 - r["bad"])).when(v == -1, (1 - r["good"]) / r["bad"]).otherwise(1.0))
    return _let(F.aggregate(factors, share / (1 - share), lambda odds, x: odds * x), lambda odds: odds / (1 + odds))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first_guess(cast: Column) -> Column:
    """A bad vote weighs three good ones, before any rule's worth is known."""
    up, down = (F.size(F.filter(cast, lambda v: v == side)) for side in (1, -1))
    return (up + 1.0) / (up + down * 3 + 2.0)


def _weighed(patterns: Column, probability) -> Column:
    weigh = lambda x, p: F.struct(x["cast"].alias("cast"), (x["n"] * p).alias("good"), (x["n"] * (1 - p)).alias("bad"))
    return F.transform(patterns, lambda x: _let(probability(x["cast"]), lambda p: weigh(x, p)))


def _rated(weighed: Column) -> Column:
    """Maximisation: share of good documents and the rules' shares of right votes, from patterns with their good and bad weights."""
    total = lambda part: F.aggregate(weighed, F.lit(0.0), lambda so_far, x: so_far + part(x))
    each = F.sequence(F.lit(0), F.lit(len(RULES) - 1))

    def right(side: str, vote: int, besides: tuple[float, float]) -> Column:
        of = lambda j, holds: total(lambda x: F.when(holds(F.get(x["cast"], j)), x[side]).otherwise(0.0))
        return F.transform(each, lambda j: (of(j, lambda v: v == vote) + besides[0]) / (of(j, lambda v: v != 0) + besides[1]))

    share = (total(lambda x: x["good"]) + 1) / (total(lambda x: x["good"] + x["bad"]) + 2)
    return F.struct(share.alias("share"), right("good", 1, ON_GOOD).alias("on_good"), right("bad", -1, ON_BAD).alias("on_bad"))


def estimate(voted: DataFrame, rounds: int = ROUNDS) -> Worth:
    """Worth of the rules by expectation-maximisation over the patterns of votes in ``voted``.

    The patterns, at most 3 ** rules of them, are one array; all rounds are one
    expression on it.
    """
    patterns = voted.groupBy(F.array(*vote_names()).alias("cast")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("cast", "n"))).alias("patterns"))
    after = lambda state, _: _let(_weighed(F.col("patterns"), lambda cast: posterior(cast, state["share"], state["on_good"], state["on_bad"])), _rated)
    start = _let(_weighed(F.col("patterns"), _first_guess), _rated)
    got = one.select(F.aggregate(F.sequence(F.lit(2), F.lit(rounds)), start, after).alias("worth")).first()["worth"]
    return Worth(got["share"], list(got["on_good"]), list(got["on_bad"]))


def quality_rules(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Counts, votes, ``base_failed``, ``quality`` (posterior) and ``kept`` for every row of ``docs``."""
    voted = cut(statistics(docs, id_col, text_col).select("*", *votes()), "quality-votes")
    worth = estimate(voted)
    judged = voted.withColumn("base_failed", base_failed()).withColumn("quality", worth.posterior())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def quality_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op13."""
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql() -> str:
    """DuckDB SQL with the rows of query op13: the same rules, windows as rows, the estimation as a recursion."""
    names = [name for name, _, _ in RULES]
    blanks = r"[\x20\x09-\x0D]"
    length = lambda keep: f"length(regexp_replace(t, '{keep}', '', 'g'))"
    cast = ", ".join(f"CASE WHEN n_words = 0 THEN {-1 if name == 'length' else 0} WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{name}" for name, bad, good in RULES)
    each = ", ".join(f"v_{name}" for name in names)
    up, down = (" + ".join(f"CAST(v_{name} = {s} AS INT)" for name in names) for s in (1, -1))
    sums = ", ".join(
        f"coalesce(sum(CASE WHEN v_{x} = 1 THEN n * p END) OVER (), 0) AS a_{x}, coalesce(sum(CASE WHEN v_{x} <> 0 THEN n * p END) OVER (), 0) AS b_{x}, "
        f"coalesce(sum(CASE WHEN v_{x} = -1 THEN n * (1 - p) END) OVER (), 0) AS c_{x}, coalesce(sum(CASE WHEN v_{x} <> 0 THEN n * (1 - p) END) OVER (), 0) AS d_{x}"
        for x in names
    )
    good, bad = (lambda x: f"((a_{x} + {ON_GOOD[0]}) / (b_{x} + {ON_GOOD[1]}))"), (lambda x: f"((c_{x} + {ON_BAD[0]}) / (d_{x} + {ON_BAD[1]}))")
    share = "((sp + 1) / (sn + 2))"
    odds = f"{share} / (1 - {share})" + "".join(
        f" * CASE v_{x} WHEN 1 THEN {good(x)} / (1 - {bad(x)}) WHEN -1 THEN (1 - {good(x)}) / {bad(x)} ELSE 1 END" for x in names
    )
    return rf"""WITH RECURSIVE text_v AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
  word_v AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM text_v),
  window_v AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM word_v)),
  twice_v AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM window_v) WHERE k > 1),
  repeat_v AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice_v, range(3) r(j) GROUP BY rid),
  stat_v AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_lettered, {length(blanks)} AS word_chars, {length('[^#*$%&|<>]')} AS n_symbols, {length('[^!?]')} AS n_marks,
    {length('[^\\p{L}]'.replace(chr(92) * 2, chr(92)))} AS n_letters, {length('[^\\p{Lu}]'.replace(chr(92) * 2, chr(92)))} AS n_capitals, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM word_v LEFT JOIN repeat_v USING (rid)),
  vote_v AS (SELECT *, {cast} FROM stat_v),
  pattern_v AS (SELECT {each}, CAST(count(*) AS DOUBLE) AS n FROM vote_v GROUP BY ALL),
  em_v AS (SELECT 0 AS k, {each}, n, (({up}) + 1.0::DOUBLE) / (({up}) + 3 * ({down}) + 2.0::DOUBLE) AS p FROM pattern_v
    UNION ALL SELECT k + 1, {each}, n, o / (1 + o) FROM (SELECT k, {each}, n, {odds} AS o FROM (SELECT k, {each}, n, sum(n * p) OVER () AS sp, sum(n) OVER () AS sn, {sums} FROM em_v WHERE k < {ROUNDS})))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM vote_v) JOIN em_v USING ({each}) WHERE k = {ROUNDS}"""
