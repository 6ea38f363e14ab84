"""Queries against their SQL over texts with other letters, blanks, line ends and marks than the test tables have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from caseloom.functions import text
from caseloom.plans import all_queries as queries

TEXTS = [
    "Only ellê an", "only ellean", "A line.\n", "A line.\r\n", "A line.\u00a0", "A line.\u2028", "\u00a0", "\u3000. .a. b", "The İ. i. x", "ΑΣ. ας. ασ", "One (. two. Two", None, "", ".", "...", "\u2003. .", "noté. bien. wellé", "allé. éall. none. nöne", "FALSE. İNOT", "then the the the the the", "the the the the thes and so on", "x-the the the the the it is", "this is so so so so so.", "so\nso so so so so so is", "İ i i i i so it is here", "éa éa éa éa éa éa éa éa", "it ends, as it has begun,\n", "Ã\rÃ.Ã\x85 is what was read", "Ã\nÃ\nÃ\n is what was read", "\ufffd\ufffd is what was read", "a\vb" * 40, "ab\u00a0" * 40, " \u00a0ab" * 9, "émri. one", "é ekgé. one", "the u\u017fg. one", "\u017fediaan", "one. ***. two", "***. |. two. x", "of\n", "x of", "of\u2009",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(k * len(TEXTS) + n, t, ("en", "es", None)[k % 3], "web") for k in range(43) for n, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 0, r[0] % 2) for r in rows[::3]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, duck


@pytest.mark.parametrize("name", ["QA01_structure", "AG04_issue_report", "FL05_corruption", "FL05_quarantine_reasons", "QA01_layer_a", "PR12_align_anchor", "PR08_structured"])
def test_equal_to_sql(spark, odd, name):
    folder, duck = odd
    frame = queries.QUERIES[name](spark, folder)
    expected = duck.execute(f"SELECT {', '.join(frame.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize(
    "pattern, given, found",
    [
        (r"\ban$", "ellêan", True), (r"\ban$", "ellean", False), (r"\ban$", "an\n", False), (r"(?i)sk$", "ſK", True), (r"(?i)\bsk", "ſk", False), (r"(?i)[.?]$", "so.\n", False), (r"a.b", "a\rb", True), (r"a.b", "a\nb", False), (r"a\sb", "a\vb", False),
    ],
)
def test_sql_pattern(spark, pattern, given, found):
    assert spark.createDataFrame([(given,)], "c string").select(F.col("c").rlike(text.sql_pattern(pattern))).first()[0] == found
    assert duckdb.execute("SELECT regexp_matches(?, ?)", [given, pattern]).fetchone()[0] == found
