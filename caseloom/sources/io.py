"""Reading, gating, writing and comparing case tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one in a local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    context = spark.sparkContext
    if not named:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = context.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="spark-caseloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def read_source(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """IO01/IO02: a JSON array or JSON lines, under a fixed schema; bad records are kept in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path, multiLine=multi_line, mode="PERMISSIVE")


def unwrap_rows(df: DataFrame, fields: list[str]) -> DataFrame:
    """IO03: records inside ``row``, ``rows`` or ``data`` envelopes, or bare."""
    parts = []
    if "rows" in df.columns:
        parts.append(df.where(F.col("rows").isNotNull()).select(F.explode("rows").alias("r")).select("r.*"))
    for name in ("row", "data"):
        if name in df.columns:
            parts.append(df.where(F.col(name).isNotNull()).select(f"{name}.*"))
    bare = [c for c in fields if c in df.columns]
    if bare:
        wrapped = [F.col(c).isNotNull() for c in ("rows", "row", "data") if c in df.columns]
        keep = F.lit(True)
        for w in wrapped:
            keep = keep & ~w
        parts.append(df.where(keep).select(*bare))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


class TooManyRejects(ValueError):
    """More records fail the rules than a batch may hold."""


def gate_reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row fails, in order."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def schema_gate(df: DataFrame, rules: dict[str, Column], max_bad: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """IO04: (valid, rejects with reasons); a batch with a larger share of rejects is refused."""
    marked = df.withColumn("reasons", gate_reasons(rules))
    share = marked.agg(F.avg((F.size("reasons") > 0).cast("int"))).first()[0] or 0.0
    if share > max_bad:
        raise TooManyRejects(f"{share:.1%} of the records fail the rules")
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def to_relational(cases: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame]:
    """IO05: ``cases`` with typed hot columns and nested parts as JSON, and ``case_options`` in slot order."""
    base = [c for c in cases.columns if c != "options"]
    table = cases.select(*base, F.size("options").alias("option_count"), F.to_json("options").alias("options_json"), F.lit(run_id).cast("long").alias("imported_from_run_id"))
    options = cases.select("case_id", F.posexplode("options").alias("sort_order", "o")).select(
        "case_id", "sort_order", F.col("o.id").alias("option_id"), F.col("o.text").alias("option_text"), F.col("o.is_correct").cast("int").alias("is_correct")
    )
    return table.drop("options_json"), options


def from_relational(table: DataFrame, options: DataFrame) -> DataFrame:
    """IO06: nested cases, options in sort order; a case without options has an empty list."""
    item = F.struct("sort_order", F.struct(F.col("option_id").alias("id"), F.col("option_text").alias("text"), (F.col("is_correct") == 1).alias("is_correct")).alias("o"))
    nested = options.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["o"]).alias("options"))
    empty = F.array().cast("array<struct<id:string,text:string,is_correct:boolean>>")
    return table.drop("option_count", "imported_from_run_id").join(nested, "case_id", "left").withColumn("options", F.coalesce("options", empty))


def row_digest(df: DataFrame, key: str) -> DataFrame:
    """Key and SHA-256 of the row as JSON, columns by name."""
    return df.select(F.col(key), F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("digest"))


def parity(a: DataFrame, b: DataFrame, key: str = "case_id") -> DataFrame:
    """IO07/SE05: rows in both, only in either, and differing, by digests of whole rows."""
    x, y = row_digest(a, key), row_digest(b, key).withColumnRenamed("digest", "other")
    joined = x.join(y, key, "full_outer")
    return joined.agg(
        F.count_if(F.expr("digest = other")).alias("equal"),
        F.count_if(F.expr("digest <> other")).alias("different"),
        F.count_if(F.expr("other is null")).alias("only_a"),
        F.count_if(F.expr("digest is null")).alias("only_b"),
    )


def upsert(base: DataFrame, delta: DataFrame, key: str = "case_id") -> DataFrame:
    """IO08: rows of ``delta`` replace those of ``base`` with their key; others are added."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def publish(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]]) -> int:
    """IO08: replace a snapshot of several tables at once; the number of the new version (read by ``versions.Versions``)."""
    from .versions import Versions

    return Versions(next(iter(tables.values())).sparkSession, path, keys).replace(tables)


def write_request_pack(df: DataFrame, path: str, per_file: int, by: list[str]) -> None:
    """IO09: JSON lines sorted for locality, at most ``per_file`` a file."""
    columns = [c for c in df.columns]
    lines = df.repartitionByRange(*by).sortWithinPartitions(*by).select(F.to_json(F.struct(*columns)).alias("value"))
    lines.write.option("maxRecordsPerFile", per_file).text(path)


def write_chunks(df: DataFrame, path: str, order: list[str], per_file: int = 5000) -> DataFrame:
    """IO11: JSON chunks of exactly ``per_file`` rows in ``order``, the last of what is left; the manifest: chunk, file, n_rows.

    Rows are numbered over all ranges, so a chunk is known before it is
    written: a chunk is one folder with one file. The manifest is read back
    from the files.
    """
    from ..operators.ids import dense_numbers

    numbered = dense_numbers(df, order, "_n").withColumn("chunk", F.expr(f"(_n - 1) div {per_file} + 1"))
    chunked = numbered.repartition("chunk").sortWithinPartitions("chunk", "_n")
    chunked.drop("_n").write.partitionBy("chunk").json(path)
    back = df.sparkSession.read.schema(df.schema).json(path)
    where = F.col("_metadata.file_path")
    read = back.select(F.regexp_extract(where, "chunk=(\\d+)/", 1).cast("long").alias("chunk"), F.col("_metadata.file_name").alias("file"))
    return read.groupBy("chunk", "file").agg(F.count(F.lit(1)).alias("n_rows"))


RESULT = "_id string, correct_option_id string, confidence string, rationale string"


def parse_results(lines: DataFrame) -> DataFrame:
    """IO10: result lines (value, file) in three envelope shapes; content may be fenced or have text around its object.

    error is empty, or one of bad_line, api_error, empty_content, bad_json, bad_confidence.
    """
    get = lambda p: F.get_json_object("value", p)
    content = F.coalesce(
        get("$.response.body.choices[0].message.content"), get("$.response.body.output[0].content[0].text"), get("$.response.body.output_text")
    )
    body = F.regexp_extract(F.regexp_replace(F.coalesce(content, F.lit("")), "```(json)?", ""), "(?s)(\\{.*\\})", 1)
    parsed = F.from_json(F.nullif(body, F.lit("")), RESULT)
    level = F.upper(F.coalesce(F.col("r.confidence"), F.lit("")))
    error = (
        F.when(get("$.custom_id").isNull(), "bad_line")
        .when(get("$.error").isNotNull() & (get("$.error") != "null"), "api_error")
        .when(F.trim(F.coalesce(content, F.lit(""))) == "", "empty_content")
        .when(F.col("r._id").isNull() & F.col("r.correct_option_id").isNull(), "bad_json")
        .when(~level.isin("HIGH", "MEDIUM", "LOW"), "bad_confidence")
        .otherwise("")
    )
    return lines.withColumn("r", parsed).select(
        get("$.custom_id").alias("custom_id"), "file", F.col("r._id").alias("case_key"), F.col("r.correct_option_id").alias("option"), level.alias("confidence"), F.col("r.rationale").alias("rationale"), error.alias("error")
    )


def plan_sources(registry: DataFrame, state: DataFrame) -> DataFrame:
    """IO12: sources that are new, changed or unfinished, with the offset to resume from."""
    s = state.select("source", F.col("etag").alias("old_etag"), "status", "row_offset")
    joined = registry.join(s, "source", "left")
    changed = F.col("old_etag").isNull() | (F.col("etag") != F.col("old_etag"))
    return joined.where(changed | (F.col("status") != "complete")).select("source", F.when(changed, F.lit(0)).otherwise(F.coalesce("row_offset", F.lit(0))).alias("resume_at"))
