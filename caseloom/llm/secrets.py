"""Secret scan with corpus-wide ownership frequency.

Candidates are found with regular expressions inside the scan, hashed, and
counted by distinct repositories and distinct owners over the whole corpus. A
value seen with few owners looks like a live credential; a value that many
owners hold is a copied example. Only DataFrame functions are used.

Null text counts as empty. A null repository or owner is one unknown owner.
Repeated rows give a row each. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import fresh
from .scratch import cut

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "generic")
#: Long tokens of no base kind; the ownership counts decide on them.
GENERIC = r"[A-Za-z0-9+/_=-]{20,}+"
#: A value held by more owners than this is a copied example.
MAX_OWNERS = 2

_MATCHES = "array<struct<rank:int,nth:int,gap:int,n:int,kept:boolean,digest:string>>"
_HITS = "array<struct<start:int,rank:int,end:int,digest:string>>"


def _matches(found: Column, text: Column, pattern: str, rank: int, value=lambda m: m, keep=lambda v: F.lit(True)) -> Column:
    """Matches in order with their lengths and the lengths of the texts before them; values become digests, so no secret is written to a table."""
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.char_length), F.lit(1), F.size(found))
    rows = F.zip_with(found, gaps, lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    made = F.transform(
        rows,
        lambda x, i: F.struct(
            F.lit(rank).alias("rank"),
            i.alias("nth"),
            x["gap"].alias("gap"),
            F.char_length(x["m"]).alias("n"),
            keep(value(x["m"])).alias("kept"),
            F.sha2(value(x["m"]), 256).alias("digest"),
        ),
    )
    return F.when(F.size(found) > 0, made).otherwise(F.array().cast(_MATCHES))


def spans_text(hits: Column) -> Column:
    """kind:start:end of sorted hits, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(hits, lambda x: F.concat_ws(":", F.get(kind, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )


def find_candidates(docs: DataFrame, id_col="doc_id", text_col="text", repo_col="source", owner_col="source") -> DataFrame:
    """Per row of ``docs``: row_id, id, key of the text, repo, owner and the matches of every kind as digests."""
    found = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("_id"),
        F.xxhash64(text_col).alias("_text_key"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("_repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    names = [f"_{kind}" for kind in KINDS]
    patterns = (ASSIGN, ACCESS, HEX, GENERIC)
    found = found.select("*", *[F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(name) for p, name in zip(patterns, names)])
    options = (
        {"value": lambda m: F.regexp_extract(m, ASSIGN, 2), "keep": lambda v: F.char_length(v) >= 6},
        {},
        {},
        {"keep": lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")},
    )
    made = [_matches(F.col(name), F.col("_text"), p, rank, **more) for rank, (name, p, more) in enumerate(zip(names, patterns, options))]
    return found.select("row_id", "_id", "_text_key", "_repo", "_owner", F.concat(*made).alias("_matches"))


def place_hits(candidates: DataFrame) -> DataFrame:
    """A row per hit with start and end: row_id, id, key of the text, repo, owner, start, rank, end, digest.

    Offsets are running sums over the matches of a text and kind; generic hits
    that overlap a base hit go. A text's matches are one window, so their
    number costs no more than a sort.
    """
    each = candidates.select("row_id", "_id", "_text_key", "_repo", "_owner", F.explode("_matches").alias("m"))
    each = each.select("row_id", "_id", "_text_key", "_repo", "_owner", "m.*").repartition("row_id")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    ended = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("row_id", "rank").orderBy("nth").rowsBetween(*so_far)).cast("int"))
    ended = ended.where("kept").withColumn("start", F.col("end") - F.col("n"))
    base = F.col("rank") < KINDS.index("generic")
    forward = Window.partitionBy("row_id").orderBy("start", "rank").rowsBetween(*so_far)
    back = Window.partitionBy("row_id").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(*so_far)
    near = ended.withColumn("_before", F.max(F.when(base, F.col("end"))).over(forward)).withColumn("_after", F.min(F.when(base, F.col("start"))).over(back))
    overlaps = F.coalesce(F.col("_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_after") < F.col("end"), F.lit(False))
    return near.where(base | ~overlaps).select("row_id", "_id", "_text_key", "_repo", "_owner", "start", "rank", "end", "digest")


def ownership(hits: DataFrame) -> DataFrame:
    """Per value digest: distinct repositories, distinct owners, rows."""
    return (
        hits.groupBy("digest", "_repo", "_owner")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("digest")
        .agg(F.count_distinct("_repo").alias("n_repos"), F.count_distinct("_owner").alias("n_owners"), F.sum("n").alias("n_rows"))
    )


def secret_scan(docs: DataFrame, id_col="doc_id", text_col="text", repo_col="source", owner_col="source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """All candidates of every row, each judged by its ownership counts.

    Columns: id, base and all hits as arrays of (start, rank, end, digest), and
    the numbers of hits judged owner-specific and widely copied. Base hits stay
    whatever their counts; a generic hit is added only when owner-specific.
    """
    found = cut(find_candidates(docs, id_col, text_col, repo_col, owner_col), "secrets")
    hits = cut(place_hits(found), "secret-hits")
    hit = F.struct("start", "rank", "end", "digest")
    base = F.col("rank") < KINDS.index("generic")
    judged = (
        hits.join(ownership(hits), "digest")
        .withColumn("owned", F.col("n_owners") <= max_owners)
        .groupBy("row_id")
        .agg(
            F.array_sort(F.collect_list(F.when(base, hit))).alias("_base"),
            F.array_sort(F.collect_list(F.when(base | F.col("owned"), hit))).alias("_all"),
            F.count_if("owned").alias("n_owned"),
            F.count_if(~F.col("owned")).alias("n_copied"),
            F.max("n_owners").alias("max_owners"),
        )
    )
    none = F.array().cast(_HITS)
    return found.select("row_id", "_id").join(judged, "row_id", "left").select(
        F.col("_id").alias(id_col),
        F.coalesce(F.col("_base").cast(_HITS), none).alias("base_hits"),
        F.coalesce(F.col("_all").cast(_HITS), none).alias("all_hits"),
        F.coalesce("n_owned", F.lit(0)).alias("n_owned"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("max_owners", F.lit(0)).alias("max_owners"),
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op6 from :func:`secret_scan`."""
    count = lambda rank: F.size(F.filter("base_hits", lambda x: x["rank"] == rank)).cast("long")
    return secret_scan(docs).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base_hits")), 256).alias("base_sha256"),
        spans_text(F.col("all_hits")).alias("spans"),
        "n_owned",
        "n_copied",
    )


def mask_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by ``[kind]``; all columns stay.

    Base spans are masked unless more than ``max_owners`` owners hold the same
    value, which makes it a copied example; generic spans are masked where they
    are owner-specific. Where spans overlap they are masked as one, by the kind
    of the first. ``n_chars`` is counted anew where it is present.
    """
    columns = docs.columns
    hits = cut(place_hits(find_candidates(docs)), "secret-hits")
    counted = ownership(hits).where(F.col("n_owners") <= max_owners).select("digest")
    owned = hits.join(counted, "digest", "left_semi")
    # Rows of equal id and text have equal spans: they are reduced to one before the window.
    owned = owned.groupBy("_text_key", "_id", "start", "rank").agg(F.max("end").alias("end"))
    in_text = Window.partitionBy("_text_key", "_id").orderBy("start", "rank")
    reached = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") >= F.col("_reached"), F.lit(True)).cast("int")
    joined = owned.withColumn("_reached", reached).withColumn("_group", F.sum(opens).over(in_text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = joined.groupBy("_text_key", "_id", "_group").agg(F.min(F.struct("start", "rank")).alias("first"), F.max("end").alias("end"))
    spans, key, row = (fresh(name, columns) for name in ("_spans", "_text_key", "_id"))
    span = F.struct("first.start", "first.rank", "end")
    masks = joined.groupBy(F.col("_text_key").alias(key), F.col("_id").alias(row)).agg(F.array_sort(F.collect_list(span)).alias(spans))
    kind = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    before = lambda i: F.coalesce(F.get(F.col(spans), i - 1)["end"], F.lit(0))
    pieces = F.transform(spans, lambda x, i: F.concat(F.substring(F.col("text"), before(i) + 1, x["start"] - before(i)), F.get(kind, x["rank"])))
    whole = F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), F.element_at(spans, -1)["end"] + 1, F.char_length("text")))
    out = docs.join(masks, (F.xxhash64("text") == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(row)), "left")
    out = out.withColumn("text", F.when(F.col(spans).isNull() | F.col("text").isNull(), F.col("text")).otherwise(whole))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*columns)
