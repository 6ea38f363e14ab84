"""Approximate nearest neighbours by inner product: inverted file with product-quantised residuals.

Vectors belong to the list of their nearest coarse centroid; what is left after
the centroid is product-quantised. A query visits the lists with the largest
inner product of centroid and query, as many as a sample's true neighbours
need for the target recall, and on until they hold as many members as are asked
for. In a list, distances come from the query's tables
of inner products with all codewords. The best by table are reranked exactly in
double precision, and so is every member whose table value plus its own
quantisation error could still reach the last place. Lists are split into
blocks of bounded size, and their queries into slices; a block returns a
query's k best, and these are merged.

Vectors that are null, empty, zero or hold null or non-finite components take
no part; vectors of different dimension do not meet. Every row is a candidate
of its own (repeated vectors too), except those with the query's id. Of queries
with one id and different vectors the smallest vector asks. Ties go to the
smaller id. A null id takes no part. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut
from .vectors import k_means, matrix, sample, squared_distances, takes_part

TARGET_RECALL = 0.97
SUBSPACES, CODEWORDS = 16, 256
BLOCK_MEMBERS, SLICE_QUERIES = 4096, 4096
#: Reranked first, by table value; then all within the margin.
RERANK = 128
#: Standard deviations of the error of a table value that the second rerank allows for.
MARGIN = 2.5


@dataclass
class InvertedFile:
    centres: np.ndarray
    books: np.ndarray  # [subspace, codeword, part]
    visits: int

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def _parts(self, x: np.ndarray) -> np.ndarray:
        pad = self.padded - x.shape[1]
        x = np.pad(x, ((0, 0), (0, pad))) if pad else x
        return x.reshape(len(x), self.books.shape[0], -1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of the quantisation error) of each vector."""
        near = squared_distances(x, self.centres).argmin(1)
        parts = self._parts(x - self.centres[near])
        codes = np.empty(parts.shape[:2], np.uint8)
        error = np.zeros(len(x))
        for m, book in enumerate(self.books):
            d = squared_distances(parts[:, m], book)
            codes[:, m] = d.argmin(1)
            error += d[np.arange(len(x)), codes[:, m]]
        return near, codes, np.sqrt(error)

    def lists(self, q: np.ndarray, members: np.ndarray, k: int) -> list[np.ndarray]:
        """Lists each query visits: the nearest ``visits``, and more until they hold k members and the query itself."""
        order = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")
        held = np.cumsum(members[order], axis=1)
        enough = (held <= k).sum(axis=1) + 1
        return [row[: max(self.visits, n)] for row, n in zip(order, enough.tolist())]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """[query, subspace, codeword] inner products."""
        return np.einsum("qmd,mcd->qmc", self._parts(q), self.books)


def fit(x: np.ndarray, n_lists: int, k: int, target: float) -> InvertedFile:
    """Centroids, codebooks and number of visits from a bounded sample."""
    centres = k_means(x, n_lists)
    parts = min(SUBSPACES, x.shape[1])
    file = InvertedFile(centres, np.zeros((parts, 1, -(-x.shape[1] // parts))), 1)
    rest = file._parts(x - centres[squared_distances(x, centres).argmin(1)])
    books = [k_means(rest[:, m], CODEWORDS, seed=m) for m in range(parts)]
    full = np.zeros((parts, max(len(b) for b in books), rest.shape[2]))
    for m, b in enumerate(books):
        full[m, : len(b)] = b
        full[m, len(b) :] = b[0]
    file.books = full
    queries = x[:: max(1, len(x) // 300)]
    score = queries @ x.T
    best = np.argsort(-score, axis=1, kind="stable")[:, 1 : k + 1]
    own = squared_distances(x, centres).argmin(1)
    rank = np.argsort(np.argsort(-(queries @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel()) + 1
    file.visits = int(np.quantile(ranks, target, method="higher")) if len(ranks) else len(centres)
    return file


def of_dimension(files: dict[int, InvertedFile], d: int) -> InvertedFile:
    """The file of a dimension; one list without residual codes where the sample had too few vectors of it."""
    return files.get(d) or InvertedFile(np.zeros((1, d)), np.zeros((1, 1, d)), 1)


def _search(files, k: int):
    """Per block: the queries' k best members."""

    def run(table: pa.Table) -> pa.Table:
        is_query = table["is_query"].to_numpy(zero_copy_only=False)
        members, queries = table.filter(pa.array(~is_query)), table.filter(pa.array(is_query))
        out: list[list[np.ndarray]] = [[], [], []]
        if members.num_rows and queries.num_rows:
            file = of_dimension(files.value, len(members["v"][0]))
            members = members.sort_by("vec_id")
            ids, x = members["vec_id"].to_numpy(), matrix(members["v"])
            centre = file.centres[members["list"][0].as_py()]
            codes = np.array([np.frombuffer(b, np.uint8) for b in members["codes"].to_pylist()])
            error = members["error"].to_numpy()
            q_ids, q = queries["vec_id"].to_numpy(), matrix(queries["v"])
            for first in range(0, len(q), 256):
                qs, part = q[first : first + 256], q_ids[first : first + 256]
                tables = file.tables(qs).astype(np.float32)
                value = np.repeat((qs @ centre).astype(np.float32)[:, None], len(ids), axis=1)
                for m in range(codes.shape[1]):
                    value += tables[:, m, :][:, codes[:, m]]
                spread = MARGIN * np.sqrt((qs * qs).sum(1))[:, None] * error[None, :] / np.sqrt(x.shape[1])
                for row, (query, value_row, spread_row) in enumerate(zip(qs, value, spread)):
                    other = np.flatnonzero(ids != part[row])
                    if not len(other):
                        continue
                    v = value_row[other]
                    top = other[np.argpartition(-v, RERANK)[:RERANK]] if len(other) > RERANK else other
                    exact = x[top] @ query
                    if len(other) > RERANK:
                        last = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
                        top = np.union1d(top, other[v + spread_row[other] >= last])
                        exact = x[top] @ query
                    best = np.lexsort((ids[top], -exact))[:k]
                    out[0].append(np.full(len(best), part[row]))
                    out[1].append(ids[top][best])
                    out[2].append(exact[best])
        cols = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def search(embeddings: DataFrame, is_query: Column, k: int = 20, target_recall: float = TARGET_RECALL, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row that ``is_query`` holds for."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("_q"))
    rows = rows.where(takes_part(F.col("v")) & F.col("vec_id").isNotNull())
    n = rows.count()
    lists = int(max(8, np.sqrt(n) / 8))
    fitted = {m.shape[1]: fit(m, lists, k, target_recall) for m in sample(rows, "vec_id", "v")}
    files = embeddings.sparkSession.sparkContext.broadcast(fitted)  # bounded by the sample

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            near, codes, error = [0] * len(vectors), [b""] * len(vectors), [0.0] * len(vectors)
            by_dim: dict[int, list[int]] = {}
            for at, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(at)
            for dim, at in by_dim.items():
                x = np.array([vectors[j] for j in at], np.float64)
                for j, a, c, e in zip(at, *of_dimension(files.value, dim).encode(x)):
                    near[j], codes[j], error[j] = int(a), c.tobytes(), float(e)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(near, pa.int32()), pa.array(codes, pa.binary()), pa.array(error)],
                names=["vec_id", "v", "is_query", "list", "codes", "error"],
            )

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            found: list[list[int]] = [[0]] * len(vectors)
            for at, v in enumerate(vectors):
                if len(v) in files.value:
                    file = files.value[len(v)]
                    found[at] = file.lists(np.array([v], np.float64), held.value[len(v)], k)[0].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["vec_id", "v", "visits"])

    indexed = cut(rows.mapInArrow(index, "vec_id long, v array<double>, is_query boolean, list int, codes binary, error double"), "inverted").withColumn("d", F.size("v"))
    sizes = cut(indexed.groupBy("d", "list").agg(F.count(F.lit(1)).alias("m")), "lists")
    counts = {d: np.zeros(len(file.centres), np.int64) for d, file in fitted.items()}
    for r in sizes.where(F.col("d").isin(list(fitted))).collect():  # one row a centroid
        counts[r["d"]][r["list"]] = r["m"]
    held = embeddings.sparkSession.sparkContext.broadcast(counts)
    queries = indexed.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    asking = queries.mapInArrow(visits, "vec_id long, v array<double>, visits array<int>").select("vec_id", "v", F.size("v").alias("d"), F.explode("visits").alias("list"))
    asking = cut(asking, "asking")
    slices = asking.groupBy("d", "list").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_QUERIES)).cast("int").alias("slices"))
    blocks = F.ceil(F.col("m") / F.lit(BLOCK_MEMBERS)).cast("int").alias("blocks")
    sizes = cut(sizes.join(slices, ["d", "list"]).select("d", "list", blocks, "slices"), "list-blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = (
        indexed.join(sizes, ["d", "list"])
        .withColumn("block", F.pmod(F.xxhash64(F.lit(21), "vec_id"), F.col("blocks")).cast("int"))
        .select("d", "list", "block", every("slices").alias("slice"), "vec_id", "v", "codes", "error", F.lit(False).alias("is_query"))
    )
    asking = (
        asking.join(sizes, ["d", "list"])
        .withColumn("slice", F.pmod(F.xxhash64(F.lit(22), "vec_id"), F.col("slices")).cast("int"))
        .select(
            "d", "list", every("blocks").alias("block"), "slice", "vec_id", "v",
            F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), F.lit(True).alias("is_query"),
        )
    )
    found = members.unionByName(asking).groupBy("d", "list", "block", "slice").applyInArrow(_search(files, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
