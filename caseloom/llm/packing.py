"""Packing tokenised documents into sequences of a fixed length.

Every document is cut into whole sequences and one remainder. Pieces are dealt
into randomised groups by a hash, and every group packs its own pieces by
first-fit decreasing, where a tournament tree over the bins' free room finds
the first bin that fits. Groups are independent, so the work spreads over any
number of machines, and a group's size is fixed by a parameter.

Null text counts as empty; an empty document is the closing id alone. Repeated
rows are packed once each. A null id is carried through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_ids import encoder

LENGTH = 2048
#: Documents in a group, on average. FFD wastes under one bin a group.
GROUP_DOCS = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def cut_documents(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Pieces of every document: full sequences and a remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, closing = encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, numbers in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).cast(pa.binary()).to_pylist())):
                ids = numbers.astype("<u4").tobytes() + closing
                total = len(ids) // 4
                for start in range(0, total, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class FirstFit:
    """Bins of one capacity; a tournament tree keeps the largest free room below each node."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(bins, 1) - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """(bin, room in it before) of the first bin with room for ``size``."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        before = room[node]
        room[node] = before - size
        place, node = node - self.leaves, node // 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
        return place, before


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """First-fit decreasing: (bin, offset) of each piece."""
    order = np.argsort(-lengths, kind="stable")
    tree = FirstFit(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in order.tolist():
        bins[k], before = tree.put(int(lengths[k]))
        offsets[k] = capacity - before
    return bins, offsets


def pack(pieces: DataFrame, n_docs: int, length: int = LENGTH, group_docs: int = GROUP_DOCS, seed: int = 7) -> DataFrame:
    """Sequence and offset of every piece, packed in randomised groups."""
    groups = max(1, -(-n_docs // group_docs))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        bins, offsets = pack_group(table["length"].to_numpy(), length)
        table = table.drop_columns(["pack_group"])
        base = key[0].as_py() << 32
        return table.append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Cut, tokenise and pack ``docs`` (doc_id, text; other columns are ignored)."""
    return pack(cut_documents(docs, path, end_id, length), docs.count(), length, group_docs)
