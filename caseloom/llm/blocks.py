"""Document frequencies of hashed keys over all documents, told back to every document.

Documents are dealt into blocks by a hash of the row. A block sends its distinct
keys, with the number of its documents that hold each, to fragments that cut
the key space into equal ranges; a fragment adds the counts up and answers each
block with one byte a key. So a key costs a block one entry however many of its
documents hold it, and no key makes a task large. Keys travel in packed arrays.

The byte is the frequency up to 200 and then grows with its logarithm; it is
over 200 also where documents of one block repeat the key so often. Keys are
told apart by 32 bits within their fragment, so a rare frequency may be too
high, never too low; users treat it as a filter or an order, not as proof.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, chunks, split_words

#: Text bytes in a block, and keys in a fragment, on average: the least, and the most that a worker's memory takes.
#: Between them both grow with the root of the input, as messages are blocks times fragments.
BLOCK_BYTES = (2 << 20, 64 << 20)
FRAGMENT_KEYS = (1 << 20, 32 << 20)
#: Input, in bytes, up to which blocks and fragments are smallest.
SMALL = 8 << 30
EXACT = 200
#: Mark of a key that a block has in more than EXACT places.
OFTEN = 1 << 15


@dataclass
class Sizes:
    bytes: int
    blocks: int
    log_fragments: int


def plan(docs: DataFrame, keys_per_byte: float) -> Sizes:
    """Numbers of blocks and fragments for these documents."""
    row = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    size = (row["bytes"] or 0) + 1
    grown = math.sqrt(max(1.0, size / SMALL))
    block, keys = (min(int(least * grown), most) for least, most in (BLOCK_BYTES, FRAGMENT_KEYS))
    blocks = max(1, -(-size // block), -(-row["rows"] // (block // 128)))
    fragments = max(32, int(size * keys_per_byte) // keys)
    return Sizes(size, blocks, min(32, (fragments - 1).bit_length()))


def dealt(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """block, doc_id, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(sizes.blocks)).alias("block"), doc_id.alias("doc_id"), text.alias("text"))


def frequency_class(df: np.ndarray) -> np.ndarray:
    over = np.maximum(df, EXACT) / EXACT
    return np.where(df <= EXACT, df, EXACT + np.minimum(55, np.ceil(4 * np.log2(over)))).astype(np.uint8)


def documents_of(cls: np.ndarray) -> np.ndarray:
    """About how many documents a class stands for."""
    return np.where(cls <= EXACT, cls, EXACT * 2.0 ** ((cls.astype(float) - EXACT) / 4))


@dataclass
class Keys:
    """Distinct (key, document) pairs of a block, in order of key, then document."""

    key: np.ndarray
    doc: np.ndarray
    #: Number of the key's code among the block's distinct codes.
    code: np.ndarray
    codes: np.ndarray
    code_docs: np.ndarray
    #: Whether more than EXACT places of the block have it.
    code_often: np.ndarray
    extra: np.ndarray | None = None


def keys_of(key: np.ndarray, doc: np.ndarray, log_fragments: int, extra: np.ndarray | None = None) -> Keys:
    """With ``extra``, repeats within a document stay, each with its value; they count once."""
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    if extra is None:
        key, doc, fresh = key[fresh], doc[fresh], np.ones(int(fresh.sum()), bool)
    else:
        extra = extra[order]
    code = key >> np.uint64(32 - log_fragments)
    start = np.ones(len(code), bool)
    start[1:] = code[1:] != code[:-1]
    number = np.cumsum(start) - 1
    codes = int(start.sum())
    return Keys(key, doc, number, code[start], np.bincount(number[fresh], minlength=codes), np.bincount(number, minlength=codes) > EXACT, extra)


Extract = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def by_chunks(texts: list[bytes], one: Callable[[Words], tuple[np.ndarray, np.ndarray]]):
    """Run ``one`` on bounded chunks of texts; it returns parallel arrays and the number per text."""
    keys, docs, extras = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for first, part in chunks(texts):
        key, per_text, extra = one(split_words(part))
        keys.append(key)
        docs.append(first + np.repeat(np.arange(len(part)), per_text))
        extras.append(extra if extra is not None else np.empty(0, np.int64))
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(extras)


def _texts(table: pa.Table) -> list[bytes]:
    return table["text"].cast(pa.binary()).to_pylist()


def with_frequencies(
    docs: DataFrame,
    sizes: Sizes,
    extract: Callable[[Words], tuple[np.ndarray, np.ndarray, np.ndarray | None]],
    finish: Callable[[list, list[bytes], Keys, np.ndarray], pa.Table],
    schema: str,
    empty: pa.Schema,
) -> DataFrame:
    """``finish(doc_ids, texts, keys, class of each pair)`` for every block.

    ``extract`` gives keys, their number per text, and optionally a value for
    each (then repeats within a text are kept).
    """
    log_fragments = sizes.log_fragments
    base = dealt(docs, sizes)

    def block_keys(table: pa.Table) -> tuple[list[bytes], Keys]:
        table = table.sort_by([("doc_id", "ascending")])
        texts = _texts(table)
        key, doc, extra = by_chunks(texts, extract)
        return texts, keys_of(key, doc, log_fragments, extra if len(extra) == len(key) and len(extra) else None)

    def send(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        block = table["block"][0].as_py()
        _, keys = block_keys(table)
        fragment = (keys.codes >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(fragment, np.arange((1 << log_fragments) + 1))
        low = keys.codes.astype(np.uint32)
        held = (np.minimum(keys.code_docs, OFTEN - 1) + OFTEN * keys.code_often).astype(np.uint16)
        there = np.flatnonzero(np.diff(cuts))
        return pa.table(
            {
                "fragment": pa.array(there, pa.int32()),
                "block": pa.array(np.full(len(there), block), pa.int64()),
                "codes": pa.array([low[cuts[f] : cuts[f + 1]].tobytes() for f in there], pa.binary()),
                "held": pa.array([held[cuts[f] : cuts[f + 1]].tobytes() for f in there], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        codes = [np.frombuffer(b, np.uint32) for b in table["codes"].to_pylist()]
        held = np.concatenate([np.frombuffer(b, np.uint16) for b in table["held"].to_pylist()])
        _, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        documents = np.bincount(inverse, weights=held % OFTEN)
        often = (np.bincount(inverse, weights=held // OFTEN) > 0) & (documents > 1)
        classes = np.maximum(frequency_class(documents), np.where(often, EXACT + 1, 0)).astype(np.uint8)[inverse]
        ends = np.cumsum([len(c) for c in codes])
        said = [classes[e - len(c) : e].tobytes() for c, e in zip(codes, ends)]
        return pa.table({"block": table["block"], "fragment": table["fragment"], "classes": pa.array(said, pa.binary())})

    def close(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return empty.empty_table()
        table = _ordered(table)
        texts, keys = block_keys(table)
        said = sorted(zip(answers["fragment"].to_pylist(), answers["classes"].to_pylist()))
        classes = np.frombuffer(b"".join(c for _, c in said), np.uint8)
        return finish(table["doc_id"].to_pylist(), texts, keys, classes[keys.code] if len(keys.code) else np.empty(0, np.uint8))

    sent = base.groupBy("block").applyInArrow(send, "fragment int, block long, codes binary, held binary")
    answers = sent.groupBy("fragment").applyInArrow(answer, "block long, fragment int, classes binary")
    return base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(close, schema)


def _ordered(table: pa.Table) -> pa.Table:
    """One order of rows, whatever order they arrived in."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
