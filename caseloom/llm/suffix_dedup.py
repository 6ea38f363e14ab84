"""Passages that repeat across documents, by sparse suffix arrays.

Of a document's word suffixes only those at minimiser positions stay: in each
window of consecutive word runs, the run with the smallest hash. Positions
depend on content alone, so two copies of a passage keep the same ones. A
passage of ``min_words`` words has a kept suffix within its first ``window``
words, and at least ``head`` words of the passage follow it. Suffixes whose
head occurs in one document only cannot match and are dropped by the counts.
The others are sorted by what follows. Where a head has few suffixes, each is
compared with its neighbours, and matches are extended to the right and to the
left. Where it has more, its suffixes are classed by each window of
``min_words`` words around the head, so that no match depends on a suffix's
place in the order, and every window knows the smallest id that has it. Heads
of more than 200 documents are dealt into blocks by document; blocks tell
fragments of the windows which ids they have, and hear which windows others
have too. So a head makes no task large. Overlapping spans are joined.

Words are lower-cased (A-Z) runs between white space and compared by 32 bits of
their hash (a span could be a word too long once in 2^32 spans), windows by 64.
Null, empty and short texts have no spans; an empty table gives no rows. Other
columns are ignored. Repeated rows match each other when their ids differ.
Different texts that share an id are documents of their own, and count as later
than all others; equal rows of one id are one document. A null id takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .rows import fresh, numbered, shared_ids, text_key
from .scratch import cut
from .words import Words, chunks, mix, split_words

MIN_WORDS = 50
#: Words of a run, and runs in a window of which one is kept.
RUN, WINDOW = 8, 16
#: Neighbours of other documents compared on each side: all of a head with NEAR + 1 suffixes. Larger heads go by windows.
NEAR = 2
#: Suffixes whose windows are worked out at once.
ROWS = 8192
#: Bytes of text whose suffixes of rarer heads share a task's group, on average.
CELL_BYTES = 1 << 20
#: Documents in a block of a frequent head: the least, and this many times the root of all its documents.
BLOCK_DOCS, ROOTS = 256, 16
#: Places of one document in a block.
BLOCK_TURNS = 8

_SUFFIXES = "cell long, head long, right binary, doc_id long, pos int, left binary, parts int"
_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
_NAMES = ["cell", "head", "right", "doc_id", "pos", "left", "parts"]
_FOUND = "doc_id long, start int, stop int, other long, block long, fragment long, packed binary"
_FOUND_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("other", pa.int64()), ("block", pa.int64()), ("fragment", pa.int64()), ("packed", pa.binary())]
)


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values, for those positions where it fits."""
    part = np.full(max(0, len(h) - n + 1), np.uint64(n), dtype=np.uint64)
    for k in range(n):
        part = part * np.uint64(0x9FB21C651E98DF25) + h[k : k + len(part)]
    return mix(part)


def _range_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values, doubling so that long runs cost few passes."""
    have, size = {1: h}, 1
    while size * 2 <= n:
        one = have[size]
        have[size * 2] = mix(one[: len(one) - size] * np.uint64(0x9FB21C651E98DF25) + one[size:]) if len(one) > size else np.empty(0, np.uint64)
        size *= 2
    out, at = None, 0
    for bit in sorted(have, reverse=True):
        if n - at >= bit:
            length = max(0, len(h) - n + 1)
            piece = have[bit][at : at + length]
            out = piece if out is None else mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + piece)
            at += bit
    return out


def kept_suffixes(words: Words, min_words: int, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head hashes, number per text, positions in the text) of suffixes at minimiser positions."""
    h, count = words.hash, words.per_text
    none = np.empty(0, np.uint64), np.zeros(len(count), np.int64), np.empty(0, np.int64)
    if len(h) < min_words:
        return none
    first = np.cumsum(count) - count
    runs = _rolled(h, RUN)
    # The leftmost of the smallest: 32 bits of the hash, then the place.
    value = (runs >> np.uint64(32) << np.uint64(32)) | np.arange(len(runs), dtype=np.uint64)
    size = 1
    while size < WINDOW:
        value = np.minimum(value[: len(value) - size], value[size:])
        size *= 2
    step = np.zeros(len(h) + 1, np.int32)
    long = count >= min_words
    np.add.at(step, first[long], 1)
    np.add.at(step, (first + count - (RUN + WINDOW - 2))[long], -1)
    valid = np.cumsum(step[:-1])[: len(value)] > 0
    picked = np.unique((value[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    text = np.searchsorted(first, picked, side="right") - 1
    # An empty text shares its first word with the next; take the one that has words.
    fits = picked + head <= first[text] + count[text]
    picked, text = picked[fits], text[fits]
    return _range_hash(h, head)[picked], np.bincount(text, minlength=len(count)), picked - first[text]


def suffix_table(docs: DataFrame, min_words: int, window: int = WINDOW) -> DataFrame:
    """Suffixes whose head occurs in two documents, with what follows and what precedes, and the group that compares them.

    ``cell`` is negative for the blocks of a frequent head, which has ``parts`` of them.
    """
    head = min_words - window + 1
    right, left = head + window + 2, window + 2
    sizes = blocks.plan(docs, 0.03)
    cells = np.uint64(max(1, sizes.bytes // CELL_BYTES))

    def extract(words):
        return kept_suffixes(words, min_words, head)

    def finish(doc_ids, texts, keys, classes):
        good = classes >= 2
        ids = np.array([-1 if d is None else d for d in doc_ids], np.int64)
        known = np.array([d is not None for d in doc_ids], bool)
        key, doc, pos = keys.key[good], keys.doc[good], keys.extra[good] if keys.extra is not None else np.empty(0, np.int64)
        order = np.argsort(doc, kind="stable")
        key, doc, pos, cls = key[order], doc[order], pos[order], classes[good][order]
        shared = blocks.documents_of(cls)
        parts = np.where(cls > blocks.EXACT, np.ceil(shared / np.maximum(BLOCK_DOCS, ROOTS * np.sqrt(shared))), 0).astype(np.int64)
        # A document's further places of one head go to further blocks.
        opens = np.ones(len(key), bool)
        opens[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(opens)
        turn = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        dealt = mix(ids[doc].view(np.uint64)) % np.maximum(parts, 1).astype(np.uint64) + (turn // BLOCK_TURNS).astype(np.uint64) * np.uint64(1 << 32)
        cell = np.where(parts > 0, -(mix(key ^ mix(dealt)) >> np.uint64(1)).astype(np.int64) - 1, (key % cells).astype(np.int64))
        out: list[list] = [[] for _ in _NAMES]
        cuts = np.searchsorted(doc, np.arange(len(doc_ids) + 1))
        for first, part in chunks(texts):
            part_cuts = cuts[first : first + len(part) + 1]
            if part_cuts[-1] == part_cuts[0]:
                continue
            words = split_words(part)
            small = (words.hash >> np.uint64(32)).astype(">u4")
            base = np.cumsum(words.per_text) - words.per_text
            for k in range(len(part)):
                a, b = part_cuts[k], part_cuts[k + 1]
                if a == b or not known[first + k]:
                    continue
                own = small[base[k] : base[k] + words.per_text[k]]
                back = own[::-1]
                n = len(own)
                where = pos[a:b].tolist()
                out[0] += cell[a:b].tolist()
                out[1] += key[a:b].view(np.int64).tolist()
                out[2] += [own[p : p + right].tobytes() for p in where]
                out[3] += [int(ids[first + k])] * (b - a)
                out[4] += where
                out[5] += [back[n - p : n - p + left].tobytes() for p in where]
                out[6] += parts[a:b].tolist()
        return pa.table([pa.array(c, t) for c, t in zip(out, _TYPES)], names=_NAMES)

    return blocks.with_frequencies(docs, sizes, extract, finish, _SUFFIXES, pa.schema(list(zip(_NAMES, _TYPES))))


def _padded(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of uint32, number in each row) of packed word lists."""
    lengths = np.fromiter((len(b) // 4 for b in blobs), np.int64, len(blobs))
    width = int(lengths.max(initial=0))
    out = np.zeros((len(blobs), width), np.uint32)
    flat = np.frombuffer(b"".join(blobs), np.uint32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out, lengths


def _common(x: np.ndarray, nx: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of rows a and b."""
    if not x.shape[1]:
        return np.zeros(len(a), np.int64)
    differ = x[a] != x[b]
    reach = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return np.minimum(reach, np.minimum(nx[a], nx[b]))


def _near_pairs(doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row with the nearest row before and after it of another document, and those with the next such rows."""
    n = len(doc)
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    run = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))
    starts, ends = edge, np.concatenate([edge[1:], [n]]) - 1
    pairs = []
    for step in range(1, NEAR + 1):
        ahead = np.flatnonzero(run + step < len(starts))
        pairs.append((ahead, starts[run[ahead] + step]))
        behind = np.flatnonzero(run >= step)
        pairs.append((ends[run[behind] - step], behind))
    return [(a[doc[a] != doc[b]], b[doc[a] != doc[b]]) for a, b in pairs]


def compare_neighbours(head, right, doc, pos, left, min_words: int) -> list[tuple[np.ndarray, ...]]:
    """Spans (doc, start, stop, other) of matches between neighbours of sorted suffixes."""
    r, nr = _padded(right)
    lft, nl = _padded(left)
    spans = []
    for a, b in _near_pairs(doc):
        ok = head[a] == head[b]
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        after, before = _common(r, nr, a, b), _common(lft, nl, a, b)
        ok = after + before >= min_words
        a, b, after, before = a[ok], b[ok], after[ok], before[ok]
        spans.append((doc[a], pos[a] - before, pos[a] + after, doc[b]))
        spans.append((doc[b], pos[b] - before, pos[b] + after, doc[a]))
    return spans


def windows_around(right: list[bytes], left: list[bytes], min_words: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, words before the suffix, hash) of each window of ``min_words`` words that holds a row's head."""
    factor = np.uint64(0x9FB21C651E98DF25)
    away = np.uint64(pow(0x9FB21C651E98DF25, min_words, 1 << 64))
    found = []
    for at in range(0, len(right), ROWS):
        r, nr = _padded(right[at : at + ROWS])
        lft, nl = _padded(left[at : at + ROWS])
        back = min(window - 1, lft.shape[1])
        line = mix(np.concatenate([lft[:, :back][:, ::-1], r], axis=1).astype(np.uint64) + np.uint64(1))
        sums = np.zeros((len(line), line.shape[1] + 1), np.uint64)
        for k in range(line.shape[1]):
            sums[:, k + 1] = sums[:, k] * factor + line[:, k]
        for before in range(back + 1):
            start = back - before
            if start + min_words > line.shape[1]:
                continue
            rows = np.flatnonzero((nl >= before) & (nr >= min_words - before))
            value = mix(sums[rows, start + min_words] - sums[rows, start] * away)
            found.append((rows + at, np.full(len(rows), before), value.view(np.int64)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def two_smallest(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, smallest id of each, next id, whether there is a next)."""
    order = np.lexsort((doc, value))
    v, d = value[order], doc[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[fresh], d[fresh]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
    second = np.minimum(first + 1, len(v) - 1)
    return v[first], d[first], d[second], (second > first) & (v[second] == v[first])


def class_spans(value: np.ndarray, doc: np.ndarray, start: np.ndarray, min_words: int, classes) -> list[tuple[np.ndarray, ...]]:
    """Spans (doc, start, stop, other) of all windows that two documents have, with the smallest other document.

    ``classes``: distinct values in order, smallest id, next id, whether there is a next.
    """
    values, least, next_, shared = classes
    if not len(values):
        return []
    k = np.minimum(np.searchsorted(values, value), len(values) - 1)
    ok = shared[k] & (values[k] == value)
    k, doc, start = k[ok], doc[ok], start[ok]
    other = np.where(least[k] == doc, next_[k], least[k])
    # Windows in a row with the same partner are one span.
    order = np.lexsort((start, other, doc))
    doc, start, other = doc[order], start[order], other[order]
    opens = np.ones(len(doc), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(doc)]]) - 1 if len(first) else first
    return [(doc[first], start[first], start[last] + min_words, other[first])]


def _span_table(spans: list[tuple[np.ndarray, ...]]) -> pa.Table:
    """Of spans from one place the longest, with its smallest partner."""
    if not spans:
        return _FOUND_SCHEMA.empty_table()
    doc, start, stop, other = (np.concatenate([s[k] for s in spans]) for k in range(4))
    order = np.lexsort((other, -stop, start, doc))
    doc, start, stop, other = doc[order], start[order], stop[order], other[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    n = int(first.sum())
    return pa.table([doc[first], start[first].astype(np.int32), stop[first].astype(np.int32), other[first], *(pa.nulls(n, t) for t in _FOUND_SCHEMA.types[4:])], schema=_FOUND_SCHEMA)


def raw_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, stop (words), other: matches of at least ``min_words`` words, not yet joined.

    Each window that repeats comes with the smallest id among the other documents that have it.
    """

    def compare(table: pa.Table) -> pa.Table:
        """Spans of the rarer heads of a cell; of a block of a frequent head, its windows and what it tells the fragments."""
        table = table.sort_by([(c, "ascending") for c in ("head", "right", "doc_id", "pos")])
        if table["cell"][0].as_py() < 0:
            return tell(table)
        _, number, times = np.unique(table["head"].to_numpy(), return_inverse=True, return_counts=True)
        few = times[number] <= NEAR + 1
        part = table.filter(pa.array(few & (times[number] > 1)))
        spans = compare_neighbours(*columns(part), min_words) if part.num_rows else []
        many = table.filter(pa.array(~few))
        if many.num_rows:
            _, right, doc, pos, left = columns(many)
            row, before, value = windows_around(right, left, min_words)
            spans += class_spans(value, doc[row], pos[row] - before, min_words, two_smallest(value, doc[row]))
        return _span_table(spans)

    def columns(table: pa.Table):
        return table["head"].to_numpy(), table["right"].to_pylist(), table["doc_id"].to_numpy(), table["pos"].to_numpy().astype(np.int64), table["left"].to_pylist()

    def tell(table: pa.Table) -> pa.Table:
        block = table["cell"][0].as_py()
        head, right, doc, pos, left = columns(table)
        row, before, value = windows_around(right, left, min_words)
        if not len(row):
            return _FOUND_SCHEMA.empty_table()
        doc_, start = doc[row], pos[row] - before
        values, least, next_, more = two_smallest(value, doc_)
        _, at = np.unique(value, return_index=True)
        parts = table["parts"].to_numpy()[row[at]].astype(np.uint64)
        fragment = mix(head[row[at]].view(np.uint64) + values.view(np.uint64) % parts).view(np.int64)
        order = np.argsort(fragment, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(fragment[order]) != 0, [True]]))
        next_ = np.where(more, next_, least)
        packed = [np.array([doc_, start, value]).tobytes()]
        packed += [np.array([values[order[a:b]], least[order[a:b]], next_[order[a:b]]]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        n = len(packed)
        fragments = pa.array([None, *fragment[order[cuts[:-1]]].tolist()], pa.int64())
        return pa.table([*(pa.nulls(n, t) for t in _FOUND_SCHEMA.types[:4]), pa.array([block] * n), fragments, pa.array(packed, pa.binary())], schema=_FOUND_SCHEMA)

    def unpacked(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, np.int64).reshape(3, -1)

    def answer(table: pa.Table) -> pa.Table:
        told = [unpacked(b) for b in table["packed"].to_pylist()]
        every = np.concatenate(told, axis=1)
        values, least, next_, more = two_smallest(np.concatenate([every[0], every[0]]), np.concatenate([every[1], every[2]]))
        out = []
        for t in told:
            k = np.searchsorted(values, t[0])
            k = k[more[k]]
            out.append(np.array([values[k], least[k], next_[k]]).tobytes())
        return pa.table({"block": table["block"], "packed": pa.array(out, pa.binary())})

    def close(table: pa.Table, answers: pa.Table) -> pa.Table:
        spans = []
        if table.num_rows and answers.num_rows:
            heard = np.concatenate([unpacked(b) for b in answers["packed"].to_pylist()], axis=1)
            heard = heard[:, np.argsort(heard[0], kind="stable")]
            classes = heard[0], heard[1], heard[2], np.ones(heard.shape[1], bool)
            for blob in table["packed"].to_pylist():
                doc, start, value = unpacked(blob)
                spans += class_spans(value, doc, start, min_words, classes)
        return _span_table(spans)

    found = cut(suffix_table(docs, min_words).groupBy("cell").applyInArrow(compare, _FOUND), "suffixes")
    said = found.where("fragment is not null").select("block", "fragment", "packed").groupBy("fragment").applyInArrow(answer, "block long, packed binary")
    own = found.where("block is not null and fragment is null").select("block", "packed")
    closed = own.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(close, _FOUND)
    names = ["doc_id", "start", "stop", "other"]
    return found.where("block is null").select(*names).unionByName(closed.select(*names))


JOINED = "doc_id long, start int, stop int, n_words int, other long, repeats_earlier boolean"


def joined_spans(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a document as one, apart for those that repeat an earlier document.

    ``repeats_earlier`` spans have a partner with a smaller id, so cutting them
    everywhere leaves the passage in the document with the smallest id. The
    other spans are the whole extent of what repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None
        out: list[list] = [[], [], [], [], [], []]

        def close():
            for column, value in zip(out, (open_[0], open_[2], open_[3], open_[3] - open_[2], open_[4], open_[1])):
                column.append(value)

        def flush():
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "start", "stop", "n_words", "other", "repeats_earlier"])
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for doc, earlier, start, stop, other in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ and open_[0] == doc and open_[1] == earlier and start <= open_[3]:
                    open_[3], open_[4] = max(open_[3], stop), min(open_[4], other)
                    continue
                if open_:
                    close()
                open_ = [doc, earlier, start, stop, other]
            if out[0]:
                yield flush()
        if open_:
            close()
        if out[0]:
            yield flush()

    kinds = F.explode(F.when(F.col("other") < F.col("doc_id"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    return (
        spans.groupBy("doc_id", "start", "stop")
        .agg(F.min("other").alias("other"))
        .withColumn("repeats_earlier", kinds)
        .select("doc_id", "repeats_earlier", "start", "stop", "other")
        .repartition("doc_id")
        .sortWithinPartitions("doc_id", "repeats_earlier", "start", "stop")
        .mapInArrow(run, JOINED)
    )


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All repeated passages of ``docs`` (doc_id, text), as word ranges of their documents.

    ``text_key`` tells which text is meant where different texts share the id, and is null elsewhere.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = shared_ids(docs)
    if shared is None:
        return joined_spans(raw_spans(docs, min_words)).withColumn("text_key", F.lit(None).cast("long"))
    rows = numbered(docs, shared, "row")
    names = cut(rows.where("row <> doc_id").select("row", F.col("doc_id").alias("id"), text_key().alias("text_key")).distinct(), "row-names")
    spans = joined_spans(raw_spans(rows.select(F.col("row").alias("doc_id"), "text"), min_words))
    other = names.select(F.col("row").alias("other"), F.col("id").alias("other_id"))
    spans = spans.join(names.withColumnRenamed("row", "doc_id"), "doc_id", "left").join(other, "other", "left")
    return spans.select(F.coalesce("id", "doc_id").alias("doc_id"), "start", "stop", "n_words", F.coalesce("other_id", "other").alias("other"), "repeats_earlier", "text_key")


def cut_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the passages that repeat an earlier document.

    Spans with a ``text_key`` apply to rows of that text only. A document left
    without words goes; all columns stay, ``n_chars`` is counted anew where it
    is present. Rows without spans are untouched.
    """
    columns, kinds = docs.columns, dict(docs.dtypes)
    names = [fresh(n, columns) for n in ("cut_id", "cut_text", "cut_spans")]
    per_doc = spans.where("repeats_earlier").groupBy(F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1])).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(names[2]))
    place, counted = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def shortened(text: bytes, ranges: list[dict]) -> str:
        words = split_words([text])
        keep = np.ones(len(text), bool)
        for span in ranges:
            if span["start"] < len(words.start):
                stop = words.start[span["stop"]] if span["stop"] < len(words.start) else len(text)
                keep[words.start[span["start"]] : stop] = False
        return np.frombuffer(text, np.uint8)[keep].tobytes().strip().decode("utf-8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(len(columns)).to_pylist()
            rest = list(batch.columns[: len(columns)])
            touched = [k for k, r in enumerate(ranges) if r]
            if touched:
                texts = rest[place].to_pylist()
                stay = np.ones(len(texts), bool)
                for k in touched:
                    texts[k] = shortened((texts[k] or "").encode("utf-8"), ranges[k])
                    stay[k] = bool(texts[k])
                rest[place] = pa.array(texts, pa.string())
                if counted is not None:
                    sizes = rest[counted].to_pylist()
                    for k in touched:
                        sizes[k] = len(texts[k])
                    rest[counted] = pa.array(sizes, rest[counted].type)
                yield pa.RecordBatch.from_arrays(rest, names=columns).filter(pa.array(stay))
            else:
                yield pa.RecordBatch.from_arrays(rest, names=columns)

    # One pass over the joined rows: two filtered branches would shuffle the texts twice.
    meant = (F.col("doc_id").cast("long") == F.col(names[0])) & (F.col(names[1]).isNull() | (F.col(names[1]) == text_key()))
    return docs.join(per_doc, meant, "left").select(*columns, names[2]).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
