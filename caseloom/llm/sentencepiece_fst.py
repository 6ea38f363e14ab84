"""SentencePiece BPE with byte fallback as a weighted finite-state transducer.

Three machines are compiled from the model file: the normaliser (dummy prefix
and white space to U+2581), the pieces (an arc from a position over each piece
that matches), and byte fallback (arcs over characters that no piece has). Their
composition with an input has a state for each (position, last piece). Merge
order is in the weights: an arc costs 1 where its piece may follow the last one,
and infinity where a merge would have joined across the two; a sequence of
pieces is what BPE makes exactly if no neighbours are so. The result is the
shortest path in the tropical semiring. Summed piece scores, the weights of a
unigram model, would give other ids than this model's own encoder.

No piece spans white space, so the path splits there: stretches are composed
one by one, all distinct ones of a chunk together in numpy, shortest path by
shortest path over their positions. Runs of U+2581, whose merges tie, are
compiled apart with the leftmost tie first.

Null text counts as empty and has no ids. Decoding undoes white space and byte
fallback; a U+2581 in the text comes back as a blank, as in the reference codec
of the model format. Invalid bytes decode to U+FFFD.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_ids import Remembering
from .words import Words, hash_ranges

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
INF = np.int64(1) << 40
#: Ids from here on stand for a character without a piece.
FALLBACK = 1 << 21
#: Pairs that are gathered before they go in among those known, and pairs known before a worker starts afresh.
FRESH_PAIRS, KNOWN_PAIRS = 1 << 15, 2_000_000


def _fields(blob: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbered fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, blob[at : at + size]
            at += size
        elif kind == 2:
            size = varint()
            yield key >> 3, blob[at : at + size]
            at += size
        else:
            raise ValueError("not a model file")


@dataclass
class Model:
    """What the machines need of a model file."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool

    @staticmethod
    def read(path: str) -> Model:
        pieces, scores, kinds, rules = [], [], [], {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    own = dict(_fields(value))
                    pieces.append(own.get(1, b"").decode("utf-8"))
                    scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                    kinds.append(own.get(3, NORMAL))
                elif number == 3:
                    rules = dict(_fields(value))
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or USER in kinds:
            raise ValueError("the normaliser or pieces of this model are not supported")
        return Model(pieces, scores, kinds, bool(rules.get(3, 1)))


class Transducer:
    """The compiled machines."""

    def __init__(self, model: Model):
        self.dummy_prefix = model.dummy_prefix
        self.bytes = {model.pieces[k]: k for k, t in enumerate(model.kinds) if t == BYTE}
        self.byte_id = np.array([self.bytes[f"<0x{b:02X}>"] for b in range(256)], np.uint32)
        normal = {p: k for k, (p, t) in enumerate(zip(model.pieces, model.kinds)) if t == NORMAL}
        self.run_pieces = {len(p): k for p, k in normal.items() if set(p) == {SPACE}}
        text = {p: k for p, k in normal.items() if len(p) == 1 or SPACE not in p[1:]}
        if any(c not in normal for p in text for c in p):
            raise ValueError("a piece has a character that is no piece")
        size = len(model.pieces)
        order = sorted((k for p, k in text.items() if len(p) > 1), key=lambda k: -model.scores[k])
        self.rank = np.full(size, -1, np.int64)
        self.rank[order] = np.arange(len(order))
        self.left, self.right = np.arange(size), np.arange(size)
        merges = {}
        for k in order:
            split = self._split(model.pieces[k], text)
            if split is None:  # no merge leads to it
                self.rank[k] = INF
                continue
            self.left[k], self.right[k] = split
            merges[(int(split[0]) << 22) | int(split[1])] = int(self.rank[k])
        self.merge_key = np.array(sorted(merges), np.int64)
        self.merge_rank = np.array([merges[k] for k in sorted(merges)], np.int64)
        self.longest = max((len(p) for p in text), default=1)
        reached = {p: k for p, k in text.items() if len(p) == 1 or self.rank[k] < INF}
        by_length: dict[int, tuple[list, list]] = {}
        for p, k in reached.items():
            keys, ids = by_length.setdefault(len(p), ([], []))
            keys.append(self._piece_hash(p))
            ids.append(k)
        self.arcs = {}
        for length, (keys, ids) in by_length.items():
            if len(set(keys)) < len(keys):
                raise ValueError("two pieces of this model share a hash")
            sorting = np.argsort(np.array(keys, np.uint64))
            codes = np.frombuffer("".join(model.pieces[k] for k in ids).encode("utf-32-le"), np.uint32).reshape(-1, length)
            self.arcs[length] = (np.array(keys, np.uint64)[sorting], np.array(ids, np.int64)[sorting], codes[sorting])
        self.known = np.empty(0, np.int64), np.empty(0, bool)
        self.fresh = np.empty(0, np.int64), np.empty(0, bool)
        self.runs_known: dict[int, np.ndarray] = {}
        spelled = []
        for k, (p, t) in enumerate(zip(model.pieces, model.kinds)):
            spelled.append(bytes([int(p[3:5], 16)]) if t == BYTE else (b"" if t in (CONTROL, UNKNOWN) else p.replace(SPACE, " ").encode("utf-8")))
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        sizes = np.array([len(s) for s in spelled], np.int64)
        self.spelled_size, self.spelled_at = sizes, np.cumsum(sizes) - sizes

    @staticmethod
    def _piece_hash(piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * 0x100000001B3 + ord(c) + 1) & ((1 << 64) - 1)
        return value

    def _split(self, piece: str, text: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces whose merge makes ``piece`` when all earlier merges are done first."""
        limit = self.rank[text[piece]]
        parts = list(piece)
        while len(parts) > 2:
            best = None
            for k in range(len(parts) - 1):
                joined = text.get(parts[k] + parts[k + 1])
                if joined is not None and self.rank[joined] < limit and (best is None or self.rank[joined] < best[0]):
                    best = (self.rank[joined], k)
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (text[parts[0]], text[parts[1]]) if len(parts) == 2 else None

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge joins across a and b: the youngest merge on either side of the cut is undone step by step."""
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a < FALLBACK) & (b < FALLBACK) & (a >= 0))
        a, b = a[at].copy(), b[at].copy()
        limit = np.full(len(at), INF, np.int64)
        while len(at):
            key = (a << 22) | b
            place = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
            joined = np.where(self.merge_key[place] == key, self.merge_rank[place], INF)
            bad = joined < limit
            out[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            leaf_a, leaf_b = self.right[a] == a, self.left[b] == b
            undo_a = np.where(ra > rb, ~leaf_a, leaf_b & ~leaf_a)
            done = bad | (leaf_a & leaf_b)
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            go = ~done
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return out

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`may_follow`, each distinct pair worked out once."""
        easy = (a < 0) | (a >= FALLBACK) | (b >= FALLBACK)
        out = easy.copy()
        hard = np.flatnonzero(~easy)
        if not len(hard):
            return out
        uniq, inverse = np.unique((a[hard] << 22) | b[hard], return_inverse=True)
        follow = np.empty(len(uniq), bool)
        rest = np.arange(len(uniq))
        for pairs, said in (self.known, self.fresh):
            place = np.searchsorted(pairs, uniq[rest])
            there = place < len(pairs)
            there[there] = pairs[place[there]] == uniq[rest[there]]
            follow[rest[there]] = said[place[there]]
            rest, place = rest[~there], place[~there]
        if len(rest):
            new = uniq[rest]
            follow[rest] = self.may_follow(new >> 22, new & ((1 << 22) - 1))
            self.fresh = np.insert(self.fresh[0], place, new), np.insert(self.fresh[1], place, follow[rest])
            if len(self.fresh[0]) > FRESH_PAIRS:  # a few at a time would copy all known ones each time
                if len(self.known[0]) > KNOWN_PAIRS:
                    self.known = np.empty(0, np.int64), np.empty(0, bool)
                place = np.searchsorted(self.known[0], self.fresh[0])
                self.known = tuple(np.insert(old, place, more) for old, more in zip(self.known, self.fresh))
                self.fresh = np.empty(0, np.int64), np.empty(0, bool)
        out[hard] = follow[inverse]
        return out

    def shortest_paths(self, stretches: list[str]) -> list[list[int]]:
        """Ids of each stretch; all are composed at once, position by position."""
        n, width = len(stretches), max(map(len, stretches))
        lengths = np.fromiter((len(s) for s in stretches), np.int64, n)
        codes = np.zeros((n, width), np.int64)
        codes[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)
        cost = np.full((n, width + 1), INF, np.int64)
        last = np.full((n, width + 1), -1, np.int64)
        back = np.zeros((n, width + 1), np.int64)
        cost[:, 0] = 0
        step = np.uint64(0x100000001B3)
        with np.errstate(over="ignore"):
            for stop in range(1, width + 1):
                rows = np.flatnonzero(lengths >= stop)
                suffix, power = np.zeros(len(rows), np.uint64), np.uint64(1)
                for length in range(1, min(self.longest, stop) + 1):
                    start = stop - length
                    suffix += (codes[rows, start].astype(np.uint64) + np.uint64(1)) * power
                    power = power * step
                    if length not in self.arcs:
                        continue
                    keys, ids, spelled = self.arcs[length]
                    place = np.minimum(np.searchsorted(keys, suffix), len(keys) - 1)
                    there = keys[place] == suffix
                    if length > 2:  # hashes only narrow the search: the letters decide (one or two letters have a hash of their own)
                        hit = np.flatnonzero(there)
                        if len(hit):
                            there[hit] = (codes[rows[hit], start:stop] == spelled[place[hit]]).all(axis=1)
                    piece = np.where(there, ids[place], FALLBACK + codes[rows, start]) if length == 1 else ids[place]
                    use = np.arange(len(rows)) if length == 1 else np.flatnonzero(there)
                    if not len(use):
                        continue
                    r, piece = rows[use], piece[use]
                    total = cost[r, start] + 1
                    total[~self._follows(last[r, start], piece)] = INF
                    better = total < cost[r, stop]
                    r, piece, total = r[better], piece[better], total[better]
                    cost[r, stop], last[r, stop], back[r, stop] = total, piece, start
        out = []
        ends, lasts, backs = lengths.tolist(), last.tolist(), back.tolist()
        for k in range(n):
            at, ids = ends[k], []
            while at:
                ids.append(lasts[k][at])
                at = backs[k][at]
            out.append(ids[::-1])
        return out

    def space_run(self, n: int) -> np.ndarray:
        """Ids of n U+2581: merges tie, so the leftmost goes first."""
        if n not in self.runs_known:
            if len(self.runs_known) > 4096:
                self.runs_known.clear()
            size, right, left = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
            heap = [(k, 2) for k in range(n - 1)] if 2 in self.run_pieces else []
            heapq.heapify(heap)
            while heap:
                k, want = heapq.heappop(heap)
                if not size[k] or right[k] >= n or size[k] + size[right[k]] != want:
                    continue
                gone = right[k]
                size[k], size[gone], right[k] = want, 0, right[gone]
                if right[k] < n:
                    left[right[k]] = k
                    if size[k] + size[right[k]] in self.run_pieces:
                        heapq.heappush(heap, (k, size[k] + size[right[k]]))
                if left[k] >= 0 and size[left[k]] + size[k] in self.run_pieces:
                    heapq.heappush(heap, (left[k], size[left[k]] + size[k]))
            self.runs_known[n] = np.array([self.run_pieces[s] for s in size if s], np.uint32)
        return self.runs_known[n]

    def encode_stretches(self, stretches: list[str]) -> list[np.ndarray]:
        """Ids of stretches: some U+2581, then characters other than U+2581."""
        bodies, spaces = [], []
        for s in stretches:
            body = s.lstrip(SPACE)
            n = len(s) - len(body)
            spaces.append(n)
            bodies.append((SPACE if n else "") + body)
        paths: list[list[int]] = [[]] * len(stretches)
        by_width: dict[int, list[int]] = {}
        for k, b in enumerate(bodies):
            if b and b != SPACE:
                by_width.setdefault(max(8, 1 << (len(b) - 1).bit_length()), []).append(k)
        for width, at in by_width.items():
            most = max(1, (1 << 21) // width)
            for lo in range(0, len(at), most):
                for k, path in zip(at[lo : lo + most], self.shortest_paths([bodies[k] for k in at[lo : lo + most]])):
                    paths[k] = path
        out, alone = [], self.run_pieces[1]
        for n, path in zip(spaces, paths):
            head = None
            if n and not path:
                head = self.space_run(n)
            elif n > 1:  # the one before the letters is a piece by itself, or part of theirs
                head, path = (self.space_run(n), path[1:]) if path[0] == alone else (self.space_run(n - 1), path)
            if path and max(path) >= FALLBACK:
                path = [y for x in path for y in ([x] if x < FALLBACK else self.byte_id[list(chr(x - FALLBACK).encode("utf-8"))].tolist())]
            ids = np.array(path, np.uint32)
            out.append(ids if head is None else np.concatenate([head, ids]))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of ids, as UTF-8."""
        size = self.spelled_size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.spelled[np.repeat(self.spelled_at[ids] - (ends - size), size) + np.arange(total)].tobytes() if total else b""
        if self.dummy_prefix and raw[:1] == b" " and len(ids) and self.spelled[self.spelled_at[ids[0]]] == 32:
            raw = raw[1:]
        return raw


class Encoder(Remembering):
    """Composition of whole texts, stretch by stretch, each distinct stretch once."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def runs(self, texts: list[bytes]) -> Words:
        prefix = b" " if self.machine.dummy_prefix else b""
        texts = [prefix + t.replace(b"\xe2\x96\x81", b" ") if t else b"" for t in texts]
        raw = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        n = len(raw) - 1
        begins = np.zeros(n + 1, bool)
        begins[(ends - lengths)[lengths > 0]] = True
        space, line = raw[:n] == 32, raw[:n] == 10
        begins[1:n] |= space[1:] & ~space[:-1]
        begins[:n] |= line
        begins[1:n] |= line[:-1]
        start = np.flatnonzero(begins[:n])
        stop = np.append(start[1:], n)[: len(start)]
        per_text = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
        return Words(hash_ranges(raw, start, stop), start, stop, per_text, ends - lengths, raw)

    def encode_runs(self, words: Words, new: np.ndarray) -> list[np.ndarray]:
        blob = words.raw.tobytes()
        return self.machine.encode_stretches([blob[a:b].decode("utf-8").replace(" ", SPACE) for a, b in zip(words.start[new].tolist(), words.end[new].tolist())])


_machines: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One compiled machine a worker process and model file."""
    if path not in _machines:
        _machines[path] = Encoder(Transducer(Model.read(path)))
    return _machines[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            ids = list(encoder(path).encode(batch.column(1).cast(pa.binary()).to_pylist()))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""

    def run(batches):
        for batch in batches:
            machine = encoder(path).machine
            texts = [machine.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian uint32) and whether decoding gives the text back."""

    def run(batches):
        for batch in batches:
            codec = encoder(path)
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = [(len(ids), zlib.crc32(ids.astype("<u4").tobytes()), codec.machine.decode(ids) == text) for ids, text in zip(codec.encode(texts), texts)]
            n, crc, same = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
