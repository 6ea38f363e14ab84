"""Ids of whole texts by a tokenizer that drops white space and splits at it.

A text is cut into runs that the tokenizer treats on their own; each distinct
run is encoded once and its ids are remembered, and the ids of all texts of a
chunk are gathered with numpy. A remembered run is found by a hash and then
compared byte by byte; one that differs, or is very long, is encoded by itself. A run is a stretch between blanks. It is cut further where letters (a-z
and Latin-1, lower-cased) meet other ASCII characters, unless it holds an
apostrophe, ``<|`` or any other character: there, contractions, added tokens
and combining marks could span the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import Words, chunks, hash_ranges, same_bytes

#: Distinct runs remembered by a worker before it starts afresh.
REMEMBERED = 500_000
#: Longer runs are not remembered.
LONGEST = 1024

_encoders: dict[str, RunEncoder] = {}


def _runs(texts: list[bytes]) -> Words:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8).copy()
    n = len(raw)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], after[:-1] = raw[:-1], raw[1:]
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    second = (before == 0xC3) & (raw >= 0x80)
    latin = (second & (raw != 0x97) & (raw != 0xB7)) | (raw == 0xC3)
    odd = ((raw >= 128) & ~latin) | (raw == 39) | ((raw == 60) & (after == 124))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    marks = np.concatenate([[0], np.cumsum(odd)])
    whole = marks[end] > marks[start]
    if whole.any():
        step = np.zeros(n + 1, np.int8)
        step[start[whole]] = 1
        step[end[whole]] = -1
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    else:
        inside = np.zeros(n, bool)
    raw += ((raw >= 65) & (raw <= 90) & ~inside).astype(np.uint8) * np.uint8(32)
    raw += (second & (raw <= 0x9E) & (raw != 0x97) & ~inside).astype(np.uint8) * np.uint8(32)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    kind = np.where(blank, 0, np.where(inside, 3, np.where(letter, 1, 2))).astype(np.int8)
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    edge = np.concatenate([[0], edge])
    kinds = kind[edge]
    stops = np.concatenate([edge[1:], [n]])
    real = kinds > 0
    start, end, kinds = edge[real], stops[real], kinds[real]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    per_text = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    out = Words(hash_ranges(raw, start, end), start, end, per_text, ends - lengths, raw)
    out.kinds = kinds
    return out


class Remembering:
    """Ids of distinct runs, kept in flat arrays in order of the runs' hashes."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.spelled = np.empty(0, np.uint8)
        self.spelled_at = np.empty(0, np.int64)
        self.spelled_size = np.empty(0, np.int64)

    def runs(self, texts: list[bytes]) -> Words:
        raise NotImplementedError

    def encode_runs(self, words: Words, new: np.ndarray) -> list[np.ndarray]:
        """Ids of the runs numbered ``new``."""
        raise NotImplementedError

    def _remembered(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place among the remembered runs, whether it is this very run) for each run."""
        length = words.end - words.start
        short = length <= LONGEST
        place, same = np.zeros(len(length), np.int64), np.zeros(len(length), bool)
        if not short.any():
            return place, same
        chosen = np.flatnonzero(short)
        uniq, first, inverse = np.unique(words.hash[chosen], return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.keys, uniq)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == uniq[known]
        new = chosen[first[~known]]
        if len(new):
            parts = self.encode_runs(words, new)
            sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
            where, own = at[~known], length[new]
            self.keys = np.insert(self.keys, where, uniq[~known])
            self.at = np.insert(self.at, where, len(self.ids) + np.cumsum(sizes) - sizes)
            self.size = np.insert(self.size, where, sizes)
            self.spelled_at = np.insert(self.spelled_at, where, len(self.spelled) + np.cumsum(own) - own)
            self.spelled_size = np.insert(self.spelled_size, where, own)
            self.ids = np.concatenate([self.ids, *parts])
            ends = np.cumsum(own)
            self.spelled = np.concatenate([self.spelled, words.raw[np.repeat(words.start[new] - (ends - own), own) + np.arange(int(ends[-1]))]])
            at = np.searchsorted(self.keys, uniq)
        place[chosen] = at[inverse]
        fits = chosen[self.spelled_size[place[chosen]] == length[chosen]]
        same[fits] = same_bytes(words.raw, words.start[fits], length[fits], self.spelled, self.spelled_at[place[fits]])
        return place, same

    def encode(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """uint32 ids of each text, in order."""
        for _, part in chunks(texts):
            words = self.runs(part)
            if not len(words.start):
                yield from (np.empty(0, np.uint32) for _ in part)
                continue
            place, same = self._remembered(words)
            alone = np.flatnonzero(~same)
            at, size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            at[same], size[same] = self.at[place[same]], self.size[place[same]]
            known = self.ids
            if len(alone):
                parts = self.encode_runs(words, alone)
                size[alone] = [len(p) for p in parts]
                at[alone] = len(known) + np.cumsum(size[alone]) - size[alone]
                known = np.concatenate([known, *parts])
            ends = np.cumsum(size)
            ids = known[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]))]
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words.per_text)])]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield ids[a:b]


class RunEncoder(Remembering):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

    def runs(self, texts: list[bytes]) -> Words:
        return _runs(texts)

    def encode_runs(self, words: Words, new: np.ndarray) -> list[np.ndarray]:
        """Runs of letters are one word each and go in together."""
        blob = words.raw.tobytes()
        texts = [blob[a:b].decode("utf-8") for a, b in zip(words.start[new].tolist(), words.end[new].tolist())]
        letters = words.kinds[new] == 1
        parts: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        plain = np.flatnonzero(letters)
        if len(plain):
            made = self.tokenizer.encode(" ".join([texts[k] for k in plain]), add_special_tokens=False)
            ids, word = np.array(made.ids, np.uint32), np.array(made.word_ids, np.int64)
            cuts = np.searchsorted(word, np.arange(len(plain) + 1))
            for k, a, b in zip(plain.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                parts[k] = ids[a:b]
        rest = np.flatnonzero(~letters).tolist()
        for k, made in zip(rest, self.tokenizer.encode_batch([texts[k] for k in rest], add_special_tokens=False)):
            parts[k] = np.array(made.ids, np.uint32)
        return parts


def encoder(path: str) -> RunEncoder:
    """One encoder a worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]
