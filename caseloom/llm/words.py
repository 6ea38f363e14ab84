"""Words of whole texts as 64-bit hashes, found with numpy on the UTF-8 bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Text bytes worked on at once; arrays of eight bytes for each word are made of them.
CHUNK_BYTES = 1 << 19
#: Bytes of a range that are hashed eight at a time; longer ranges go through BLAKE2.
LANE_BYTES = 256
_MASK = (1 << 64) - 1
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 array."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``raw`` on as one number; zeros follow its end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def hash_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; ranges of one length up to eight bytes never share one."""
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    view = lanes(raw)
    todo = np.flatnonzero(size <= LANE_BYTES)
    at = 0
    while len(todo):
        rest = size[todo] - at
        lane = view[start[todo] + at] & _TAIL[np.minimum(rest, 8)]
        h[todo] = mix(h[todo] ^ (lane + np.uint64(at)))
        todo = todo[rest > 8]
        at += 8
    for k in np.flatnonzero(size > LANE_BYTES):
        h[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_bytes(raw: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, other_start: np.ndarray) -> np.ndarray:
    """Whether ranges of ``size`` bytes of the two arrays are equal, byte by byte."""
    same = np.ones(len(start), bool)
    x, y = lanes(raw), lanes(other)
    todo, at = np.arange(len(start)), 0
    while len(todo):
        rest = size[todo] - at
        differ = ((x[start[todo] + at] ^ y[other_start[todo] + at]) & _TAIL[np.clip(rest, 0, 8)]) != 0
        same[todo[differ]] = False
        todo = todo[~differ & (rest > 8)]
        at += 8
    return same


@dataclass
class Words:
    """Words of some texts: hash, byte range in ``raw``, and number of its text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    per_text: np.ndarray
    text_start: np.ndarray
    raw: np.ndarray

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of arbitrary byte ranges of ``raw``."""
        return hash_ranges(self.raw, start, end)


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, texts) of runs of about CHUNK_BYTES; a longer text stands alone."""
    first, size, part = 0, 0, []
    for k, text in enumerate(texts):
        text = text or b""
        if part and size + len(text) > CHUNK_BYTES:
            yield first, part
            first, size, part = k, 0, []
        part.append(text)
        size += len(text) + 1
    if part:
        yield first, part


def split_words(texts: list[bytes], letters_only: bool = False) -> Words:
    """Words of ``texts`` after lower-casing A-Z.

    By default a word is a run of bytes other than space and \\t..\\r. With
    ``letters_only`` it is a run of ASCII letters, digits and non-ASCII bytes,
    and two-byte Latin-1 capitals are lower-cased too.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8).copy()
    raw += ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    if letters_only:
        after = np.zeros(len(raw), dtype=bool)
        after[1:] = raw[:-1] == 0xC3
        raw += (after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)).astype(np.uint8) * np.uint8(32)
        inside = (raw >= 128) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
    else:
        inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    stops = np.cumsum(lengths)
    upto = np.searchsorted(start, stops)
    per_text = np.diff(np.concatenate([[0], upto]))
    return Words(hash_ranges(raw, start, end), start, end, per_text, stops - lengths, raw)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and their number per text.

    A text with fewer words, but at least one, has its whole sequence as its
    only shingle; one without words has none.
    """
    h, count = words.hash, words.per_text
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    rolled = np.zeros(len(h), dtype=np.uint64)
    keep = np.zeros(len(h), dtype=bool)
    total = len(h)
    if total >= n:
        part = np.full(total - n + 1, np.uint64(n), dtype=np.uint64)
        for k in range(n):
            part = part * np.uint64(0xD6E8FEB86659FD93) + h[k : total - n + 1 + k]
        rolled[: total - n + 1] = mix(part)
    first = np.cumsum(count) - count
    long = count >= n
    if long.any():
        lo, hi = first[long], first[long] + made[long]
        step = np.zeros(total + 1, dtype=np.int32)
        np.add.at(step, lo, 1)
        np.add.at(step, hi, -1)
        keep = np.cumsum(step[:-1]) > 0
    for k in np.flatnonzero((count > 0) & ~long):
        value = int(count[k])
        for w in h[first[k] : first[k] + count[k]].tolist():
            value = (value * 0xD6E8FEB86659FD93 + w) & _MASK
        rolled[first[k]] = mix(np.array([value], dtype=np.uint64))[0]
        keep[first[k]] = True
    return rolled[keep], made
