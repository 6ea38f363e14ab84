"""Dictionary matching: one Aho-Corasick automaton over words, phrases and beginnings of words.

The automaton finds all entries in one pass over a text, however many there
are. It is compiled once in each Python worker, from a broadcast whose size is
checked; texts come and go as Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import comparable

#: Characters that all entries may have together: what a task can be sent. Beyond that, join the words (``keys.reverse_lookup``).
MOST_CHARS = 8_000_000
_COMPILED: dict[int, object] = {}
FOUND = "array<struct<label:string,word:string>>"


@dataclass
class Dictionary:
    """Entries (word, label, whether it stands for all words that begin so), in normal form."""

    entries: list[tuple[str, str, bool]] = field(default_factory=list)

    @classmethod
    def of(cls, words: dict[str, list[str]], beginnings: set[str] = frozenset()) -> Dictionary:
        """From lists of words and phrases by label; those in ``beginnings`` match longer words too."""
        out = [(" ".join(parts), label, w in beginnings) for label, ws in words.items() for w in ws if (parts := re.findall(r"[^\W_]+", w.lower()))]
        if sum(len(w) for w, _, _ in out) > MOST_CHARS:
            raise ValueError(f"more than {MOST_CHARS} characters of dictionary: join its words instead")
        return cls(out)

    def compile(self):
        """Automaton whose values are the (label, word) pairs of a pattern. Texts and whole words are padded with blanks."""
        import ahocorasick

        values: dict[str, list[tuple[str, str]]] = {}
        for word, label, begins in self.entries:
            values.setdefault(f" {word}" if begins else f" {word} ", []).append((label, word))
        automaton = ahocorasick.Automaton()
        for pattern, pairs in values.items():
            automaton.add_word(pattern, pairs)
        if values:
            automaton.make_automaton()
        return automaton


def annotate(df: DataFrame, keep: list[str], fields: dict[str, str], dictionary: Dictionary) -> DataFrame:
    """Columns ``keep`` of ``df``, and for each of ``fields`` (name to text column) the distinct (label, word) found, in order.

    Texts are brought to normal form first. Null and empty texts have nothing.
    """
    sent = df.sparkSession.sparkContext.broadcast(dictionary)  # bounded by MOST_CHARS
    number = sent._jbroadcast.id() if sent._jbroadcast is not None else id(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _COMPILED:
            _COMPILED.clear()
            _COMPILED[number] = sent.value.compile()
        automaton = _COMPILED[number]
        kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.string())]))
        for batch in batches:
            columns = list(batch.columns[: len(keep)])
            for texts in batch.columns[len(keep) :]:
                found = []
                for text in texts.to_pylist():
                    hits: dict[tuple[str, str], None] = {}
                    if text and len(automaton):
                        for _, pairs in automaton.iter(f" {text} "):
                            hits.update(dict.fromkeys(pairs))
                    found.append([{"label": label, "word": word} for label, word in sorted(hits)])
                columns.append(pa.array(found, kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *fields])

    chosen = df.select(*keep, *[comparable(column).alias(f"_{name}") for name, column in fields.items()])
    kinds = dict(df.dtypes)
    return chosen.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{name}` {FOUND}" for name in fields]))


def matches(df: DataFrame, fields: dict[str, str], dictionary: Dictionary, key: str = "case_id") -> DataFrame:
    """UD02: key, signal, category, word: a row for each entry found in a field."""
    noted = annotate(df, [key], fields, dictionary)
    each = F.array(*[F.struct(F.lit(name).alias("signal"), F.col(name).alias("found")) for name in fields])
    rows = noted.select(key, F.explode(each).alias("f")).select(key, "f.signal", F.explode("f.found").alias("m"))
    return rows.select(key, "signal", F.col("m.label").alias("category"), F.col("m.word").alias("word"))
