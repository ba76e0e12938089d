"""Substring counts of many patterns in many texts, by automata over pattern files in shared storage.

Tasks write the different patterns to files of bounded size; each task that reads texts builds one automaton for a file and passes over every
text once with it.  Cost follows the texts and the matches, not texts x patterns; nothing is broadcast or collected but
the files' names.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.storage import read_shared, shared_folder, write_shared

#: Patterns of a file and their characters at most; characters of patterns whose automata a task keeps; hits that it holds before it passes them on.
PATTERNS_A_FILE, CHARACTERS_A_FILE, CHARACTERS_KEPT, HITS_HELD = 50_000, 2 << 20, 4 << 20, 1 << 14


def store_patterns(patterns: DataFrame) -> tuple[str, list[str]]:
    """A shared folder with files of the different non-empty strings in the only column of ``patterns``, and the files' names."""
    folder = shared_folder(patterns.sparkSession, "patterns")
    only = patterns.select(F.col(patterns.columns[0]).alias("p")).filter("length(p) > 0").distinct()

    def write(batches):
        held, size = [], 0

        def put() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            write_shared(f"{folder}/{name}", json.dumps(held).encode())
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for b in batches:
            for p in b.column(0).to_pylist():
                held.append(p)
                size += len(p)
                if len(held) >= PATTERNS_A_FILE or size >= CHARACTERS_A_FILE:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    return folder, sorted(r.name for r in only.mapInArrow(write, "name string").collect())  # a name for each file


def automaton(patterns: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(p, p)
    out.make_automaton()
    return out


def counts(found: ahocorasick.Automaton, text: str) -> dict[str, int]:
    """For each pattern in the text its occurrences without overlap, from the left: as str.count gives them."""
    n: dict[str, int] = {}
    free: dict[str, int] = {}
    for last, p in found.iter(text):
        if last - len(p) + 1 >= free.get(p, 0):
            n[p] = n.get(p, 0) + 1
            free[p] = last + 1
    return n


class _Automata:
    """The automata of pattern files; those of CHARACTERS_KEPT characters are kept, others built again."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names, self.kept, self.size = folder, names, {}, 0

    def __iter__(self) -> Iterator[ahocorasick.Automaton]:
        for name in self.names:
            if name not in self.kept:
                patterns = json.loads(read_shared(f"{self.folder}/{name}"))
                made, size = automaton(patterns), sum(map(len, patterns))
                if self.size + size > CHARACTERS_KEPT:
                    yield made
                    continue
                self.kept[name], self.size = made, self.size + size
            yield self.kept[name]


def _in_pieces(hits: Iterator[tuple]) -> Iterator[list[tuple]]:
    while found := list(itertools.islice(hits, HITS_HELD)):
        yield found


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern, n): how often each of the patterns that a text (id, text) has occurs in it, without overlap; case counts.

    Null and empty texts and patterns have no rows; repeated patterns count once; rows that share an id are counted one by one.
    """
    folder, names = store_patterns(patterns)
    id_field = texts.schema[texts.columns[0]]
    schema = T.StructType([T.StructField("id", id_field.dataType), T.StructField("pattern", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        automata = _Automata(folder, names)
        for b in batches:
            lines = [(i, t) for i, t in enumerate(b.column(1).to_pylist()) if t]
            for one in automata:
                for found in _in_pieces((i, p, n) for i, t in lines for p, n in counts(one, t).items()):
                    rows, what, n = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(what, pa.string()), pa.array(n, pa.int64())], ["id", "pattern", "n"])

    return texts.select(F.col(texts.columns[0]).alias("id"), F.col(texts.columns[1]).cast("string").alias("text")).mapInArrow(run, schema)
