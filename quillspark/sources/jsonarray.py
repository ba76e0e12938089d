"""Files that hold one JSON array, read in parallel with the positions of their elements.

A block of bytes can't know whether it begins inside a string or how deep.  A first pass says for each block how it would change both states;
their prefix sums, a row for each block, give the state at every block's start.  A second pass counts the elements that begin in
each block, and the last one cuts them out, a block reading on to the end of the element that it began.  So no task and no row holds the
file, positions are those of the array, and where the blocks end doesn't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.storage import opened

SPLIT = 32 << 20
_QUOTE, _BACKSLASH, _COMMA = 0x22, 0x5C, 0x2C
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1
_MARK = _STEP != 0
_MARK[_COMMA] = True


class _Marks:
    """Brackets and commas of a piece of bytes, and how many string bounds lie before each."""

    def __init__(self, data: bytes, after_backslashes: int = 0):
        b = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(b == _QUOTE)
        if len(quotes) and (b == _BACKSLASH).any():
            other = np.maximum.accumulate(np.where(b != _BACKSLASH, np.arange(len(b)), -1))
            before = np.where(quotes > 0, other[np.maximum(quotes - 1, 0)], -1)
            escapes = quotes - 1 - before + np.where(before < 0, after_backslashes, 0)
            quotes = quotes[escapes % 2 == 0]
        elif len(quotes) and after_backslashes % 2 and quotes[0] == 0:
            quotes = quotes[1:]
        self.n_quotes = len(quotes)
        self.at = np.flatnonzero(_MARK[b])
        self.odd = np.searchsorted(quotes, self.at) % 2 == 1
        self.step = _STEP[b[self.at]].astype(np.int64)

    def outside(self, inside: bool) -> np.ndarray:
        """Which marks lie outside strings if the piece begins inside one or not."""
        return self.odd if inside else ~self.odd

    def bounds(self, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(places at which an element ends, places at which one begins): after the array's bracket and after commas at its level."""
        out = self.outside(inside)
        at, step = self.at[out], self.step[out]
        after = depth + np.cumsum(step)
        comma = (step == 0) & (after == 1)
        return at[comma | (step < 0) & (after == 0)], at[comma | (step > 0) & (after == 1)] + 1


def _part(path: str, start: int, size: int) -> tuple[bytes, int]:
    """Bytes of the file and how many backslashes lie right before them."""
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        n, back = 0, start
        while back:
            take = min(back, 64)
            f.seek(back - take)
            piece = f.read(take)
            run = len(piece) - len(piece.rstrip(b"\\"))
            n, back = n + run, back - take
            if run < take:
                break
        f.seek(start)
        return f.read(size), n


def elements(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """(ord, value): the elements of the array in a file, as JSON texts, by position from 0.  No rows where the file holds anything but an array."""
    split = split or SPLIT
    fs, p = opened(path)
    blocks = max(1, -(-fs.get_file_info(p).size // split))
    every = spark.range(0, blocks, 1, blocks)

    def states(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                m = _Marks(*_part(path, i * split, split))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (i, m.n_quotes % 2, int(m.step[m.outside(False)].sum()), int(m.step[m.outside(True)].sum()))], ["block", "quotes", "deeper", "deeper_inside"])

    starts, inside, depth = [], False, 0
    for r in every.mapInArrow(states, "block long, quotes long, deeper long, deeper_inside long").orderBy("block").collect():  # a row for each block
        starts.append((inside, depth))
        depth += r.deeper_inside if inside else r.deeper
        inside ^= bool(r.quotes)

    def count(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([len(_Marks(*_part(path, i * split, split)).bounds(*starts[i])[1])])], ["block", "n"])

    counts = [r.n for r in every.mapInArrow(count, "block long, n long").orderBy("block").collect()]  # a row for each block
    first = np.concatenate([[0], np.cumsum(counts)]).tolist()

    def cut(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                data, n = _part(path, i * split, split)
                ends, begins = _Marks(data, n).bounds(*starts[i])
                if not len(begins):
                    continue
                parts, at = [data], i
                while not len(ends) or ends[-1] < begins[-1]:  # the last element goes on
                    at += 1
                    more, n = _part(path, at * split, split)
                    if not more:
                        break
                    found, _ = _Marks(more, n).bounds(*starts[at])
                    base = sum(map(len, parts))
                    parts.append(more if not len(found) else more[: found[0] + 1])
                    ends = np.append(ends, found[:1] + base)
                data = b"".join(parts)
                stop = np.append(ends, len(data))[np.searchsorted(ends, begins)]
                texts = [data[a:z].decode("utf-8", "replace").strip() for a, z in zip(begins.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(range(first[i], first[i] + len(texts)), pa.int64()), pa.array(texts, pa.string())], ["ord", "value"])

    head, _ = _part(path, 0, 4096)
    found = every.mapInArrow(cut, "ord long, value string").filter("value <> ''")
    return found if head.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"[" else found.limit(0)


def splittable(path: str) -> bool:
    """Whether ``path`` is one file on a file system whose bytes tasks can read by place."""
    try:
        fs, p = opened(path)
        return fs.get_file_info(p).is_file
    except (pa.ArrowInvalid, ValueError, OSError):
        return False


def parsed(spark: SparkSession, path: str, element: str) -> DataFrame:
    """(ord, x): the elements of a file that holds one JSON array, as values of the type ``element``; a file that tasks can't read by place is read as one text."""
    if splittable(path):
        wrapped = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<{element}>")
        return elements(spark, path).select("ord", F.get(wrapped, F.lit(0)).alias("x"))
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<{element}>")).alias("ord", "x")).select(F.col("ord").cast("long"), "x")
