"""Strict interval files and range-sort queries."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits of the format.
MAX_CASES = MAX_TOTAL = 200_000
MAX_VALUE = 1_000_000_000


class Malformed(ValueError):
    """Where and why a file breaks the format."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.line, self.begin = data, 0, 1, 0

    def fail(self, why: str) -> Malformed:
        return Malformed(f"line {self.line}, column {self.at - self.begin + 1}: {why}")

    def number(self, name: str, low: int, high: int) -> int:
        end = self.at
        while end < len(self.data) and 0x30 <= self.data[end] <= 0x39:
            end += 1
        digits = self.data[self.at : end]
        if not digits:
            raise self.fail(f"{name}: a number was expected")
        if len(digits) > 1 and digits[:1] == b"0":
            raise self.fail(f"{name}: leading zero")
        value = int(digits) if len(digits) < 20 else MAX_VALUE * 10
        if not low <= value <= high:
            raise self.fail(f"{name} = {digits.decode()} isn't from {low} to {high}")
        self.at = end
        return value

    def expect(self, byte: bytes, name: str) -> None:
        if self.data[self.at : self.at + 1] != byte:
            raise self.fail(f"{name} was expected")
        self.at += 1
        if byte == b"\n":
            self.line, self.begin = self.line + 1, self.at


def validate(data: bytes) -> dict[str, int]:
    """T, sum_N, max_N and bytes of a file of T cases of N intervals, or Malformed."""
    r = _Reader(data)
    cases = r.number("T", 1, MAX_CASES)
    r.expect(b"\n", "line end")
    total = largest = 0
    for case in range(1, cases + 1):
        n = r.number(f"case {case}: N", 1, MAX_TOTAL)
        total, largest = total + n, max(largest, n)
        if total > MAX_TOTAL:
            raise r.fail(f"case {case}: the sum of N exceeds {MAX_TOTAL}")
        r.expect(b"\n", "line end")
        for i in range(1, n + 1):
            low = r.number(f"case {case}: L_{i}", 1, MAX_VALUE)
            r.expect(b" ", "one space")
            high = r.number(f"case {case}: R_{i}", 1, MAX_VALUE)
            if low > high:
                raise r.fail(f"case {case}: L_{i} = {low} > R_{i} = {high}")
            r.expect(b"\n", "line end")
    if r.at != len(data):
        raise r.fail("end of file was expected")
    return {"T": cases, "sum_N": total, "max_N": largest, "bytes": len(data)}


def validated(files: DataFrame) -> DataFrame:
    """path, status (OK, INVALID or UNREADABLE), message and figures of rows (path, content), as the binaryFile source gives them."""
    schema = "status string, message string, cases long, sum_n long, max_n long, n_bytes long"

    @F.pandas_udf(schema)
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for data in contents:
            if data is None:
                rows.append(("UNREADABLE", "no content", None, None, None, None))
                continue
            try:
                rows.append(("OK", None, *validate(bytes(data)).values()))
            except Malformed as e:
                rows.append(("INVALID", str(e), None, None, None, len(data)))
        return pd.DataFrame(rows, columns=["status", "message", "cases", "sum_n", "max_n", "n_bytes"]).astype({c: "Int64" for c in ("cases", "sum_n", "max_n", "n_bytes")})

    return files.select("path", run("content").alias("r")).select("path", "r.*")


def range_sorted(values: Column, operations: Column) -> Column:
    """``values`` after sorting ranges [l, r] from 1 in turn, ascending where c is 1, else descending: each operation copies the array, so for short ones."""

    def apply(a: Column, op: Column) -> Column:
        part = F.slice(a, op["l"], op["r"] - op["l"] + 1)
        done = F.when(op["c"] == 1, F.sort_array(part)).otherwise(F.sort_array(part, asc=False))
        return F.concat(F.slice(a, 1, op["l"] - 1), done, F.slice(a, op["r"] + 1, F.size(a)))

    return F.aggregate(operations, values, apply)


class ClassRuns:
    """A row of small classes as runs of equal ones: where each begins, sorted, and its class.

    Sorting a range replaces its runs by one for each class in it, from their counts.  An operation adds at most four runs and takes
    time for those that it removes, so operations are amortised logarithmic but for moving list ends.
    """

    def __init__(self, classes: np.ndarray, n_classes: int = 3):
        new = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]])) if len(classes) else np.zeros(0, np.int64)
        self.starts, self.classes, self.size, self.n_classes = new.tolist(), classes[new].tolist(), len(classes), n_classes

    def _cut(self, at: int) -> int:
        """The index of the run that begins at ``at``, after cutting one there if need be."""
        if at >= self.size:
            return len(self.starts)
        i = bisect.bisect_right(self.starts, at) - 1
        if self.starts[i] == at:
            return i
        self.starts.insert(i + 1, at)
        self.classes.insert(i + 1, self.classes[i])
        return i + 1

    def sort(self, low: int, high: int, ascending: bool) -> None:
        """Sort places low to high - 1, from 0."""
        if low >= high:
            return
        i, j = self._cut(low), self._cut(high)
        if j - i == 1:
            return
        counts = [0] * self.n_classes
        ends = [*self.starts[i + 1 : j], high]
        for begin, end, c in zip(self.starts[i:j], ends, self.classes[i:j], strict=True):
            counts[c] += end - begin
        at, starts, classes = low, [], []
        for c in range(self.n_classes) if ascending else range(self.n_classes - 1, -1, -1):
            if counts[c]:
                starts.append(at)
                classes.append(c)
                at += counts[c]
        self.starts[i:j], self.classes[i:j] = starts, classes

    def first(self, c: int) -> int | None:
        return next((s for s, k in zip(self.starts, self.classes, strict=True) if k == c), None)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return np.repeat(np.array(self.classes, dtype or np.int64), np.diff([*self.starts, self.size]))


def place_of(values, operations, x) -> int | None:
    """Where x, or the first of equal ones, ends up, from 1, after sorting ranges (c, l, r) from 1 in turn, ascending where c is 1; null where it isn't there."""
    runs = ClassRuns((np.sign(np.asarray(values, np.float64) - x) + 1).astype(np.int64) if len(values) else np.zeros(0, np.int64))
    for c, low, high in operations:
        runs.sort(max(low, 1) - 1, min(high, runs.size), c == 1)
    at = runs.first(1)
    return None if at is None else at + 1


def place_after(values: Column, operations: Column, x: Column) -> Column:
    """``place_of`` for each case, by Arrow batches: only less, equal and greater matter, so runs of three classes are sorted instead of values."""

    @F.pandas_udf("long")
    def run(v: pd.Series, ops: pd.Series, wanted: pd.Series) -> pd.Series:
        asked = ([(o["c"], o["l"], o["r"]) for o in some] for some in ops)
        return pd.Series([place_of(a, o, w) for a, o, w in zip(v, asked, wanted, strict=True)], dtype="Int64")

    return run(values, operations, x)
