"""Transaction log reassembly: a backward scan settles each change, per-key deltas become states by prefix sums.

A log record has a place in the log, a lane (each lane runs transactions one after the other) and a kind.  Read backwards, a
lane says everything about a change before the change itself comes: the record that ends its transaction and, for each nesting level of
savepoints, the nearest later rollback.  A rollback opens a level, the savepoint that it goes back to closes it, and a rollback without a
savepoint stays open to the transaction's start; the innermost open rollback undoes the change at hand.  Each
change is settled as soon as it is read, and nothing is kept but the open levels.

The log is split into ranges of (lane, place), so neither a lane with a third of all records nor a transaction of any length is
one task's work.  A first pass writes for each range, to a file in shared storage, what it leaves open at its start; the second starts each range with
what the ranges behind it left open, read from their files as far as it is needed.  Prefix sums and looks at the row before work by
ranges, too; what reaches the driver is one row for each range, whatever the ranges hold.

Edge cases: records without a place aren't in the log; equal places are ordered by lane (null first), ``tie`` and kind; a null lane is a
lane; a transaction that the log's end finds open is aborted by no record; a null value deletes its key; an empty log has no states.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.work import AtomicFile, opened, shared_folder, stored

CHANGE, COMMIT, ABORT, SAVEPOINT, ROLLBACK = range(5)
#: Commits in an epoch.
EPOCH = 64
_FATE = "place long, tie long, key long, value long, outcome int, by long, commit_no long"
_ORDER = ("lane", "place", "tie", "commit_no", "kind")


def in_ranges(df: DataFrame, order: tuple[str, ...], name: str) -> tuple[DataFrame, int]:
    """``df``, stored in ranges of equal size by ``order``, each row with its range as ``part``, and the number of ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), name), n


def running(df: DataFrame, order: tuple[str, ...], columns: list[str], name: str) -> DataFrame:
    """``df`` with each of ``columns`` summed up over all rows so far in ``order``."""
    ranged, _ = in_ranges(df, order, name)
    rows = ranged.groupBy("part").agg(*(F.sum(c).alias(c) for c in columns)).orderBy("part").collect()  # a row for each range
    before, table = [0] * len(columns), []
    for r in rows:
        table.append((r["part"], *before))
        before = [b + r[c] for b, c in zip(before, columns, strict=True)]
    offsets = df.sparkSession.createDataFrame(table, ", ".join(["part int", *(f"_{c} long" for c in columns)]))
    so_far = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.join(F.broadcast(offsets), "part")  # a row for each range
    return summed.select(*(c for c in df.columns if c not in columns), *((F.sum(c).over(so_far) + F.col(f"_{c}")).alias(c) for c in columns))


class _Border:
    """What a range leaves open at its start: its first lane, the end of the transaction there if the range has it, the open rollbacks, and
    how many of those that come from behind its savepoints closed."""

    def __init__(self, lane, end: list | None, closed: int, whole: bool, stack: list[int] | None = None):
        self.lane, self.end, self.closed, self.whole, self.stack = lane, end, closed, whole, stack

    def put(self, folder: str, part: int) -> None:
        data = io.BytesIO()
        np.save(data, np.asarray(self.stack, np.int64))
        head = json.dumps([self.lane, self.end, self.closed, self.whole]).encode()
        for name, body in ((f"{part}.npy", data.getvalue()), (f"{part}.json", head)):
            out = AtomicFile(folder, name)
            out.write(body)
            out.commit()

    @staticmethod
    def get(folder: str, part: int) -> _Border | None:
        fs, path = opened(f"{folder}/{part}.json")
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None  # a range without rows
        with fs.open_input_file(path) as f:
            return _Border(*json.loads(f.read()))


class _Behind:
    """The open rollbacks that the ranges behind ``part`` leave for ``lane``, innermost first, and the end of its transaction."""

    def __init__(self, folder: str, part: int, parts: int, lane):
        self.folder, self.end, self.chain, self.held, self.closed = folder, [ABORT, None, None], [], [], 0
        for j in range(part + 1, parts):
            border = _Border.get(folder, j)
            if border is None:
                continue
            if border.lane != lane:
                break
            self.chain.append((j, border.closed))
            if border.end is not None or not border.whole:
                self.end = border.end or self.end
                break
        self.chain.reverse()

    def peek(self) -> int | None:
        while not self.held and self.chain:
            j, closed = self.chain.pop()
            fs, path = opened(f"{self.folder}/{j}.npy")
            with fs.open_input_file(path) as f:
                self.held = np.load(io.BytesIO(f.read())).tolist()
            gone = min(self.closed, len(self.held))
            del self.held[len(self.held) - gone :]
            self.closed += closed - gone
        return self.held[-1] if self.held else None

    def pop(self) -> None:
        if self.peek() is not None:
            self.held.pop()


class _Nothing:
    """Behind a range of which nothing is known yet: counts what is taken from there."""

    def __init__(self):
        self.end, self.closed = None, 0

    def peek(self) -> int | None:
        return None

    def pop(self) -> None:
        self.closed += 1


_NEW = object()


class _Scan:
    """The state of the backward scan over the rows of one range."""

    def __init__(self, behind):
        self.behind_of, self.behind, self.lane, self.end, self.stack, self.whole = behind, None, _NEW, None, [], True

    def enter(self, lane) -> None:
        first = self.lane is _NEW
        self.whole &= first
        self.behind = self.behind_of(lane) if first else None
        self.end = self.behind.end if first else [ABORT, None, None]
        self.lane, self.stack = lane, []

    def record(self, kind: int, place: int, commit_no: int) -> None:
        if kind == ROLLBACK:
            self.stack.append(place)
        elif kind == SAVEPOINT:
            if self.stack:
                self.stack.pop()
            elif self.behind:
                self.behind.pop()
        else:
            self.end, self.stack, self.behind = [kind, place, commit_no if kind == COMMIT else None], [], None

    def undoing(self) -> int | None:
        return self.stack[-1] if self.stack else self.behind.peek() if self.behind else None


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("part", "lane", "kind", "place", "tie", "commit_no", "key", "value")), strict=True)


def settled(log: DataFrame) -> DataFrame:
    """Every change of the log: place, tie, key, value, outcome (COMMIT, ABORT or ROLLBACK), ``by``, the place of the record that decided it
    (null: the log's end), and ``commit_no`` of the commit that keeps it."""
    parts_of, n = in_ranges(log, _ORDER, "log")
    backwards = parts_of.repartitionById(n, F.col("part")).sortWithinPartitions(*(F.desc(c) for c in _ORDER))
    folder = shared_folder(log.sparkSession, "borders")

    def borders(batches):
        scan, part = _Scan(lambda lane: _Nothing()), None
        for part, lane, kind, place, _, commit_no, _, _ in _rows(batches):
            if lane != scan.lane:
                scan.enter(lane)
            if kind != CHANGE:
                scan.record(kind, place, commit_no)
        if part is not None:
            _Border(scan.lane, scan.end, scan.behind.closed if scan.behind else 0, scan.whole and scan.behind is not None, scan.stack).put(folder, part)
        yield from ()

    backwards.mapInArrow(borders, "part int").write.format("noop").mode("overwrite").save()

    def settle(batches):
        scan, part, out = None, None, []

        def made() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["place", "tie", "key", "value", "outcome", "by", "commit_no"])

        for part, lane, kind, place, tie, commit_no, key, value in _rows(batches):
            if scan is None:
                scan = _Scan(lambda first, at=part: _Behind(folder, at, n, first))
            if lane != scan.lane:
                scan.enter(lane)
            if kind != CHANGE:
                scan.record(kind, place, commit_no)
                continue
            undone = scan.undoing()
            out.append((place, tie, key, value, *((ROLLBACK, undone, None) if undone is not None else scan.end)))
            if len(out) >= 50_000:
                yield made()
                out.clear()
        if out:
            yield made()

    return backwards.mapInArrow(settle, _FATE)


def numbered(log: DataFrame) -> DataFrame:
    """The log with ``commit_no``: how many of its commits come no later than the record."""
    return running(log.filter("place is not null").withColumn("commit_no", (F.col("kind") == COMMIT).cast("long")), ("place", "lane", "tie", "kind"), ["commit_no"], "places")


def states(log: DataFrame, fates: DataFrame, epoch: int = EPOCH) -> DataFrame:
    """epoch, n_keys, total: the keys of the store and the sum of their values after each epoch."""
    number = F.expr(f"(commit_no - 1) div {int(epoch)} + 1")
    last = F.max(F.struct("commit_no", "place", "tie", "value"))
    writes = fates.filter(F.col("outcome") == COMMIT).groupBy("key", number.alias("epoch")).agg(last.alias("last")).select("key", "epoch", F.col("last.value").alias("value"))
    ranged, _ = in_ranges(writes, ("key", "epoch"), "writes")
    ends = ranged.groupBy("part").agg(F.max(F.struct("key", "epoch", "value")).alias("end")).orderBy("part").collect()  # a row for each range
    table = [(r["part"], *((e["end"]["key"], e["end"]["value"]) if e else (None, None))) for r, e in zip(ends, [None, *ends], strict=False)]
    before = F.broadcast(log.sparkSession.createDataFrame(table, "part int, end_key long, end_value long"))
    row = Window.partitionBy("part").orderBy("key", "epoch")
    looked = ranged.join(before, "part").withColumn("at", F.row_number().over(row)).withColumn("k", F.lag("key").over(row)).withColumn("v", F.lag("value").over(row))

    def chosen(own: str, border: str) -> Column:
        return F.when(F.col("at") == 1, F.col(border)).otherwise(F.col(own))

    old = F.when(chosen("k", "end_key") == F.col("key"), chosen("v", "end_value"))
    deltas = looked.select("epoch", (F.col("value").isNotNull().cast("long") - old.isNotNull().cast("long")).alias("n_keys"), (F.coalesce("value", F.lit(0)) - F.coalesce(old, F.lit(0))).alias("total"))
    empty = log.filter(F.col("kind") == COMMIT).select(number.alias("epoch"), F.lit(0).cast("long").alias("n_keys"), F.lit(0).cast("long").alias("total"))
    return running(deltas.unionByName(empty).groupBy("epoch").agg(F.sum("n_keys").alias("n_keys"), F.sum("total").alias("total")), ("epoch",), ["n_keys", "total"], "epochs")


def reassembled(log: DataFrame, epoch: int = EPOCH) -> tuple[DataFrame, DataFrame]:
    """The fate of every change and the states after each epoch, of a log of place, lane, tie, kind, key and value."""
    log = numbered(log.select(F.col("place").cast("long").alias("place"), F.col("lane").cast("string").alias("lane"), F.col("tie").cast("long").alias("tie"), F.col("kind").cast("int").alias("kind"), F.col("key").cast("long").alias("key"), F.col("value").cast("long").alias("value")))
    log = stored(log, "numbered")
    fates = stored(settled(log), "fates")
    return fates, states(log, fates, epoch)


def documents_log(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as a log: doc_id's checksum gives kind and key, the text's the value; toxic documents delete their key."""
    doc_id = F.col("doc_id").cast("long")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    kind = F.element_at(F.array(*(F.lit(k) for k in (COMMIT, COMMIT, ABORT, SAVEPOINT, SAVEPOINT, ROLLBACK, ROLLBACK, *[CHANGE] * 10))), (h % 17 + 1).cast("int"))
    key = F.floor(h / 100) % 30000
    text = F.col("text").cast("string")
    rows = docs.select(doc_id.alias("place"), F.col("source").cast("string").alias("lane"), F.xxhash64(text).alias("tie"), kind.alias("kind"), key.alias("key"), F.crc32(F.concat(key.cast("string"), F.lit(":"), text).cast("binary")).alias("value"))
    toxic = labels.filter(F.col("toxic") == 1).select(F.col("doc_id").cast("long").alias("place")).distinct().withColumn("toxic", F.lit(True))
    marked = rows.filter("place is not null").join(toxic.hint("merge"), "place", "left")
    return marked.withColumn("value", F.when(F.col("toxic").isNull(), F.col("value"))).drop("toxic")


def op13_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = documents_log(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    fates, after = reassembled(log)
    undone = fates.filter(F.col("outcome") != COMMIT).select(F.when(F.col("outcome") == ABORT, "abort").otherwise("rollback").alias("kind"), F.col("place").alias("id"), F.col("by").alias("n"), F.col("key").alias("value"))
    return after.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), F.col("n_keys").alias("n"), F.col("total").alias("value")).unionByName(undone)
