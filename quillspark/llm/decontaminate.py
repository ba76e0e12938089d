"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document: a row of the stored index is a block of documents with its sorted
term hashes, and for each term the ascending list of its word positions.  It has the postings of all words, so one index
answers any benchmark.  The benchmark's windows are
answered within each block by intersecting offset-adjusted position lists, beginning with the window's
rarest term in the whole corpus.  No posting is shuffled, so a frequent word or passage makes no hot
partition.

Tasks make the benchmark's windows and write them to shared storage in files of a bounded number of items, which the tasks that
answer read one at a time, and beside each the occurrences of its terms in the corpus, counted in one pass over the index.  The driver holds
the files' names only.

Edge cases: a null or wordless text has no words and is never hit; an item without words has no window;
an item of fewer words than a window is one window of all its words; repeated documents or items are
treated one by one (equal item_ids count once); empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import hashlib
import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.text import Words, slices, utf8
from quillspark.llm.work import AtomicFile, fresh, opened, shared_folder, stored

WINDOW = 10
#: Items in a file of the benchmark, and the text bytes after which a file ends: what a task holds at a time.
ITEMS_AT_A_TIME, BYTES_AT_A_TIME = 50_000, 16 << 20
#: Counts that a task adds up before it passes them on; bytes of window files that a task keeps.
COUNTS_AT_A_TIME, WINDOW_BYTES = 4 << 20, 128 << 20
_INDEX = "doc_ids array<long>, bounds binary, terms binary, counts binary, postings binary"
_DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_MATCH = "doc_id long, item_id long, window_no long, kind string, position long"


def windows_of(items: list[tuple[int, str]], width: int = WINDOW) -> dict[str, np.ndarray]:
    """terms: the different word hashes, sorted; words: a row of term ranks for each window, -1 beyond a short one; item, no."""
    data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
    words = Words(data, offsets)
    hashes, counts = words.hashes(), words.counts()
    terms, ranks = np.unique(hashes, return_inverse=True)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    item = np.repeat(np.arange(len(items)), n)
    no = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    spans = np.minimum(counts, width)[item]
    at = words.bounds[:-1][item] + no
    table = np.full((len(item), width), -1, np.int32)
    for j in range(width):
        there = spans > j
        table[there, j] = ranks[at[there] + j]
    return {"terms": terms, "words": table, "item": np.asarray([i for i, _ in items], np.int64)[item], "no": no.astype(np.int64)}


def _put(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    f = io.BytesIO()
    np.savez(f, **arrays)
    out = AtomicFile(folder, name)
    out.write(f.getvalue())
    out.commit()


def store_benchmark(benchmark: DataFrame, width: int = WINDOW) -> list[str]:
    """Window files of the benchmark, made by tasks."""
    folder, most, size = shared_folder(benchmark.sparkSession, "windows"), ITEMS_AT_A_TIME, BYTES_AT_A_TIME
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).filter("i is not null and t is not null")

    def write(batches):
        items, held = [], 0

        def one() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.npz"
            _put(folder, name, windows_of(items, width))
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for b in batches:
            for item in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                items.append(item)
                held += len(item[1])
                if len(items) >= most or held >= size:
                    yield one()
                    items, held = [], 0
        if items:
            yield one()

    return sorted(f"{folder}/{r.name}" for r in rows.mapInArrow(write, "name string").collect())  # a name for each file


def load(path: str) -> dict[str, np.ndarray]:
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        z = np.load(io.BytesIO(f.read()))
        return {k: z[k] for k in z.files}


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of the documents: the postings of all their words."""

    def index(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, end, data, offsets in slices(b.column(1)):
                words = Words(data, offsets)
                hashes = words.hashes()
                order = np.argsort(hashes, kind="stable")
                ordered = hashes[order]
                at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else order
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[first:end]], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (words.bounds.astype("<i4"), ordered[at], np.diff(np.append(at, len(ordered))).astype("<i4"), order.astype("<i4")))],
                    ["doc_ids", "bounds", "terms", "counts", "postings"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(index, _INDEX), "postings")


def store_counts(index: DataFrame, paths: list[str]) -> None:
    """Beside each window file the occurrences of its terms in the whole corpus, in the terms' order; counted and written by tasks, one file at a time."""

    def count(batches):
        held: dict[int, np.ndarray] = {}
        sums: dict[int, np.ndarray] = {}

        def rows(of: dict[int, np.ndarray]):
            for i, total in of.items():
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i)), pa.array(used), pa.array(total[used])], ["file", "term", "n"])

        for b in batches:
            postings = [(np.frombuffer(t, np.uint64), np.frombuffer(n, "<i4")) for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            for i, path in enumerate(paths):
                if i not in held:
                    held = {i: load(path)["terms"]}
                known = held[i]
                total = sums.setdefault(i, np.zeros(len(known), np.int64))
                for t, n in postings:
                    if len(t):
                        at = np.minimum(np.searchsorted(t, known), len(t) - 1)
                        total += np.where(t[at] == known, n[at], 0)
            if sum(map(len, sums.values())) > COUNTS_AT_A_TIME:
                yield from rows(sums)
                sums = {}
        yield from rows(sums)

    def write(batches):
        file, found = None, []

        def put() -> None:
            counts = np.zeros(len(load(paths[file])["terms"]), np.int64)
            at = np.array(found, np.int64).reshape(-1, 2)
            counts[at[:, 0]] = at[:, 1]
            folder, name = paths[file].rsplit("/", 1)
            _put(folder, f"counts-{name}", {"counts": counts})

        for b in batches:
            for f, *pair in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if f != file and file is not None:
                    put()
                    found = []
                file = f
                found.append(pair)
        if file is not None:
            put()
        yield from ()

    counted = index.select("terms", "counts").mapInArrow(count, "file long, term long, n long").groupBy("file", "term").agg(F.sum("n").alias("n"))
    counted.repartition("file").sortWithinPartitions("file").mapInArrow(write, "file long").write.format("noop").mode("overwrite").save()


class Block:
    """A row of the index, ready for intersecting."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.bounds = np.frombuffer(row["bounds"], "<i4").astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        self.postings = np.frombuffer(row["postings"], "<i4").astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.span = int(self.bounds[-1]) + 1
        self.keys = np.repeat(np.arange(len(self.terms)) * self.span, self.counts) + self.postings

    def local(self, terms: np.ndarray) -> np.ndarray:
        """The place here of each of the sorted ``terms``, -1 where it doesn't occur."""
        if not len(self.terms) or not len(terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of many terms one after the other, and which of the terms each is of."""
        n = self.counts[terms]
        which = np.repeat(np.arange(len(terms)), n)
        return self.postings[np.repeat(self.first[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())], which

    def within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term's list has a position from low to high."""
        want = term * self.span + np.maximum(low, 0)
        at = np.searchsorted(self.keys, want)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (found <= term * self.span + np.minimum(high, self.span - 1))

    def phrases(self, windows: dict, rarest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of exact occurrences.  rarest: for each window its word places, those of rare terms first."""
        here = np.append(self.local(windows["terms"]), -2)[windows["words"]]
        live = np.flatnonzero((here != -1).all(1))
        if not len(live):
            return live, live
        place = rarest[live, 0]
        at, which = self.lists(here[live, place])
        window, start = live[which], at - place[which]
        for k in range(1, rarest.shape[1]):
            place = rarest[window, k]
            term = here[window, place]
            ok = (term == -2) | self.within(term, start + place, start + place)
            window, start = window[ok], start[ok]
        doc = np.searchsorted(self.bounds, start, "right") - 1
        length = (windows["words"][window] >= 0).sum(1)
        ok = (start >= 0) & (start + length <= self.bounds[np.minimum(doc + 1, len(self.bounds) - 1)])
        return window[ok], start[ok]

    def near(self, windows: dict, rarest: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position): occurrences of a window's rarest term with all its terms at most ``slop`` words off in the same text."""
        here = np.append(self.local(windows["terms"]), -2)[windows["words"]]
        live = np.flatnonzero((here != -1).all(1))
        if not len(live):
            return live, live
        at, which = self.lists(here[live, rarest[live, 0]])
        window = live[which]
        doc = np.searchsorted(self.bounds, at, "right") - 1
        low, high = np.maximum(at - slop, self.bounds[doc]), np.minimum(at + slop, self.bounds[doc + 1] - 1)
        for k in range(1, rarest.shape[1]):
            term = here[window, rarest[window, k]]
            ok = (term == -2) | self.within(term, low, high)
            window, at, low, high = window[ok], at[ok], low[ok], high[ok]
        return window, at


def _rarest(windows: dict, counts: np.ndarray) -> np.ndarray:
    """For each window its word places by ascending frequency, places beyond a short window last."""
    n = np.append(counts, np.iinfo(np.int64).max)[windows["words"]]
    return np.argsort(n, axis=1, kind="stable")


def _loaded(paths: list[str]):
    """A function that gives one window file after the other, with its words' places by rarity; files of WINDOW_BYTES together stay in the task."""
    held: dict[str, tuple] = {}
    room = WINDOW_BYTES

    def one(path: str) -> tuple[dict, np.ndarray]:
        nonlocal room
        if path in held:
            return held[path]
        windows = load(path)
        folder, name = path.rsplit("/", 1)
        fs, counts = opened(f"{folder}/counts-{name}")
        n = load(f"{folder}/counts-{name}")["counts"] if fs.get_file_info(counts).is_file else np.zeros(len(windows["terms"]), np.int64)
        made = windows, _rarest(windows, n)
        size = sum(a.nbytes for a in (*windows.values(), made[1]))
        if size <= room:
            held[path], room = made, room - size
        return made

    return lambda: map(one, paths)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """A row for each document: its words, the words inside any occurrence of a window, and the items they are of."""
    paths = store_benchmark(benchmark, width)
    index = build_index(docs)
    store_counts(index, paths)

    def answer(batches):
        get = _loaded(paths)
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                n = len(block.doc_ids)
                marks, items = np.zeros(block.span + 1, np.int64), [np.zeros((0, 2), np.int64)]
                for windows, rarest in get():
                    window, start = block.phrases(windows, rarest)
                    np.add.at(marks, start, 1)
                    np.add.at(marks, start + (windows["words"][window] >= 0).sum(1), -1)
                    doc = np.searchsorted(block.bounds, start, "right") - 1
                    items.append(np.unique(np.stack([doc, windows["item"][window]], 1), axis=0))
                hit = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
                n_hit = hit[block.bounds[1:]] - hit[block.bounds[:-1]]
                pairs = np.unique(np.concatenate(items), axis=0)
                at = np.searchsorted(pairs[:, 0], np.arange(n + 1))
                none = hashlib.sha256(b"").hexdigest()
                digests = [none if at[i] == at[i + 1] else hashlib.sha256(",".join(sorted(map(str, pairs[at[i] : at[i + 1], 1].tolist()))).encode()).hexdigest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(np.diff(block.bounds)), pa.array(n_hit), pa.array(np.diff(at)), pa.array(digests, pa.string()), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return index.mapInArrow(answer, _DIGEST)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int | None = None) -> DataFrame:
    """A row for each exact occurrence of a window (kind phrase) and, with ``slop``, for each position of a window's
    rarest term that has all the window's terms at most ``slop`` words away in the same text (kind proximity)."""
    paths = store_benchmark(benchmark, width)
    index = build_index(docs)
    store_counts(index, paths)

    def answer(batches):
        get = _loaded(paths)
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                ids = pa.array(block.doc_ids, pa.int64())
                for windows, rarest in get():
                    for kind, (window, at) in (("phrase", block.phrases(windows, rarest)), *([("proximity", block.near(windows, rarest, slop))] if slop is not None else [])):
                        doc = np.searchsorted(block.bounds, at, "right") - 1
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(windows["item"][window]), pa.array(windows["no"][window]), pa.array([kind] * len(at), pa.string()), pa.array(at - block.bounds[doc])], ["doc_id", "item_id", "window_no", "kind", "position"])

    return index.mapInArrow(answer, _MATCH)


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without any hit, all columns kept.  Rows are told apart by a 64-bit hash of doc_id and text, so ids may be null or repeated."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    name = fresh(docs, "hit")
    hit = contamination(docs.select(key.alias("doc_id"), "text"), benchmark, width).filter("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, key == F.col(name), "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
