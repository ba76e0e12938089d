"""Substring dedup by seed and extend: word passages that an earlier document has are removed.

Every run of ``width`` words (a window) has one anchor: the SEED-word run in it with the least hash, the leftmost of equal ones.  That is winnowing, so equal windows have
equal anchors at the same place, and about two anchors cover ``width - SEED + 2`` windows.  Documents are joined on anchors, and an
anchor is extended to both sides as far as windows have it as theirs: to each window belongs the hash of the words that the extension
takes in.  A window repeats where a smaller doc_id has the same anchor extended to the same words; consecutive windows that repeat make a maximal
repeat, which is at least ``width`` words long.  Nothing is paired: of each extension only the smallest doc_id matters.

The documents are stored in blocks, each a file that a task reads alone, so a task has one block in memory, however many it reads.  A block settles repeats within itself and sends, for each range of anchor hashes, its anchors with the
extensions that are first in the block.  Anchors in front of ever different words (those of a common line) may still be too many for one
range: each block lists the anchors that it has often, and one that makes up more than an eighth of an average range is sent by
its extensions' hashes instead.  Which extensions repeat in other blocks comes back as a bit for each, in files of shared storage, and the blocks, read again, cut their texts.

Edge cases: null and wordless texts have no words; texts of fewer than ``width`` words have no windows and stay whole; rows with equal
doc_ids aren't earlier than one another; a null doc_id comes after all others; an empty table gives no rows.  Anchors are compared by
64 bits of hash and extensions by a further 48.
"""

from __future__ import annotations

import functools
import io
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.text import BYTE_VALUES, NOT_SPACE, Words, mixed, slices, utf8
from quillspark.llm.work import AtomicFile, opened, shared_folder, stored
from quillspark.storage import write_shared

WIDTH, SEED = 13, 5
#: Text bytes of a block; windows of a range, about; those of a range that are compared at a time, where no anchor has more; blocks that a task reads one after the other.
BLOCK_BYTES, WINDOWS_A_RANGE, WINDOWS_AT_A_TIME, BLOCKS_A_TASK = 4 << 20, 2 << 20, 1 << 19, 8
#: Occurrences from which a block lists an anchor; the part of an average range from which an anchor is split.
OFTEN, SHARE = 8, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max
_BLOCK = "part int, block long, path string, n_words long, n_anchors long, often binary, times binary"
_SEEDS = "part int, block long, bucket int, anchors binary, docs binary, reach binary, low binary, high binary"
_CUT = "doc_id long, text string, n_words long, n_removed long, repeats array<struct<start: long, length: long>>"


def blocks_of(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """The documents, in a shared file for each block of about BLOCK_BYTES of text; its row has the path and the anchors that the block has OFTEN."""
    folder = shared_folder(docs.sparkSession, "texts")

    def cut(batches):
        part, block = TaskContext.get().partitionId(), 0
        for b in batches:
            for first, end, data, offsets in slices(b.column(1), BLOCK_BYTES):
                words = Words(data, offsets, NOT_SPACE)
                anchors = Windows(words, np.arange(end - first), width, seed).anchor
                often, times = np.unique(anchors, return_counts=True)
                listed = times >= OFTEN
                path, out = f"{folder}/{uuid.uuid4().hex}", pa.BufferOutputStream()  # a repeated task writes others, and the rows are those of one attempt
                pq.write_table(pa.Table.from_batches([b.slice(first, end - first)]), out, use_dictionary=False, write_statistics=False, compression="zstd")
                write_shared(path, out.getvalue())
                numbers = (pa.array([part], pa.int32()), *(pa.array([x]) for x in (block, path, len(words), len(anchors))))
                yield pa.RecordBatch.from_arrays([*numbers, *(pa.array([x[listed].tobytes()], pa.binary()) for x in (often, times))], [c.split(" ")[0] for c in _BLOCK.split(", ")])
                block += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(cut, _BLOCK), "blocks")


def _paths(blocks: DataFrame) -> DataFrame:
    """The blocks' paths on all cores, BLOCKS_A_TASK or so for a task, those of a part together."""
    n = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-blocks.count() // BLOCKS_A_TASK))
    return blocks.select("part", "block", "path").repartitionByRange(n, "part", "block")


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, by doubling."""
    done, size, part = None, 0, hashes
    width, power = 1, _BASE
    with np.errstate(over="ignore"):
        while True:
            if n & width:
                if done is None:
                    done, size = part, width
                else:
                    m = len(hashes) - size - width + 1
                    done = done[:m] * power + part[size : size + m] if m > 0 else done[:0]
                    size += width
            if width * 2 > n:
                return mixed(done ^ np.uint64(n))
            m = len(part) - width
            part = part[:m] * power + part[width:] if m > 0 else part[:0]
            width, power = width * 2, power * power


class Windows:
    """The windows of a block's texts, in order: first word, document, hash and anchor; runs of windows with one anchor are its ``reach``."""

    def __init__(self, words: Words, doc_ids: np.ndarray, width: int, seed: int):
        hashes, counts = words.hashes(BYTE_VALUES), words.counts()
        n = np.maximum(counts - width + 1, 0)
        self.start = np.repeat(words.bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.doc = np.repeat(doc_ids, n)
        self.words, self.width = hashes, width
        seeds = _runs(hashes, seed)
        best, at = seeds[self.start], np.zeros(len(self.start), np.int64)
        for j in range(1, width - seed + 1):
            other = seeds[self.start + j]
            less = other < best
            best, at = np.where(less, other, best), np.where(less, j, at)
        at += self.start
        text = np.repeat(np.arange(len(n)), n)
        new = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        self.first = np.flatnonzero(np.concatenate([[True], new])) if len(at) else at  # the first window of each anchor
        self.reach = np.diff(np.append(self.first, len(at)))
        self.anchor = best[self.first]

    @functools.cached_property
    def hash(self) -> np.ndarray:
        return _runs(self.words, self.width)[self.start]

    def leaders(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window the first one in the block with its words and the least doc_id, and whether a smaller doc_id of the block has it."""
        order = np.argsort(self.hash, kind="stable")
        h, d = self.hash[order], self.doc[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else order
        size = np.diff(np.append(starts, len(h)))
        least = np.repeat(np.minimum.reduceat(d, starts), size) if len(h) else d
        place = np.where(d == least, order, len(h))
        leader = np.repeat(np.minimum.reduceat(place, starts), size) if len(h) else order
        lead, later = np.empty(len(h), np.int64), np.empty(len(h), bool)
        lead[order], later[order] = leader, d > least
        return lead, later

    def sent(self, lead: np.ndarray, n: int, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, its first window, its reach, the first of each range's) of anchors that have a window which leads its equals in the block, by
        range; an anchor of ``split`` comes once for each window, in the range of that window's hash."""
        some = np.flatnonzero(np.add.reduceat(lead == np.arange(len(lead)), self.first) > 0) if len(lead) else self.first
        at = np.minimum(np.searchsorted(split, self.anchor[some]), max(len(split) - 1, 0))
        parted = split[at] == self.anchor[some] if len(split) else np.zeros(len(some), bool)
        whole, single = some[~parted], _spans(self.reach[some[parted]], self.first[some[parted]])
        anchor = np.concatenate([self.anchor[whole], np.repeat(self.anchor[some[parted]], self.reach[some[parted]])])
        first, reach = np.concatenate([self.first[whole], single]), np.concatenate([self.reach[whole], np.ones(len(single), np.int64)])
        ranges = np.concatenate([_bucket(self.anchor[whole], n), _bucket(self.hash[single], n)])
        order = np.argsort(ranges, kind="stable")
        return anchor[order], first[order], reach[order], np.searchsorted(ranges[order], np.arange(n + 1))


def _windows(row: dict, width: int, seed: int) -> tuple[Words, Windows]:
    data, offsets = utf8(row["texts"])
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    words = Words(data, offsets, NOT_SPACE)
    ids = row["doc_ids"]
    return words, Windows(words, ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64), width, seed)


def _stored_rows(batches):
    """The blocks that rows (part, block, path) name, one at a time, their columns as Arrow arrays."""
    for b in batches:
        for part, block, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
            fs, p = opened(path)
            with fs.open_input_file(p) as f:
                rows = pq.ParquetFile(f).read()
            yield {"part": part, "block": block, "doc_ids": rows.column(0).combine_chunks(), "texts": rows.column(1).combine_chunks()}


def _ranges(blocks: DataFrame) -> tuple[int, str]:
    """The number of ranges of anchor hashes that are joined apart, at least as many as shuffle partitions and more for large inputs, and
    a shared file of the anchors that are split: SHARE for each range at most."""
    total = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_anchors").alias("anchors")).first()
    n = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total["words"] or 0) // WINDOWS_A_RANGE))

    def listed(batches):
        for b in batches:
            for often, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(often, np.int64)), pa.array(np.frombuffer(times, np.int64))], ["anchor", "n"])

    counted = blocks.select("often", "times").mapInArrow(listed, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    least = max(OFTEN, int(total["anchors"] or 0) // (SHARE * n))
    split = np.sort(np.array([r.anchor for r in counted.filter(F.col("n") > least).select("anchor").collect()], np.int64).view(np.uint64))  # SHARE x n rows at most
    folder, f = shared_folder(blocks.sparkSession, "split"), io.BytesIO()
    np.save(f, split)
    out = AtomicFile(folder, "anchors.npy")
    out.write(f.getvalue())
    out.commit()
    return n, f"{folder}/anchors.npy"


def _loaded(path: str) -> np.ndarray:
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        return np.load(io.BytesIO(f.read()))


def _spans(reach: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of the windows of anchors."""
    return np.repeat(starts - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range of each hash; mixed, since anchors are least hashes and so mostly small."""
    with np.errstate(over="ignore"):
        return ((mixed(hashes) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def seeds_of(paths: DataFrame, n: int, split: str, width: int, seed: int) -> DataFrame:
    """For each block and range of anchor hashes the block's anchors, their documents and their extensions' hashes."""

    def send(batches):
        parted = _loaded(split)
        for row in _stored_rows(batches):
            _, w = _windows(row, width, seed)
            anchor, first, reach, cuts = w.sent(w.leaders()[0], n, parted)
            out = []
            for k in np.flatnonzero(np.diff(cuts)):
                at = slice(cuts[k], cuts[k + 1])
                hashes = w.hash[_spans(reach[at], first[at])]
                out.append((row["part"], row["block"], k, anchor[at].tobytes(), w.doc[first[at]].tobytes(), reach[at].astype(np.uint8).tobytes(), (hashes >> np.uint64(32)).astype("<u4").tobytes(), (hashes >> np.uint64(16)).astype("<u2").tobytes()))
            if out:
                types = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["part", "block", "bucket", "anchors", "docs", "reach", "low", "high"])

    return paths.mapInArrow(send, _SEEDS)


def repeated(anchor: np.ndarray, doc: np.ndarray, reach: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Whether each window (of the anchors, in order) has the same anchor and extension in a smaller doc_id."""
    out = np.zeros(len(window), bool)
    if not len(anchor):
        return out
    order = np.argsort(anchor, kind="stable")
    a, d = anchor[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    several = np.flatnonzero(np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts))  # anchors of several documents
    bounds, begins = np.append(starts, len(a)), np.cumsum(reach) - reach
    size = np.add.reduceat(reach[order], starts)[several]
    so_far, low = np.cumsum(size), 0
    while low < len(several):
        high = max(low + 1, int(np.searchsorted(so_far, so_far[low] - size[low] + WINDOWS_AT_A_TIME, "right")))
        some = several[low:high]
        n = bounds[some + 1] - bounds[some]
        which = order[_spans(n, bounds[some])]
        at = _spans(reach[which], begins[which])
        key, value, docs = np.repeat(np.repeat(np.arange(len(some)), n), reach[which]), window[at], np.repeat(doc[which], reach[which])
        by = np.lexsort((value, key))
        same = (key[by][1:] == key[by][:-1]) & (value[by][1:] == value[by][:-1])
        firsts = np.flatnonzero(np.concatenate([[True], ~same]))
        ordered = docs[by]
        out[at[by]] = ordered > np.repeat(np.minimum.reduceat(ordered, firsts), np.diff(np.append(firsts, len(by))))
        low = high
    return out


def store_answers(seeds: DataFrame, n: int) -> str:
    """A shared folder with a file for each part of the blocks: for its blocks and ranges a bit for each extension that was sent."""
    folder = shared_folder(seeds.sparkSession, "answers")

    def join(batches):
        heads, parts = [], [[] for _ in range(5)]
        for b in batches:
            heads.append(b.select(["part", "block", "bucket"]))
            for held, c, kind in zip(parts, ("anchors", "docs", "reach", "low", "high"), (np.uint64, np.int64, np.uint8, "<u4", "<u2"), strict=True):
                held += [np.frombuffer(x.as_buffer(), kind) for x in b.column(c)]
        if not parts[0]:
            return
        cuts = np.cumsum([len(x) for x in parts[3]])[:-1]
        anchor, doc, reach, low, high = (np.concatenate(x) for x in parts)
        parts.clear()
        window = low.astype(np.int64)
        window <<= 16
        window |= high
        del low, high
        found = repeated(anchor, doc, reach.astype(np.int64), window)
        bits = [np.packbits(x).tobytes() if x.any() else b"" for x in np.split(found, cuts)]
        rows = pa.Table.from_batches(heads).combine_chunks()
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in rows.columns), pa.array(bits, pa.binary())], ["part", "block", "bucket", "bits"])

    def write(batches):
        part, held = None, {}

        def put() -> None:
            f = io.BytesIO()
            np.savez(f, **held)
            out = AtomicFile(folder, f"{part}.npz")
            out.write(f.getvalue())
            out.commit()

        for b in batches:
            for p, block, bucket, bits in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if p != part and part is not None:
                    put()
                    held = {}
                part = p
                held[f"{block}-{bucket}"] = np.frombuffer(bits, np.uint8)
        if part is not None:
            put()
        yield from ()

    answers = seeds.repartitionById(n, F.col("bucket")).mapInArrow(join, "part int, block long, bucket int, bits binary").filter("length(bits) > 0")
    answers.repartition("part").sortWithinPartitions("part").mapInArrow(write, "part int").write.format("noop").mode("overwrite").save()
    return folder


def cut_texts(words: Words, gone: np.ndarray) -> pa.Array:
    """The texts' other words, joined by one space."""
    data, bounds = words.data, words.bounds
    kept = np.flatnonzero(~gone)
    first = np.zeros(len(words), bool)
    at = np.searchsorted(kept, bounds[:-1])
    heads = at[at < np.searchsorted(kept, bounds[1:])]
    first[kept[heads]] = True
    edge = np.zeros(len(data) + 1, np.int8)
    lead = words.starts[kept] - ~first[kept]  # the white space before a word that isn't a text's first
    np.add.at(edge, lead, 1)
    np.add.at(edge, words.ends[kept], -1)
    taken = np.cumsum(edge[:-1], dtype=np.int8) > 0
    out = np.where(NOT_SPACE[data], data, np.uint8(0x20))[taken]
    sizes = np.concatenate([[0], np.cumsum(words.ends[kept] - lead)])
    offsets = sizes[np.searchsorted(kept, bounds)].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())


def without_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """A row for each document: doc_id, text (the words that stay, joined by one space), n_words, n_removed and the maximal repeats, as spans of words."""
    blocks = blocks_of(docs, width, seed)
    n, split = _ranges(blocks)
    paths = _paths(blocks)
    folder = store_answers(seeds_of(paths, n, split, width, seed), n)

    def answer(batches):
        part, found, parted = None, {}, _loaded(split)
        for row in _stored_rows(batches):
            if row["part"] != part:
                part, found = row["part"], {}
                fs, path = opened(f"{folder}/{part}.npz")
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    with fs.open_input_file(path) as f:
                        z = np.load(io.BytesIO(f.read()))
                        found = {k: z[k] for k in z.files}
            words, w = _windows(row, width, seed)
            lead, later = w.leaders()
            _, first, reach, cuts = w.sent(lead, n, parted)
            elsewhere = np.zeros(len(lead), bool)
            for k in np.flatnonzero(np.diff(cuts)):
                bits = found.get(f"{row['block']}-{k}")
                if bits is not None:
                    at = _spans(reach[cuts[k] : cuts[k + 1]], first[cuts[k] : cuts[k + 1]])
                    elsewhere[at] = np.unpackbits(bits, count=len(at)) > 0
            hit = w.start[later | elsewhere[lead]]
            marks = np.zeros(len(words) + width + 1, np.int64)
            np.add.at(marks, hit, 1)
            np.add.at(marks, hit + width, -1)
            gone = np.cumsum(marks)[: len(words)] > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            inner = np.zeros(len(words) + 1, bool)
            inner[words.bounds] = True  # a repeat ends with its text
            edge = gone & (inner[:-1] | ~np.concatenate([[False], gone[:-1]]))
            begin = np.flatnonzero(edge)
            stop = np.flatnonzero(gone & (inner[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
            text = np.searchsorted(words.bounds, begin, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(begin - words.bounds[text]), pa.array(stop - begin)], ["start", "length"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, words.bounds), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([row["doc_ids"], cut_texts(words, gone), pa.array(words.counts()), pa.array(removed[words.bounds[1:]] - removed[words.bounds[:-1]]), lists], ["doc_id", "text", "n_words", "n_removed", "repeats"])

    return paths.mapInArrow(answer, _CUT)


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
