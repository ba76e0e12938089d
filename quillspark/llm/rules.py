"""Quality rules and a target-against-raw likelihood ratio.

Every word and word pair of a text is hashed to one of BUCKETS n-gram features.  Two multinomials are
estimated: the trusted target from all documents labelled good, the raw one from all documents.  A text's
verdict is the mean over its n-grams of log p_target - log p_raw, at least THRESHOLD to be kept; the mean
makes it independent of length.  Base rules on counts go first.

Counts are summed over all documents with partial sums for each partition; only the BUCKETS totals, a
fixed number, reach the driver.

Edge cases: a null or wordless text has no words, counts of 0 and fails the base rules; repeated rows count
and are judged one by one; without a target the ratio is 0 for every text; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.text import BYTE_VALUES, NOT_SPACE, Words, mixed, slices
from quillspark.llm.work import AtomicFile, opened, shared_folder, stored

BUCKETS, SMOOTHING = 1 << 17, 1.0
#: Ids in a file of the documents labelled good: what a task holds at a time.
IDS_AT_A_TIME = 1 << 20
#: Mean log-likelihood ratio for an n-gram that a kept text has at least.
THRESHOLD = -0.1
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_STARTS = np.ones(256, bool)
_STARTS[0x80:0xC0] = False  # a UTF-8 continuation byte doesn't begin a code point
_ROWS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def grams(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, then of all pairs of neighbours, and the text of each."""
    text = words.text_of()
    with np.errstate(over="ignore"):
        pairs = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    within = text[1:] == text[:-1] if len(text) else np.zeros(0, bool)
    both = np.concatenate([hashes, pairs[within] if len(hashes) else pairs])
    return (both >> np.uint64(47)).astype(np.int64), np.concatenate([text, text[1:][within]])


def _id_files(ids: DataFrame) -> list[str]:
    """Shared files of sorted ids, IDS_AT_A_TIME at most in each.  ids: one long column without nulls, distinct."""
    ids = stored(ids, "good-ids")
    folder, most = shared_folder(ids.sparkSession, "good"), IDS_AT_A_TIME

    def write(batches):
        held = [np.zeros(0, np.int64)]
        for b in batches:
            held.append(b.column(0).to_numpy())
            while sum(map(len, held)) >= most:
                every = np.concatenate(held)
                held = [every[most:]]
                yield one(every[:most])
        if sum(map(len, held)):
            yield one(np.concatenate(held))

    def one(part: np.ndarray) -> pa.RecordBatch:
        name = uuid.uuid4().hex
        file = AtomicFile(folder, name)
        file.write(np.sort(part).astype("<i8").tobytes())
        file.commit()
        return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    files = ids.coalesce(max(1, -(-ids.count() // most))).mapInArrow(write, "name string").collect()  # a name for IDS_AT_A_TIME ids
    return sorted(f"{folder}/{r.name}" for r in files)


def _ids_in(path: str) -> np.ndarray:
    fs, at = opened(path)
    with fs.open_input_stream(at) as f:
        return np.frombuffer(f.read(), "<i8")


def gram_counts(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each bucket in the target documents and in all documents, in one pass over the texts.

    The target is all documents labelled good.  Tasks look their ids up in sorted files of shared storage, one
    file at a time, so no text is shuffled and the number of labels isn't limited by a broadcast.
    """
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("good_id")).filter("good_id is not null").distinct()
    paths = _id_files(good)
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        totals = np.zeros((2, BUCKETS), np.int64)
        kept = [_ids_in(p) for p in paths] if len(paths) == 1 else None
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy()
            target = np.zeros(len(ids), bool)
            for known in kept or map(_ids_in, paths):
                target |= known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids
            target &= b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for first, end, data, offsets in slices(b.column(1)):
                words = Words(data, offsets, NOT_SPACE)
                bucket, text = grams(words, words.hashes(BYTE_VALUES))
                totals[1] += np.bincount(bucket, minlength=BUCKETS)
                totals[0] += np.bincount(bucket[target[first:end][text]], minlength=BUCKETS)
        used = np.flatnonzero(totals[1])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[0][used]), pa.array(totals[1][used])], ["bucket", "t", "r"])

    got = flagged.mapInArrow(run, "bucket int, t long, r long").groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("r").alias("r")).toArrow()  # BUCKETS rows at most
    out = np.zeros((2, BUCKETS), np.int64)
    out[:, got.column("bucket").to_numpy()] = [got.column("t").to_numpy(), got.column("r").to_numpy()]
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    p, q = (np.log(x + SMOOTHING) - np.log(x.sum() + SMOOTHING * BUCKETS) for x in (target, raw))
    return p - q


def _repeats(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Words in windows of WINDOW words that their text has twice or more, the first included, by text."""
    n = len(words.bounds) - 1
    counts = words.counts()
    marks = np.zeros(len(words) + 1, np.int64)
    if len(words) >= WINDOW:
        with np.errstate(over="ignore"):
            h = np.zeros(len(words) - WINDOW + 1, np.uint64)
            for j in range(WINDOW):
                h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(h) + j]
            text = words.text_of()
            at = np.flatnonzero(text[: len(h)] == text[WINDOW - 1 :])
            key = mixed(h[at] ^ mixed(text[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(at) else at
        np.add.at(marks, twice, 1)
        np.add.at(marks, twice + WINDOW, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    return hit[words.bounds[1:]] - hit[words.bounds[:-1]] if n else counts


def _dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def judged(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document with the base counts, its mean log ratio and the verdict."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            for first, end, data, offsets in slices(b.column(1)):
                n = end - first
                words = Words(data, offsets, NOT_SPACE)
                hashes = words.hashes(BYTE_VALUES)
                sums = lambda mask: (c := np.concatenate([[0], np.cumsum(mask, dtype=np.int64)]))[offsets[1:]] - c[offsets[:-1]]
                n_words, repeats = words.counts(), _repeats(words, hashes)
                bucket, text = grams(words, hashes)
                llr = np.bincount(text, ratio[bucket], n) / np.maximum(np.bincount(text, minlength=n), 1)
                failed = (n_words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
                dups = [_dup_lines(t) for t in b.column(1).slice(first, n).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), *(pa.array(x.astype(np.int64)) for x in (n_words, sums(NOT_SPACE[data] & _STARTS[data]), sums(_SYMBOLS[data]))), pa.array(dups, pa.int64()), pa.array(repeats.astype(np.int64)), pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold))],
                    [x.split()[0] for x in _ROWS.split(", ")],
                )

    return rows.mapInArrow(run, _ROWS)


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(docs, log_ratio(*gram_counts(docs, labels)))
