"""Packing along a space-filling curve.

Each document's words vote, by signed hashes, for a point in a few dimensions; the point's place on a
Hilbert curve is the sort key.  Documents follow each other in range-sorted curve order as one stream of
tokens, cut into sequences at every 2048th token, so only the last sequence has padding.  Where a
partition's stream begins comes from the partitions' token totals alone.

Range bounds are on (curve key, doc_id), which splits a group of equal documents over partitions.

Edge cases: null texts count as empty and have only the end id; wordless texts lie at one point of the
curve; repeated rows are packed one by one (each row counts as a document of its own); an empty table
gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.text import Words, slices
from quillspark.llm.tokens import tokenizer_path, worker_encoder
from quillspark.llm.work import stored

SEQUENCE, END_ID = 2048, 1
VOCABULARY = "byte_bpe_50k.json"
DIMENSIONS, BITS = 4, 15
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def document_points(words: Words) -> np.ndarray:
    """Unit vectors of DIMENSIONS: sums of the words' hashed places, 16 bits of a word's hash for each dimension; the origin for a wordless text."""
    hashed = words.hashes().view(np.uint16).reshape(-1, DIMENSIONS)
    sums = np.zeros((len(words.bounds) - 1, DIMENSIONS))
    for d in range(DIMENSIONS):
        total = np.concatenate([[0], np.cumsum(hashed[:, d], dtype=np.int64)])
        sums[:, d] = total[words.bounds[1:]] - total[words.bounds[:-1]]
    sums -= 32767.5 * words.counts()[:, None]
    length = np.sqrt((sums**2).sum(1, keepdims=True))
    return sums / np.where(length == 0, 1, length)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points in [-1, 1]**d: axes to transposed index by inverse undoing of
    the curve's rotations, a bit plane at a time, then Gray coding and interleaving."""
    axes = np.clip((points + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64).T.copy()
    d = len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (axes[i] & q) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(high, low, swap)
            axes[i] ^= swap
        q >>= 1
    for i in range(1, d):
        axes[i] ^= axes[i - 1]
    flip = np.zeros_like(axes[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(axes[d - 1] & q, q - 1, 0)
        q >>= 1
    axes ^= flip
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((axes[i] >> b) & 1)
    return key


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY, tokenizers: str | None = None) -> DataFrame:
    """Stored rows: row_id (a document's row), doc_id, curve key, number of tokens, ids as unsigned 16- or 32-bit bytes."""
    path = tokenizer_path(vocabulary, tokenizers)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        encoder = worker_encoder(path)
        width, row = encoder.dtype.itemsize, TaskContext.get().partitionId() << 36
        for b in batches:
            for first, stop, data, offsets in slices(b.column(1)):
                keys = hilbert_key(document_points(Words(data, offsets)))
                ids, bounds = encoder.encode(data, offsets, END_ID)
                n = stop - first
                made = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds * width), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), b.column(0).slice(first, n), pa.array(keys), pa.array(np.diff(bounds)), made], ["row_id", "doc_id", "place", "n", "ids"])
                row += n

    return stored(rows.mapInArrow(run, "row_id long, doc_id long, place long, n long, ids binary"), "packed-ids")


def curve_starts(tokens: DataFrame) -> DataFrame:
    """row_id and the place of its first token in the stream along the curve.

    Only keys and lengths are sorted; partition totals (a row for each partition) give the offsets.
    """
    spark = tokens.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["place", "doc_id", "row_id"]
    ordered = tokens.select(*keys, "n").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def run(batches):
        total, part = 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(total + np.cumsum(n) - n), b.column("n"), pa.array(np.full(len(n), part, np.int64))], ["row_id", "at", "n", "part"])
            total += int(n.sum())

    local = stored(ordered.mapInArrow(run, "row_id long, at long, n long, part long"), "curve")
    totals = sorted((r.part, r.n) for r in local.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, bases = 0, []
    for part, n in totals:
        bases.append((part, base))
        base += n
    table = spark.createDataFrame(bases or [(-1, 0)], "part long, base long")
    return local.join(F.broadcast(table), "part").select("row_id", (F.col("at") + F.col("base")).alias("at"))


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, tokenizers: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if ``keep_ids``."""
    tokens = tokenised(docs, vocabulary, tokenizers)
    placed = tokens.join(curve_starts(tokens), "row_id").select("doc_id", "n", "ids", "at")
    columns = [x.split()[0] for x in _PIECE.split(", ")] + ["ids"] * keep_ids

    def cut(batches):
        for b in batches:
            out = []
            for doc, n, ids, at in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, SEQUENCE)
                    length = min(n - start, SEQUENCE - offset)
                    piece = ids[start : start + length]
                    out.append((doc, start, length, zlib.crc32(piece), n, seq, offset, *([piece.tobytes()] * keep_ids)))
                    start += length
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if c == "ids" else pa.int64()) for i, c in enumerate(columns)], columns)

    return placed.mapInArrow(cut, _PIECE + ", ids binary" * keep_ids)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
