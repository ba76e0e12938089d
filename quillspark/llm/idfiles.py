"""Token-id files: fixed-width bit packing with block offsets.

A file holds the ids of consecutive documents.  Each id takes the minimum number of bits for the
vocabulary; ids are packed, lowest bit first, in blocks of BLOCK ids that begin at a byte, and a footer
has the offset of each block, the document ids and each document's first id.  Any range of ids can be
read by seeking to its blocks and unpacking them with numpy.

    magic | packed blocks | block offsets u64 | doc_id i64 (and null flags u8) | first id of each document u64 | header JSON | its length u64

Edge cases: null texts count as empty and have only the end id; rows are ordered by doc_id (null first),
equal doc_ids by a 64-bit digest of the text; an empty table makes no file.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.text import slices
from quillspark.llm.tokens import tokenizer_path, worker_encoder
from quillspark.llm.work import AtomicFile, opened, shared_folder

MAGIC, BLOCK, END_ID = b"QSIDS001", 4096, 1
VOCABULARY = "word_bpe_49k.json"
#: Ids read or encoded at a time.
AT_A_TIME = 1 << 20


def bits_for(vocabulary: int) -> int:
    """The minimum number of bits that can hold the ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and bits < 32 and int(ids.max()) >> bits:
        raise ValueError(f"an id doesn't fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros((n, 32), np.uint8)
    out[:, :bits] = each
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


class IdWriter:
    """Streams documents to a file; memory holds a slice of the texts' ids and the footer."""

    def __init__(self, folder: str, name: str, bits: int):
        self.out, self.bits, self.path = AtomicFile(folder, name), bits, f"{folder}/{name}"
        self.out.write(MAGIC)
        self.at, self.rest, self.n = len(MAGIC), np.zeros(0, "<u4"), 0
        self.blocks: list[int] = []
        self.docs: list[int | None] = []
        self.firsts: list[int] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents, their ids one after the other and the bounds of each one's."""
        self.docs += doc_ids
        self.firsts += (self.n + bounds[:-1]).tolist()
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype("<u4")])
        self._blocks(len(self.rest) // BLOCK * BLOCK)

    def _blocks(self, upto: int) -> None:
        for i in range(0, upto, BLOCK):
            data = pack(self.rest[i : min(upto, i + BLOCK)], self.bits)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.rest = self.rest[upto:]

    def close(self) -> None:
        self._blocks(len(self.rest))
        parts = [np.asarray(self.blocks, "<u8"), np.asarray([d or 0 for d in self.docs], "<i8"), np.asarray([d is None for d in self.docs], np.uint8), np.asarray(self.firsts, "<u8")]
        head = json.dumps({"bits": self.bits, "block": BLOCK, "ids": self.n, "docs": len(self.docs), "blocks": len(self.blocks), "footer": self.at}).encode()
        self.out.write(b"".join([*(p.tobytes() for p in parts), head, np.uint64(len(head)).tobytes()]))
        self.out.commit()


class IdReader:
    """Random access to the ids of a file."""

    def __init__(self, path: str):
        fs, p = opened(path)
        self.f = fs.open_input_file(p)
        size = self.f.size()
        if self.f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} isn't a token-id file")
        n = int(np.frombuffer(self.f.read_at(8, size - 8), "<u8")[0])
        h = json.loads(self.f.read_at(n, size - 8 - n))
        self.bits, self.block, self.n, docs, blocks = h["bits"], h["block"], h["ids"], h["docs"], h["blocks"]
        foot = self.f.read_at(size - 8 - n - h["footer"], h["footer"])
        a, b, c = 8 * blocks, 8 * blocks + 8 * docs, 8 * blocks + 9 * docs
        self.offsets = np.append(np.frombuffer(foot[:a], "<u8"), h["footer"]).astype(np.int64)
        none = np.frombuffer(foot[b:c], np.uint8)
        self.doc_ids = [None if x else int(d) for d, x in zip(np.frombuffer(foot[a:b], "<i8"), none, strict=True)]
        self.firsts = np.append(np.frombuffer(foot[c:], "<u8"), self.n).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end - 1 of the file."""
        if start >= end:
            return np.zeros(0, "<u4")
        a, z = start // self.block, -(-end // self.block)
        data = self.f.read_at(int(self.offsets[z] - self.offsets[a]), int(self.offsets[a]))
        parts = [unpack(data[self.offsets[i] - self.offsets[a] : self.offsets[i + 1] - self.offsets[a]], min(self.block, self.n - i * self.block), self.bits) for i in range(a, z)]
        return np.concatenate(parts)[start - a * self.block : end - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.firsts[i]), int(self.firsts[i + 1]))


def write_ids(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, tokenizers: str | None = None) -> list[tuple[str, int]]:
    """Files in ascending doc_id order as (path, number of ids).

    Documents are dealt by ranges of (doc_id, digest of the text), so a repeated doc_id can't fill one task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    path = tokenizer_path(vocabulary, tokenizers)

    def write(batches):
        encoder, out = worker_encoder(path), None
        bits, part = bits_for(encoder.tokenizer.get_vocab_size()), TaskContext.get().partitionId()
        for b in batches:
            out = out or IdWriter(folder, f"part-{part:06d}.ids", bits)
            for first, stop, data, offsets in slices(b.column(1)):
                out.add(b.column(0).slice(first, stop - first).to_pylist(), *encoder.encode(data, offsets, END_ID))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [out.path], "ids": [out.n]})

    made = rows.mapInArrow(write, "part long, path string, ids long").collect()  # a row for each file
    return [(r.path, r.ids) for r in sorted(made)]


def read_ids(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, a task for each file."""
    starts = np.cumsum([0, *(n for _, n in files)]).tolist()

    def read(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                r = IdReader(files[k][0])
                i, docs = 0, len(r.doc_ids)
                while i < docs:
                    j = max(i + 1, int(np.searchsorted(r.firsts, r.firsts[i] + AT_A_TIME, "right")) - 1)
                    got, at = r.ids(int(r.firsts[i]), int(r.firsts[j])), r.firsts[i : j + 1] - r.firsts[i]
                    crc = [zlib.crc32(got[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[i:j], pa.int64()), pa.array(r.firsts[i:j] + starts[k]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_ids(spark, write_ids(docs, shared_folder(spark, "ids")))
