"""Ranked lexical search on a bit-sliced impact index.

A document's impact for a term is an integer of IMPACT_BITS bits that depends on the term's occurrences and the document's length only.  The index is sharded by
document: a row is a block of documents in ascending doc_id, with its terms, the documents of each term, and IMPACT_BITS bitmaps over these
postings, one for each bit of the impacts.  It has all terms of all documents, so one index answers any queries.

A block answers a file of queries by bitwise arithmetic on bitmaps over its documents, 64 documents a machine word: a term's bitmaps are
multiplied by its weight with shifts and carries, the products of a query's terms are added with carries (a term that a query repeats
r times is shifted by each bit of r), and the top k are found from the most significant slice down.  All terms, and all queries of a group, take each step together.
What a block returns is its top k of each query, and their union is ranked.

Counts (documents, their terms, documents of each query term) cover all documents; they and the queries' weights go through shared files and tables, not through the driver.

Edge cases: null texts and texts without terms are never found, but belong to a block; an item without terms or of terms that no document has
gets no rows; items are ranked row by row, so equal item_ids are ranked each for itself; rows that share a doc_id count one by one; a null
doc_id comes after all others of its score; empty tables give no rows.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.text import Words, slices, utf8
from quillspark.llm.work import AtomicFile, opened, shared_folder, stored

TOP, IMPACT_BITS, SCALE = 20, 20, 1_000_000_000
#: Text bytes of a block; items in a query file, items that are added up together.
BLOCK_BYTES, ITEMS_A_FILE, ITEMS_TOGETHER = 8 << 20, 4096, 64
_INDEX = "doc_ids array<long>, terms binary, counts binary, places binary, slices array<binary>"
_FOUND = "file string, item_row long, item_id long, doc_id long, score long"
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents that have a term, and terms of all documents with repeats."""

    def count(batches):
        some = total = 0
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                n = Words(data, offsets).counts()
                some, total = some + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([total])], ["some", "total"])

    row = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "some long, total long").agg(F.sum("some").alias("some"), F.sum("total").alias("total")).first()
    return int(row["some"] or 0), int(row["total"] or 0)


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The impact of ``tf`` occurrences in a document of ``length`` terms."""
    norm = 100 - 25 + (25 * length.astype(np.int64) * n_docs) // max(n_terms, 1)
    return (SCALE * tf.astype(np.int64)) // (1000 * tf + 12 * norm)


def build_index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The stored index of all terms of all documents."""

    def index(batches):
        for b in batches:
            b = b.take(pc.sort_indices(b.column(0)))  # null last
            ids = b.column(0).to_pylist()
            for first, end, data, offsets in slices(b.column(1), BLOCK_BYTES):
                words = Words(data, offsets)
                hashes, text, lengths = words.hashes(), words.text_of(), words.counts()
                order = np.argsort(hashes, kind="stable")  # within a term by document
                h, d = hashes[order], text[order]
                starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else order
                tf, d, h = np.diff(np.append(starts, len(h))), d[starts], h[starts]
                v = impacts(tf, lengths[d], n_docs, n_terms)
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else starts
                bits = [np.packbits((v >> s) & 1 > 0, bitorder="little").tobytes() for s in range(IMPACT_BITS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[first:end]], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (h[at], np.diff(np.append(at, len(h))).astype("<i4"), d.astype("<i4"))), pa.array([bits], pa.list_(pa.binary()))],
                    ["doc_ids", "terms", "counts", "places", "slices"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(index, _INDEX), "impacts")


def _put(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    f = io.BytesIO()
    np.savez(f, **arrays)
    out = AtomicFile(folder, name)
    out.write(f.getvalue())
    out.commit()


def _load(path: str) -> dict[str, np.ndarray]:
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        z = np.load(io.BytesIO(f.read()))
        return {k: z[k] for k in z.files}


def query_arrays(items: list[tuple[int | None, str]]) -> dict[str, np.ndarray]:
    """terms: the different term hashes, sorted; and a row for each item and different term: item, term (its rank), times."""
    data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
    words = Words(data, offsets)
    terms, rank = np.unique(words.hashes(), return_inverse=True)
    pairs, times = np.unique(words.text_of() * max(len(terms), 1) + rank, return_counts=True)
    null = np.array([i is None for i, _ in items], bool)
    return {"terms": terms, "item": pairs // max(len(terms), 1), "term": pairs % max(len(terms), 1), "times": times, "item_id": np.array([i or 0 for i, _ in items], np.int64), "null": null}


def store_queries(items: DataFrame) -> tuple[str, list[str]]:
    """A shared folder with files of items, made by tasks, and their names."""
    folder = shared_folder(items.sparkSession, "queries")
    rows = items.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))

    def write(batches):
        held, size = [], 0

        def one() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            _put(folder, f"{name}.npz", query_arrays(held))
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for b in batches:
            for item in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if item[1]:
                    held.append(item)
                    size += len(item[1])
                if len(held) >= ITEMS_A_FILE or size >= BLOCK_BYTES:
                    yield one()
                    held, size = [], 0
        if held:
            yield one()

    return folder, sorted(r.name for r in rows.mapInArrow(write, "name string").collect())  # a name for each file of items


def store_weights(index: DataFrame, folder: str, names: list[str], n_docs: int) -> None:
    """Beside each query file the weights of its terms, from the documents of each term in the whole index."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for terms, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                terms, counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, "<i4")
                for name in names if len(terms) else ():
                    if name not in held:
                        held = {name: _load(f"{folder}/{name}.npz")["terms"]}  # one file at a time
                    wanted = held[name]
                    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                    hit = np.flatnonzero(terms[at] == wanted)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.string()), pa.array(hit), pa.array(counts[at[hit]].astype(np.int64))], ["name", "term", "n"])

    def weigh(batches):
        name, found = None, []

        def put() -> None:
            size = len(_load(f"{folder}/{name}.npz")["terms"])
            df = np.zeros(size, np.int64)
            for term, n in found:
                df[term] = n
            w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()]
            _put(folder, f"{name}.weights.npz", {"weights": np.array(w, np.int64)})

        for b in batches:
            for n, *pair in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if n != name:
                    if name is not None:
                        put()
                    name, found = n, []
                found.append(pair)
        if name is not None:
            put()
        yield from ()

    counts = index.select("terms", "counts").mapInArrow(count, "name string, term long, n long").groupBy("name", "term").agg(F.sum("n").alias("n"))
    counts.repartition("name").sortWithinPartitions("name").mapInArrow(weigh, "name string").write.format("noop").mode("overwrite").save()


class Block:
    """A row of the index: ``maps`` gives bitmaps over its documents."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.words = max(1, -(-len(self.doc_ids) // 64))
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.places = np.frombuffer(row["places"], "<i4")
        self.slices = [np.frombuffer(s, np.uint8) for s in row["slices"]]

    def local(self, terms: np.ndarray) -> np.ndarray:
        """The place here of each of ``terms``, -1 where no document has it."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def maps(self, local: np.ndarray) -> np.ndarray:
        """(bit, term, word): the impact bits of terms, as bitmaps over the documents."""
        n = self.counts[local]
        which = np.repeat(np.arange(len(local)), n)
        posting = np.repeat(self.first[local] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        doc = self.places[posting].astype(np.int64)
        word = which * self.words + (doc >> 6)
        one = np.uint64(1) << (doc & 63).astype(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out = np.zeros((IMPACT_BITS, len(local) * self.words), np.uint64)
        byte, shift = posting >> 3, (posting & 7).astype(np.uint8)
        for s in range(IMPACT_BITS):
            out[s, word[starts]] = np.bitwise_or.reduceat(np.where((self.slices[s][byte] >> shift) & 1 > 0, one, np.uint64(0)), starts)
        return out.reshape(IMPACT_BITS, len(local), self.words)


def add(total: np.ndarray, number: np.ndarray, shift: int) -> None:
    """``total`` += ``number`` << ``shift``, bit slices first, by a ripple of carries."""
    carry = None
    for s in range(shift, len(total)):
        a = total[s]
        if s - shift < len(number):
            b = number[s - shift]
            half = a ^ b
            if carry is None:
                total[s], carry = half, a & b
            else:
                total[s], carry = half ^ carry, (a & b) | (carry & half)
        else:
            if carry is None or not carry.any():
                return
            total[s], carry = a ^ carry, a & carry


def weighted(maps: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The bitmaps of terms times their weights: added shifted by each bit that a weight has."""
    bits = int(weights.max()).bit_length() if len(weights) else 0
    out = np.zeros((len(maps) + bits, *maps.shape[1:]), np.uint64)
    for j in range(bits):
        has = ((weights >> j) & 1 > 0)[:, None]
        add(out, maps & np.where(has, _ONES, np.uint64(0)), j)
    return out


def summed(products: np.ndarray, n_items: int, item: np.ndarray, term: np.ndarray, times: np.ndarray, bits: int) -> np.ndarray:
    """(bit, item, word): for each item the sum of its terms' products, each ``times`` over; ``bits`` hold any sum."""
    total = np.zeros((bits, n_items, products.shape[2]), np.uint64)
    for j in range(int(times.max()).bit_length() if len(times) else 0):
        has = (times >> j) & 1 > 0
        of, what = item[has], term[has]
        order = np.argsort(of, kind="stable")
        of, what = of[order], what[order]
        nth = np.arange(len(of)) - np.searchsorted(of, of)
        for r in range(int(nth.max()) + 1 if len(nth) else 0):  # the items' r-th terms together
            now = nth == r
            rows = of[now]
            part = total[:, rows]
            add(part, products[:, what[now]], j)
            total[:, rows] = part
    return total


def top(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of the ``k`` highest sums above 0 of each item, the first documents of equal ones."""
    sure = np.zeros(total.shape[1:], np.uint64)
    equal = np.bitwise_or.reduce(total, axis=0)  # documents with any bit
    count = lambda m: np.bitwise_count(m).sum(1, dtype=np.int64)
    for s in range(len(total) - 1, -1, -1):
        having = equal & total[s]
        many = (count(sure) + count(having) > k)[:, None]
        sure = np.where(many, sure, sure | having)
        equal = np.where(many, having, equal & ~total[s])
    unpack = lambda m: np.unpackbits(m.view(np.uint8).reshape(len(m), -1), axis=1, bitorder="little").astype(bool)
    chosen, tied = unpack(sure), unpack(equal)
    room = k - chosen.sum(1)
    chosen |= tied & (np.cumsum(tied, axis=1) <= room[:, None])
    item, doc = np.nonzero(chosen)
    score = np.zeros(len(item), np.int64)
    for s in range(len(total)):
        score |= ((total[s, item, doc >> 6] >> (doc & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << s
    return item, doc, score


def answered(block: Block, queries: dict[str, np.ndarray], weights: np.ndarray, k: int):
    """(item rows, documents, scores) of a block's best for groups of a query file's items."""
    here = block.local(queries["terms"])
    live = (here[queries["term"]] >= 0) & (weights[queries["term"]] > 0)
    item, term, times = queries["item"][live], queries["term"][live], queries["times"][live]
    for low in range(0, len(queries["item_id"]), ITEMS_TOGETHER):
        a, z = np.searchsorted(item, (low, low + ITEMS_TOGETHER))
        if a == z:
            continue
        used, local = np.unique(term[a:z], return_inverse=True)
        highest = np.bincount(item[a:z] - low, weights[term[a:z]].astype(float) * times[a:z]).max()
        bits = IMPACT_BITS + int(highest + 1).bit_length()
        total = summed(weighted(block.maps(here[used]), weights[used]), min(ITEMS_TOGETHER, len(queries["item_id"]) - low), item[a:z] - low, local, times[a:z], bits)
        which, doc, score = top(total, k)
        yield which + low, doc, score


def searched(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each row of ``items``."""
    n_docs, n_terms = corpus_size(docs)
    folder, names = store_queries(items)
    index = build_index(docs, n_docs, n_terms)
    store_weights(index, folder, names, n_docs)

    def answer(batches):
        held: dict[str, tuple] = {}

        def get(name: str) -> tuple:
            if name not in held:
                held.clear()  # one file at a time
                fs, p = opened(f"{folder}/{name}.weights.npz")
                queries = _load(f"{folder}/{name}.npz")
                held[name] = queries, _load(f"{folder}/{name}.weights.npz")["weights"] if fs.get_file_info(p).is_file else np.zeros(len(queries["terms"]), np.int64)
            return held[name]

        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                ids = np.array(block.doc_ids, object)
                for name in names:
                    queries, weights = get(name)
                    for which, doc, score in answered(block, queries, weights, k):
                        item_id = pa.array(queries["item_id"][which], mask=queries["null"][which])
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(which), pa.string()), pa.array(which), item_id, pa.array(ids[doc], pa.int64()), pa.array(score)], ["file", "item_row", "item_id", "doc_id", "score"])

    best = Window.partitionBy("file", "item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return index.mapInArrow(answer, _FOUND).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
