"""A lexical index in blocks and exact top-k BM25 with bounds.

The stored index has a file in shared storage for each block of passages: its terms, the postings of each term, and for each term its largest tf and its
shortest passage, from which its largest weight in the block follows under any mean length.  The index's rows are these files' paths and sizes, so a
task has one block in memory, however many it reads.  Queries, with the idf of their terms, are written to shared files.  A task
that answers keeps for each query the k best scores so far; a block whose terms' largest weights don't add up to the
k-th is skipped, and inside a block the terms that together can't reach it make no candidates and are looked up for
candidates of the other terms only.  So common words make no row for each passage, and what is shuffled follows queries x tasks x k.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.stemming import stem
from quillspark.storage import grouped_files, kept, opened, read_arrow, shared_files, shared_folder, write_shared

K1, B = 1.5, 0.75
#: Words of a block, rows (of a query and a term) of a query file.
WORDS_A_BLOCK, ROWS_A_FILE = 1 << 20, 1 << 16
#: Rows of the index, columns of a block's file, which has one row.
_INDEX = "task int, block string, passages long, words long, kept_words long"
_COLUMNS = ["pids", "lengths", "kept_lengths", "terms", "counts", "places", "tfs", "most", "shortest"]
_MARGIN = 1e-6


def build(passages: DataFrame, tokens, drop: list[str] | None = None, stems: bool = False) -> DataFrame:
    """The stored index of passages (pid, text): one pass over the texts.

    Without stems the words of ``drop`` are indexed too, and each passage has its length with and without them, so one index answers
    queries with and without stopwords.  With stems the words of ``drop`` are left out and the others go by their stems.
    """
    dropped = pa.array(sorted(drop or []), pa.string())
    folder = shared_folder(passages.sparkSession, "blocks")

    def block(pids: pa.Array, lists: pa.Array) -> pa.RecordBatch:
        n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(pids)), n)
        gone = pc.is_in(words, value_set=dropped).to_numpy(zero_copy_only=False)[code] if len(dropped) and len(code) else np.zeros(len(code), bool)
        kept_n = np.bincount(doc[~gone], minlength=len(pids))
        if stems:
            words = pa.array([stem(w) for w in words.to_pylist()], pa.string())
            code, doc, n = code[~gone], doc[~gone], kept_n
        terms = pc.unique(words).sort()
        rank = pc.index_in(words, value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, tf = np.unique(rank[code] * max(len(pids), 1) + doc, return_counts=True)
        term, place = np.divmod(pairs, max(len(pids), 1))
        counts = np.bincount(term, minlength=len(terms))
        used = counts > 0
        starts = (np.cumsum(counts) - counts)[used]
        length = n[place]
        most = np.maximum.reduceat(tf, starts) if len(tf) else tf
        shortest = np.minimum.reduceat(np.minimum(length, kept_n[place]), starts) if len(tf) else tf
        raw = (x.astype("<i4").tobytes() for x in (n, kept_n, counts[used], place, tf, most, shortest))
        a, b, c, d, e, f, g = (pa.array([x], pa.binary()) for x in raw)
        ids, words = pa.array([pids.to_pylist()], pa.list_(pa.int64())), pa.array([terms.filter(pa.array(used)).to_pylist()], pa.list_(pa.string()))
        path, out = f"{folder}/{uuid.uuid4().hex}", pa.BufferOutputStream()  # a repeated task writes others, and the index has those of one attempt
        pq.write_table(pa.Table.from_arrays([ids, a, b, words, c, d, e, f, g], _COLUMNS), out, use_dictionary=False, write_statistics=False)
        write_shared(path, out.getvalue())
        row = pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([x]) for x in (path, len(pids), int(n.sum()), int(kept_n.sum())))
        return pa.RecordBatch.from_arrays(list(row), ["task", "block", "passages", "words", "kept_words"])

    def run(batches):
        for b in batches:
            size = np.cumsum(pc.list_value_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < b.num_rows:
                end = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + WORDS_A_BLOCK, "right")))
                yield block(b.column(0).slice(first, end - first), b.column(1).slice(first, end - first))
                first = end

    return kept(passages.select(F.col("pid").cast("long").alias("pid"), tokens(F.col("text")).alias("w")).mapInArrow(run, _INDEX), "lexical")


def _int(data: pa.Buffer) -> np.ndarray:
    return np.frombuffer(data, "<i4")


def _blocks(index: DataFrame) -> DataFrame:
    """The blocks' paths on all cores, those of a task that built them together."""
    return index.repartitionByRange(index.sparkSession.sparkContext.defaultParallelism, "task").select("block")


def _read(path: str, columns: list[str]) -> dict:
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        row = pq.ParquetFile(f).read(columns)
    return {c: row.column(c)[0].values if c in ("pids", "terms") else row.column(c)[0].as_buffer() for c in columns}


def document_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) of the terms that any passage has.

    The different terms go to shared files, in which a task that reads blocks looks up what they have: it gives a row for each of ``terms``
    that its blocks have, never one for each word of a block.  The index's rows are paths, so Spark would take whatever comes of them for small and broadcast it.
    """
    folder = grouped_files(terms.select("term").distinct(), "term", [], ROWS_A_FILE, "terms", whole=False)

    def run(batches):
        names, held, found = shared_files(folder), {}, {}

        def get(name: str) -> pa.Array:
            if name not in held:
                held.clear()  # one file at a time
                held[name] = read_arrow(f"{folder}/{name}").column(0).combine_chunks()
            return held[name]

        for b in batches:
            for path in b.column(0).to_pylist():
                row = _read(path, ["terms", "counts"])
                counts = _int(row["counts"]).astype(np.int64)
                for name in names:
                    at = pc.index_in(get(name), value_set=row["terms"]).fill_null(-1).to_numpy().astype(np.int64)
                    n = found.setdefault(name, np.zeros(len(at), np.int64))
                    n[at >= 0] += counts[at[at >= 0]]
        for name, n in found.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([get(name).take(pa.array(some)), pa.array(n[some])], ["term", "n"])

    return _blocks(index).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


class _Block:
    """A block of the index with the weights that a mean length gives."""

    def __init__(self, row: dict, mean: float, without: bool):
        self.pids = row["pids"].to_numpy(zero_copy_only=False)
        self.lengths = _int(row["kept_lengths" if without else "lengths"])
        self.terms = row["terms"]
        self.places, self.tfs = _int(row["places"]), _int(row["tfs"])
        self.ends = np.cumsum(_int(row["counts"]).astype(np.int64))
        self.mean = mean
        self.most = self.weight(_int(row["most"]).astype(float), _int(row["shortest"]).astype(float))

    def weight(self, tf, length):
        return tf / (tf + K1 * (1 - B + B * length / self.mean))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.ends[term - 1] if term else 0, self.ends[term])
        places = self.places[at]
        return places, self.weight(self.tfs[at].astype(float), self.lengths[places])

    def answer(self, terms: np.ndarray, factors: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, how many passages were scored) of passages whose score may reach ``least``."""
        bound = factors * self.most[terms]
        order = np.argsort(bound, kind="stable")
        so_far = np.cumsum(bound[order])
        none = np.zeros(0, np.int64)
        if not len(order) or so_far[-1] < least - _MARGIN:
            return none, none.astype(float), 0
        idle = int(np.searchsorted(so_far, least - _MARGIN))  # together these can't reach it
        total = np.zeros(len(self.pids))
        seen = np.zeros(len(self.pids), bool)
        for i in order[idle:]:
            places, w = self.postings(terms[i])
            total[places] += factors[i] * w
            seen[places] = True
        found = np.flatnonzero(seen)
        scored = len(found)
        for r in range(idle - 1, -1, -1):
            found = found[total[found] + so_far[r] >= least - _MARGIN]
            if not len(found):
                break
            places, w = self.postings(terms[order[r]])
            at = np.minimum(np.searchsorted(places, found), len(places) - 1)
            hit = places[at] == found
            total[found[hit]] += factors[order[r]] * w[at[hit]]
        return found, total[found], scored


def search(index: DataFrame, queries: DataFrame, k: int, tokens, stopwords: list[str] | None = None, stems: bool = False, digits: int = 6, report: bool = False) -> DataFrame:
    """(qid, pid, score) that hold the ``k`` best passages of each query (qid, question), ties by the smaller pid, each
    task's share of them; with ``report`` (blocks, skipped, scored, passages) instead: pairs of a block and a query, those that bounds
    skipped, passages that were scored and passages in all."""
    asked = queries.select("qid", F.explode(tokens(F.col("question"), stopwords)).alias("term"))
    if stems:
        asked = asked.withColumn("term", _stemmed("term"))
    asked = asked.groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    without = bool(stopwords) and not stems
    sums = index.agg(F.sum("passages"), F.sum("kept_words" if without else "words")).first()
    n, mean = int(sums[0] or 0), (sums[1] or 0) / max(sums[0] or 0, 1) or 1.0
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    factors = asked.join(document_counts(index, asked).hint("merge"), "term").select("qid", "term", (idf * F.col("qtf")).alias("factor"))
    folder = grouped_files(factors, "qid", ["term"], ROWS_A_FILE, "queries")
    qid = T.StructField("qid", queries.schema["qid"].dataType)
    schema = "blocks long, skipped long, scored long, passages long" if report else T.StructType([qid, T.StructField("pid", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        names, held, best = shared_files(folder), {}, {}

        def get(name: str):
            if name not in held:
                held.clear()  # one file at a time
                rows = read_arrow(f"{folder}/{name}")
                qids = rows.column(0).combine_chunks()
                codes = qids.dictionary_encode().indices.fill_null(-1).to_numpy()
                firsts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                held[name] = qids.take(pa.array(firsts)), np.append(firsts, len(codes)), rows.column(1).combine_chunks(), rows.column(2).to_numpy()
            return held[name]

        for b in batches:
            for path in b.column(0).to_pylist():
                block = _Block(_read(path, _COLUMNS), mean, without)
                for name in names:
                    heads, bounds, terms, factor = get(name)
                    local = pc.index_in(terms, value_set=block.terms).fill_null(-1).to_numpy().astype(np.int64)
                    least = best.setdefault(name, np.full((len(heads), k), -np.inf))
                    out, skipped, scored, met = [], 0, 0, 0
                    for q in range(len(heads)):
                        at = slice(bounds[q], bounds[q + 1])
                        here = local[at] >= 0
                        if not here.any():
                            continue
                        met += 1
                        found, score, some = block.answer(local[at][here], factor[at][here], least[q, 0])
                        skipped += not some
                        scored += some
                        if not len(found):
                            continue
                        score = np.round(score, digits)
                        order = np.lexsort((block.pids[found], -score))[:k]
                        order = order[score[order] >= least[q, 0] - _MARGIN]
                        out.append((np.full(len(order), q), block.pids[found[order]], score[order]))
                        least[q] = np.sort(np.concatenate([least[q], score[order]]))[-k:]
                    if report:
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (met, skipped, scored, met * len(block.pids))], ["blocks", "skipped", "scored", "passages"])
                    elif out:
                        q, pids, score = (np.concatenate(x) for x in zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([heads.take(pa.array(q)), pa.array(pids), pa.array(score)], ["qid", "pid", "score"])

    return _blocks(index).mapInArrow(run, schema)


@F.pandas_udf(T.StringType())
def _stemmed(terms):
    return terms.map(lambda t: None if t is None else stem(t))


def merged(reports: list[DataFrame]) -> DataFrame:
    """Search reports added up."""
    whole = reduce(DataFrame.unionByName, reports)
    return whole.agg(*(F.sum(c).alias(c) for c in whole.columns))
